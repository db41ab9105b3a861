"""Explainable scores: a list of the rules that fired, and its sum."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import dates, fixed
from postmill.functions.text import present
from postmill.operators.filters import any_of, fused
from postmill.operators.rules import RuleMatcher
from postmill.session import narrow_batches

WHY = "array<struct<label:string,points:int>>"


@dataclass
class Rubric:
    """Points and patterns. Every part may be empty; a term without an entry adds nothing.

    ``python`` says that the patterns are Python's, as those of rule files are: they are matched by one automaton for each text that
    they read (``rules.RuleMatcher``). Else they are Java's and become expressions, for which a rubric should be short.
    """

    tiers: list[tuple[str, int, list[str]]] = field(default_factory=list)
    junior: tuple[list[str], int, int] = ((), 0, 0)  # patterns, points with, points without
    years_cap: int = 4
    over_cap: int = -20
    per_year_over: int = -5
    phd_title: int = -60
    phd: dict[str, int] = field(default_factory=lambda: {"required": -45, "preferred": -12})
    phd_pattern: str = fixed.PHD
    phd_hedge: str = fixed.PHD_SOFT
    categories: dict[str, int] = field(default_factory=dict)
    category_roles: dict[str, tuple[int, list[str]]] = field(default_factory=dict)
    signals: list[tuple[str, int, list[str]]] = field(default_factory=list)
    least_text: int = 400
    home: tuple[list[str], int] = ((), 0)
    away: tuple[list[str], int] = ((), 0)
    no_location: int = 0
    sources: dict[str, int] = field(default_factory=dict)
    freshness: list[tuple[int, int]] = field(default_factory=list)
    live: int = 10
    dead: int = -100
    unverified: int = -5
    mismatch: int = -15
    anonymous: int = -10
    long_open: int = -10
    ghost: int = -25
    python: bool = False

    def by_text(self) -> dict[str, list[str]]:
        """The patterns that each text is read for."""
        title = [p for _, _, ps in self.tiers for p in ps] + list(self.junior[0]) + [p for _, ps in self.category_roles.values() for p in ps]
        return {
            "__title": title, "__both": [p for _, n, ps in self.signals if n < 0 for p in ps], "__text": [p for _, n, ps in self.signals if n >= 0 for p in ps],
            "__where": [*self.home[0], *self.away[0]],
        }


def entry(label: Column | str, points: Column | int) -> Column:
    return F.struct((F.lit(label) if isinstance(label, str) else label).alias("label"), (F.lit(points) if isinstance(points, int) else points).cast("int").alias("points"))


def terms(r: Rubric, as_of: Column, cols: set[str]) -> list[Column]:
    """One nullable struct by rule, in the order of the explanation. Columns that the rows lack count as null."""
    get = lambda c, kind="string": F.col(c) if c in cols else F.lit(None).cast(kind)
    title, text = F.col("__title"), F.col("__text")
    known = {c: {p: i for i, p in enumerate(dict.fromkeys(ps))} for c, ps in r.by_text().items()}

    def found(name: str, patterns: list[str]) -> Column:
        """Whether one of the patterns matches a text."""
        if r.python:
            return F.arrays_overlap(F.col(f"{name}_hits"), F.array(*[F.lit(known[name][p]) for p in patterns])) if patterns else F.lit(False)
        return any_of(F.col(name), patterns, F.col(name)) if name in ("__both", "__text") else F.rlike(F.col(name), F.lit(fused(list(patterns))))

    out = []
    if r.tiers:
        tier = None
        for name, points, patterns in r.tiers:
            hit = found("__title", patterns)
            tier = F.when(hit, entry(f"title:{name}", points)) if tier is None else tier.when(hit, entry(f"title:{name}", points))
        out.append(tier)
    if r.junior[0]:
        out.append(F.when(found("__title", r.junior[0]), entry("junior title", r.junior[1])).otherwise(entry("no seniority marker", r.junior[2])))
    years = get("years_required", "int")
    out.append(F.when(years > r.years_cap, entry(F.concat(F.lit("wants "), years.cast("string"), F.lit("y experience")), F.lit(r.over_cap) + F.lit(r.per_year_over) * (years - r.years_cap - 1))))
    want = get("phd")
    by_text = F.coalesce(*[F.when(want == k, entry(fixed.PHD_LABELS.get(k, f"PhD {k}"), p)) for k, p in r.phd.items()])
    out.append(F.when(F.rlike(title, F.lit("(?i)" + r.phd_pattern)), entry("title asks for a PhD", r.phd_title)).otherwise(by_text))
    if r.categories:
        cat = F.coalesce(get("category"), F.lit("unknown"))
        points = F.coalesce(*[F.when(cat == k, F.lit(p)) for k, p in r.categories.items()], F.lit(r.categories.get("unknown", 0)))
        out.append(entry(F.concat(F.lit("firm:"), cat), points))
        for k, (p, patterns) in r.category_roles.items():
            out.append(F.when((cat == k) & found("__title", patterns), entry(f"{k} + this role type", p)))
    for name, points, patterns in r.signals:  # against: read anywhere, however short the text
        if points < 0:
            out.append(F.when(found("__both", patterns), entry(f"{fixed.TEXT_LABEL}:{name}", points)))
    size = F.length(text)
    out.append(F.when((size > 0) & (size < r.least_text), entry(F.concat(F.lit(f"{fixed.TEXT_LABEL} too short to read ("), size.cast("string"), F.lit("c)")), 0)))
    for name, points, patterns in r.signals:  # in favour: only where there is enough to read
        if points >= 0:
            out.append(F.when((size >= r.least_text) & found("__text", patterns), entry(f"{fixed.TEXT_LABEL}:{name}", points)))
    if r.home[0] or r.away[0]:
        out.append(
            F.when(found("__where", r.home[0]), entry(fixed.HOME_LABEL, r.home[1]))
            .when(found("__where", r.away[0]), entry(fixed.AWAY_LABEL, r.away[1]))
            .when(F.trim(present(get("location"))) == "", entry("location not stated", r.no_location))
        )
    source = present(get("source"))
    out.append(entry(F.concat(F.lit("via "), source), F.coalesce(*[F.when(source == k, F.lit(p)) for k, p in r.sources.items()], F.lit(0))))
    age = F.coalesce(dates.days_since(get("posted"), as_of), dates.days_since(get("first_seen"), as_of))
    if r.freshness:
        points = dates.stepped(age, r.freshness)
        out.append(F.when(points != 0, entry(F.concat(age.cast("string"), F.lit("d old")), points)))
    live, checked = get("live", "int"), get("checked_at")
    out.append(
        F.when(checked.isNull(), entry("not verified", r.unverified)).when(live.isNull(), entry("site blocked the check", r.unverified))
        .when(live == 0, entry(F.concat(F.lit("dead: "), present(get("reason"))), r.dead)).otherwise(entry("verified live", r.live))
    )
    alive = checked.isNotNull() & (live != 0)
    out.append(F.when(alive & (get("title_match", "double") < 0.34), entry("page title mismatch", r.mismatch)))
    out.append(F.when(alive & (get("anonymous", "int") != 0), entry("employer anonymous", r.anonymous)))
    posted = dates.days_since(get("posted"), as_of)
    out.append(F.when(alive & (posted > 60) & (F.trim(present(get("valid_through"))) == ""), entry(F.concat(F.lit("open "), posted.cast("string"), F.lit("d, no close date")), r.long_open)))
    out.append(F.when(get("ghost", "boolean"), entry("reposted repeatedly", r.ghost)))
    return out


def scored(rows: DataFrame, rubric: Rubric, as_of: Column) -> DataFrame:
    """Rows with ``why`` and ``score``: one projection and no shuffle; Python only where the rubric's patterns are Python's."""
    cols = set(rows.columns)
    # the texts that many rules read are columns of their own, so that they are made once a row
    low = lambda c: F.lower(present(c)) if c in cols else F.lit("")
    rows = rows.withColumns({"__title": present("title") if "title" in cols else F.lit(""), "__text": low("description")})
    rows = rows.withColumn("__both", F.concat(F.lower("__title"), F.lit("\n"), F.col("__text")))
    told = lambda c: present(c) if c in cols else F.lit("")
    rows = rows.withColumn("__where", F.regexp_replace(F.concat_ws(" ", told("location"), F.col("__title"), told("url")), "[-_/]", " "))
    texts = rubric.by_text()
    if rubric.python:
        narrow_batches(rows.sparkSession)
        rows = rows.withColumns({f"{c}_hits": RuleMatcher(list(dict.fromkeys(ps))).column(c) for c, ps in texts.items()})
    rows = rows.withColumn("why", F.filter(F.array(*terms(rubric, as_of, cols)), lambda t: t.isNotNull())).drop(*texts, *[f"{c}_hits" for c in texts])
    return rows.withColumn("score", F.aggregate("why", F.lit(0), lambda acc, t: acc + t["points"]))


def explained(why: Column) -> Column:
    """The explanation as text: label, sign and points."""
    return F.array_join(F.transform(why, lambda t: F.concat(t["label"], F.when(t["points"] >= 0, "+").otherwise(""), t["points"].cast("string"))), "; ")


def score_bands(score: Column, bands: tuple[tuple[int, str], ...] = ((110, "A"), (90, "B"), (70, "C"), (45, "D"))) -> Column:
    out = None
    for least, name in bands:
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise("E")
