"""Row validity, the collection filter and its audit, all compiled from declarative rules."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions import dates, fixed
from postmill.functions.text import present


def fused(patterns: list[str], flags: str = "(?i)") -> str:
    """Many patterns as one alternation: one compilation and one pass."""
    return flags + "|".join(f"(?:{p})" for p in patterns) if patterns else "(?!)"


def any_of(text: Column, patterns: list[str], low: Column | None = None) -> Column:
    """Whether the text matches one of the patterns, whatever the case.

    Patterns of letters, digits and blanks alone are looked up as substrings of the lower-case text (``low``), which costs a
    fraction of a regular expression; the others are fused into one.
    """
    plain = [p for p in patterns if re.fullmatch("[A-Za-z0-9 ]+", p)]
    rest = [p for p in patterns if p not in plain]
    hits = [F.contains(F.lower(text) if low is None else low, F.lit(p.lower())) for p in plain]
    if rest or not hits:
        hits.append(F.rlike(text, F.lit(fused(rest))))
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


#: Every reason of ``invalid_reason`` and of ``CollectionRules.verdict``.
REASONS = ("empty title", "title absurdly long", "title contains markup", "title has no words", "bad url", "no company", "no match", "excluded word", "location")


def invalid_reason(title: str = "title", url: str = "url", company: str = "company") -> Column:
    """Why a row would poison the state, or null: ordered checks, the first reason wins."""
    t, u = F.trim(present(title)), F.trim(present(url))
    return (
        F.when(t == "", "empty title")
        .when(F.length(t) > 300, "title absurdly long")
        .when(F.rlike(t, F.lit("(?i)<[a-z/!]")), "title contains markup")
        .when(~F.rlike(t, F.lit("[a-zA-Z]{3}")), "title has no words")
        .when((u != "") & ((F.length(u) > 1000) | ~F.rlike(u, F.lit("^https?://"))), "bad url")
        .when(F.trim(present(company)) == "", "no company")
    )


@dataclass
class CollectionRules:
    """Pattern lists of the collection filter."""

    include: list[str] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    domains: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    rank_words: list[str] = field(default_factory=list)
    junior: list[str] = field(default_factory=list)
    home: list[str] = field(default_factory=list)
    away: list[str] = field(default_factory=list)
    locations: list[str] = field(default_factory=list)

    def problems(self, must_keep: list[str] = (), must_drop: list[str] = ()) -> list[str]:
        """What is wrong with the rules themselves: patterns that don't compile or match everything, and failed probes."""
        out = []
        for name, patterns in vars(self).items():
            for p in patterns:
                try:
                    if re.search(p, ""):
                        out.append(f"{name}: {p!r} matches everything")
                except re.error as e:
                    out.append(f"{name}: {p!r} does not compile ({e})")
        if not out:
            out += [f"would drop {t!r}" for t in must_keep if not self._matches(t)] + [f"would keep {t!r}" for t in must_drop if self._matches(t)]
        return out

    def _matches(self, title: str) -> bool:
        find = lambda ps: re.search(fused(ps), title)
        r, d = find(self.roles), find(self.domains)
        kept = find(self.include) or (r and d and r.span() != d.span())
        x = find(self.exclude)
        return bool(kept) and not (x and not (find(self.junior) and re.fullmatch(fused(self.rank_words), x[0])))

    def matches(self, title: Column) -> Column:
        """An included phrase, or a role word and a domain word at different spans."""
        t = present(title)
        role, dom = F.lit(fused(self.roles)), F.lit(fused(self.domains))
        span = lambda p: F.struct(F.regexp_instr(t, p), F.length(F.regexp_substr(t, p)))
        pair = F.rlike(t, role) & F.rlike(t, dom) & (span(role) != span(dom))
        return F.rlike(t, F.lit(fused(self.include))) | pair

    def excluded(self, title: Column) -> Column:
        """An excluded word, unless a junior marker stands beside a mere rank word."""
        t = present(title)
        hit = F.trim(F.regexp_substr(t, F.lit(fused(self.exclude))))
        rank_only = F.rlike(hit, F.lit("(?i)^(?:" + "|".join(self.rank_words or ["(?!)"]) + ")$"))
        return hit.isNotNull() & ~(F.rlike(t, F.lit(fused(self.junior))) & rank_only)

    def placed(self, title: Column, location: Column) -> Column:
        """An away city in the title decides; else a blank location passes, a home marker beats away ones, and the rest must be listed."""
        t, where = present(title), F.trim(present(location))
        home, away = (F.rlike(where, F.lit(fused(p))) for p in (self.home, self.away))
        listed = F.rlike(where, F.lit(fused(self.locations))) if self.locations else F.lit(True)
        return ~F.rlike(t, F.lit(fused(self.away))) & ((where == "") | home | (~away & listed))

    def verdict(self, title: Column, location: Column) -> Column:
        """Null for a kept row, else the first reason against it."""
        return F.when(~self.matches(title), "no match").when(self.excluded(title), "excluded word").when(~self.placed(title, location), "location")


def audited(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(kept rows, counts by reason)."""
    judged = rows.withColumn("__why", reason)
    return judged.where("__why is null").drop("__why"), judged.where("__why is not null").groupBy(F.col("__why").alias("reason")).agg(F.count("*").alias("n"))


def reject_audit(rows: DataFrame, title: str, reason: Column, seq: str) -> DataFrame:
    """Each rejected title that no kept row has, with its count and first reason; most frequent first."""
    judged = rows.withColumn("__why", reason)
    lost = judged.where("__why is not null").groupBy(title).agg(F.count("*").alias("n"), F.min_by("__why", seq).alias("reason"))
    kept = judged.where("__why is null").select(title).distinct()
    return lost.join(kept, title, "left_anti").orderBy(F.desc("n"), title)


def all_terms(terms: list[str], *columns: str) -> Column:
    """Every term occurs in one of the columns, whatever the case."""
    out = F.lit(True)
    for t in terms:
        out = out & F.greatest(*[F.contains(F.lower(present(c)), F.lit(t.lower())) for c in columns]) if len(columns) > 1 else out & F.contains(F.lower(present(columns[0])), F.lit(t.lower()))
    return out


def retroactive(rows: DataFrame, as_of: Column, title: str | None = None, wanted: CollectionRules | None = None, max_years: int | None = None, max_open: int | None = None) -> DataFrame:
    """Stored rows (title, location, years_required, posted, valid_through) with ``cut``: the first rule that no longer lets them through, or null.

    In order: an excluded title, the collection rules as they are now, more years of experience than wanted, and open for
    longer than wanted by the posting's own date without a closing date. A row has one reason, so counts add up.
    """
    steps = []
    if title:
        steps.append((F.rlike(present("title"), F.lit(title)), "title"))
    if wanted is not None:
        steps.append((wanted.verdict(F.col("title"), F.col("location")).isNotNull(), "no longer matches the current rules"))
    if max_years is not None:
        steps.append((F.col("years_required") > max_years, f">{max_years}y experience"))
    if max_open is not None:
        steps.append(((dates.days_since(F.col("posted"), as_of) > max_open) & (present("valid_through") == ""), f"open >{max_open}d with no close date"))
    return rows.withColumn("cut", F.coalesce(*[F.when(c, F.lit(why)) for c, why in steps], F.lit(None).cast("string")))


def cut_examples(rows: DataFrame, most: int = 12, seq: str = "id") -> DataFrame:
    """(cut, place, company, title, years_required): the first ``most`` rows that each rule cut, by company and title.

    Spark keeps the first rows of each reason before the shuffle, so a reason that takes most rows stays cheap.
    """
    w = Window.partitionBy("cut").orderBy("company", "title", seq)
    return rows.where("cut is not null").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("cut", "place", "company", "title", "years_required")


def apply_list(scored: DataFrame, seq: str = "seq", max_age: int = 45, keep_brokers: bool = False, hide_recruiters: bool = False) -> DataFrame:
    """Scored rows (url, title, company, why, score) with ``cut``, and what the list tells of those that stay.

    In order: rows without a link go, then all but the first of each link, roles in broking, those open for longer than
    ``max_age`` days by their explanation, and agencies' if asked. ``agency``, ``unverified`` and ``age`` describe a row;
    ``band`` is where its score puts it.
    """
    note = present("why")
    key = F.lower(F.regexp_replace(F.trim(present("url")), "/+$", ""))
    first = F.row_number().over(Window.partitionBy(F.when(key != "", key).otherwise(F.concat(F.lit("\n"), F.col(seq).cast("string")))).orderBy(seq))
    is_in = lambda c, p: F.rlike(present(c), F.lit("(?i)" + p))
    open_for = F.regexp_extract(note, r"open (\d+)d, no close date", 1).try_cast("int")
    rows = scored.withColumns({"agency": is_in("company", fixed.RECRUITERS), "unverified": F.contains(note, F.lit("site blocked the check")), "age": F.regexp_extract(note, r"\b(\d+)d old", 1).try_cast("int"), "__first": first})
    cut = F.when(key == "", "nolink").when(F.col("__first") > 1, "duplicate")
    if not keep_brokers:
        cut = cut.when(is_in("title", fixed.BROKING), "broker")
    cut = cut.when(open_for > max_age, "stale")
    if hide_recruiters:
        cut = cut.when(F.col("agency"), "recruiter")
    band = F.when(F.col("score") >= 110, "Prime").when(F.col("score") >= 90, "Strong").when(F.col("score") >= 70, "Worth a look").when(F.col("score") >= 45, "Marginal").otherwise("Long tail")
    return rows.withColumns({"cut": cut, "band": band}).drop("__first")
