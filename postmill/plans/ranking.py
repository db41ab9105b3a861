"""The ranking from end to end: postings and their checks to a digest of two sections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions import dates, fixed
from postmill.functions import text as T
from postmill.functions.text import present
from postmill.operators import dedupe, filters, fold
from postmill.operators.filters import CollectionRules
from postmill.operators.score import Rubric, scored
from postmill.session import materialise


def state_of(sightings: DataFrame) -> DataFrame:
    """Sightings (id, company, title, location, url, source, posted, first_seen, and a salary if told) as one posting an id.

    They replay in the order of ``first_seen``, then of their values: the first one's texts stay, a source of higher rank replaces
    source and link, the first salary stays, and sightings are counted.
    """
    names = ("company", "title", "location", "url", "source", "posted", "first_seen")
    rows = sightings.withColumns({c: F.lit(None).cast("string") for c in names if c not in sightings.columns})
    rank = F.create_map(*[F.lit(x) for pair in fixed.SOURCE_RANK.items() for x in pair])[F.col("source")]
    salary = tuple(c for c in ("salary_min", "salary_max", "currency") if c in sightings.columns)
    rows = rows.withColumn("__seq", F.struct("first_seen", "company", "title", "url", "source"))
    return fold.upsert_fold(rows, ["id"], "__seq", rank, ["company", "title", "location", "posted", "first_seen"], salary=list(salary))


@dataclass
class Digest:
    """What a digest takes. ``since`` (a timestamp) keeps what was first seen after it, topped up below ``backfill_to`` rows."""

    top: int = 60
    least: int = 0
    threshold: int = 60
    per_firm: int | None = 3
    since: str | None = None
    backfill_to: int = 0
    dead_too: bool = False
    excluded_title: str | None = None
    wanted: CollectionRules | None = None
    max_years: int | None = None
    max_open: int | None = None


def everything(d: Digest) -> Digest:
    """The same rules over every open posting: no delta, at most 100,000 rows a section, and dead ones go by their score alone."""
    return Digest(100_000, 0, d.threshold, d.per_firm, None, 0, True, d.excluded_title, d.wanted, d.max_years, d.max_open)


def judged(postings: DataFrame, checks: DataFrame | None, categories: DataFrame | None, rubric: Rubric, as_of: str, d: Digest) -> DataFrame:
    """Postings (id, company, title, location, url, source, posted, first_seen, status) that are still new, with ``cut``, ``carried_over``, ``why`` and ``score``.

    Reposts are told from all postings, whatever else drops them. Missing columns count as empty. ``checks`` has a row an id
    at most; a posting without one was never checked. Whether a doctorate is asked for comes from the description where the
    checks don't tell.
    """
    have = set(postings.columns)
    rows = postings.withColumns({c: F.lit("") for c in ("location", "url", "source", "posted", "first_seen", "status") if c not in have})
    at = dates.parsed(F.col("first_seen"))
    ghosts = dedupe.reposted(rows.select("id", "company", "title", at.alias("at")), [T.norm("company"), T.norm("title")], "at").select("id").distinct().withColumn("ghost", F.lit(True))
    if d.since:
        rows = rows.withColumn("__fresh", F.coalesce(at > F.lit(d.since).cast("timestamp"), F.lit(False)))
        thin = rows.where("__fresh").limit(d.backfill_to).count() < d.backfill_to
        rows = (rows if thin else rows.where("__fresh")).withColumn("carried_over", ~F.col("__fresh")).drop("__fresh")
    else:
        rows = rows.withColumn("carried_over", F.lit(False))
    rows = rows.where(F.coalesce(F.nullif("status", F.lit("")), F.lit("new")) == "new").join(ghosts, "id", "left")
    facts = {"checked_at": "string", "live": "int", "reason": "string", "title_match": "double", "ld_posted": "string", "valid_through": "string", "years_required": "int", "anonymous": "int", "description": "string", "phd": "string"}
    if checks is not None:
        rows = rows.join(checks.select("id", *[c for c in facts if c in checks.columns and c not in rows.columns]), "id", "left")
    rows = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in facts.items() if c not in rows.columns})
    rows = rows.withColumn("posted", F.coalesce(F.nullif("ld_posted", F.lit("")), "posted"))
    if categories is not None:
        rows = rows.withColumn("firm", T.norm("company")).join(categories.select("firm", F.col("category").alias("__cat")), "firm", "left").drop("firm")
        rows = rows.withColumn("category", F.col("__cat")).drop("__cat")
    said = T.graded_requirement("description", "(?i)" + rubric.phd_pattern, "(?i)" + rubric.phd_hedge, rubric.least_text)
    rows = rows.withColumn("phd", F.coalesce("phd", said))
    now = F.lit(as_of)
    rows = filters.retroactive(rows, now, d.excluded_title, d.wanted, d.max_years, d.max_open)
    return scored(rows, rubric, now)


def rank_postings(postings: DataFrame, checks: DataFrame | None, categories: DataFrame | None, rubric: Rubric, as_of: str, d: Digest) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(digest, kept, cuts): the two sections, every row of at least the least score, and how many each hard rule took with its first twelve.

    Rows proven dead go unless ``dead_too``; those never checked, or whose site refused, stay. Of one description's copies
    the best remains.
    """
    rows, _ = materialise(judged(postings, checks, categories, rubric, as_of, d), "judged")  # read for the cuts and for the ranking
    shown = filters.cut_examples(rows).groupBy("cut").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "company", "title", "years_required"))), lambda x: x.dropFields("place")).alias("first"))
    cuts = rows.where("cut is not null").groupBy("cut").agg(F.count("*").alias("n")).join(shown, "cut")
    open_ = dedupe.description_collapse(rows.where("cut is null"), "company", "title", "description", seq="id", least=rubric.least_text)
    if not d.dead_too:
        open_ = open_.where(~F.col("live").eqNullSafe(F.lit(0)))
    kept, _ = materialise(open_.where(F.col("score") >= d.least).drop("cut"), "kept")
    digest = dedupe.two_sections(kept, T.norm("company"), d.threshold, d.least, d.per_firm, d.top, seq="id")
    return digest, kept, cuts


def told(rows: DataFrame, summary: tuple[str, str, str], asks: str) -> DataFrame:
    """Rows with ``summary`` and ``requirements`` of their descriptions; the patterns are lead-in, requirements heading and boilerplate."""
    lead, wants, stop = summary
    return rows.withColumns({"summary": T.summary("description", lead, wants, stop), "requirements": T.stated_requirements("description", wants, stop, asks)})


def worth_telling(postings: DataFrame, limit: int = 60) -> DataFrame:
    """The latest postings that have no status yet."""
    fresh = postings.where(F.coalesce(F.nullif(present("status"), F.lit("")), F.lit("new")) == "new")
    return fresh.orderBy(F.desc("first_seen"), "id").limit(limit)
