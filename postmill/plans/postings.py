"""The ranking from end to end: events as sightings of documents, folded, joined to checks, filtered and scored."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import fixed
from postmill.functions import text as T
from postmill.operators import filters
from postmill.operators.filters import CollectionRules
from postmill.operators.score import explained
from postmill.plans import documents, ranking
from postmill.plans.registry import query
from postmill.sources.tables import table

SOURCES = {"purchase": "greenhouse", "signup": "html", "click": "linkedin", "view": "reed"}
ASKS, HEDGE = documents.whole("station|river|que"), documents.whole("of|and|der|de")
RUBRIC = replace(documents.RUBRIC, sources={"greenhouse": 8, "html": 5, "linkedin": -2}, phd_pattern=ASKS, phd_hedge=HEDGE)
WANTED = CollectionRules(include=["[a-z]{3}"], exclude=["the", "que"], rank_words=["que"], junior=["los"])


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight events in a row sight one document: its first line is the title, its source the firm, the event's type the source."""
    e = table(spark, sf_dir, "events")
    source = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in SOURCES.items()], F.lit("unranked"))
    seen = e.select(
        F.floor(F.col("event_id") / 8).alias("id"), source.alias("source"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("https://x.example/"), F.col("event_id").cast("string"))).alias("url"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("first_seen"),
    )
    return seen.join(documents.titled(spark, sf_dir).select("id", "company", "title"), "id").withColumns({"location": F.lit(""), "posted": F.lit("")})


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    checks = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("description")).join(labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("live"), F.col("toxic").alias("anonymous")), "id", "left")
    checks = checks.withColumn("checked_at", F.when(F.col("live").isNotNull(), documents.AS_OF)).withColumn("live", F.when(F.col("id") % 17 != 0, F.col("live")))
    firms = docs.select(T.norm("source").alias("firm"), F.col("source").alias("category")).distinct()
    return ranking.judged(ranking.state_of(sightings(spark, sf_dir)), checks, firms, RUBRIC, documents.AS_OF, ranking.Digest(wanted=WANTED))


_TERMS = documents.SCORED_TERMS
for _old, _new in (
    ("concat_ws(' ', '', title, '')", "concat_ws(' ', '', title, url)"), ("CASE source WHEN 'src0' THEN 3 WHEN 'src1' THEN 2 WHEN 'src3' THEN 1 ELSE 0 END", "CASE source WHEN 'greenhouse' THEN 8 WHEN 'html' THEN 5 WHEN 'linkedin' THEN -2 ELSE 0 END"),
    (fixed.PHD, ASKS), ("live <> 0 AND id % 10 < 4", "false"), ("live <> 0 AND posted_ago > 60 AND id % 5 <> 0", "false"), ("id % 13 = 0", "false"),
):
    assert _old in _TERMS, _old
    _TERMS = _TERMS.replace(_old, _new)

_JUDGED = f"""
    WITH e AS (
        SELECT event_id // 8 AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS first_seen, CASE event_type WHEN 'purchase' THEN 'greenhouse' WHEN 'signup' THEN 'html' WHEN 'click' THEN 'linkedin' WHEN 'view' THEN 'reed' ELSE 'unranked' END AS source,
            CASE event_type WHEN 'purchase' THEN 10 WHEN 'signup' THEN 8 WHEN 'click' THEN 3 WHEN 'view' THEN 2 ELSE 0 END AS r, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'https://x.example/' || event_id END AS url FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY first_seen, url, source) AS k FROM e WHERE id IN (SELECT doc_id FROM documents)),
    b AS (SELECT *, max(r) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM o),
    u AS (SELECT *, best IS NULL OR r > best AS up FROM b),
    f AS (SELECT id, min(first_seen) AS first_seen, arg_max(source, k) FILTER (WHERE up) AS source, coalesce(arg_max(url, k) FILTER (WHERE up AND url <> ''), arg_min(url, k)) AS url, count(*) AS seen_count FROM u GROUP BY id),
    p AS (
        SELECT doc_id, string_split(trim(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '([.!?]) ', '\\1' || chr(1), 'g')), chr(1)) AS parts FROM documents),
    w AS (
        SELECT doc_id, CASE WHEN len(list_filter(parts, lambda x: regexp_matches(x, '(?i){ASKS}') AND NOT regexp_matches(x, '(?i){HEDGE}'))) > 0 THEN 'required'
            WHEN len(list_filter(parts, lambda x: regexp_matches(x, '(?i){ASKS}'))) > 0 THEN 'preferred' END AS phd FROM p),
    d AS (
        SELECT f.*, d.source AS company, split_part(text, chr(10), 1) AS title, text, lower(text) AS body, quality IS NOT NULL AS was_checked, CASE WHEN f.id % 17 <> 0 THEN quality END AS live, toxic, CAST(NULL AS INTEGER) AS years, CAST(NULL AS INTEGER) AS posted_ago,
            CASE WHEN len(text) >= 400 THEN w.phd END AS phd, CAST(floor((epoch(TIMESTAMP '2024-01-31') - epoch(CAST(first_seen AS TIMESTAMP))) / 86400) AS BIGINT) AS age
        FROM f JOIN documents d ON d.doc_id = f.id JOIN w ON w.doc_id = f.id LEFT JOIN labels l ON l.doc_id = f.id),
    {_TERMS},
    j AS (SELECT *, CASE WHEN NOT regexp_matches(title, '(?i)[a-z]{{3}}') OR (regexp_matches(title, '(?i)the|que') AND NOT (regexp_matches(title, '(?i)los') AND lower(regexp_extract(title, '(?i)the|que')) = 'que'))
        THEN 'no longer matches the current rules' END AS cut FROM s)"""


@query(_JUDGED + """SELECT id, source, url, seen_count, cut, score, list_aggregate(list_transform(why, lambda t: t.label || CASE WHEN t.points >= 0 THEN '+' ELSE '' END || t.points), 'string_agg', '; ') AS why FROM j""")
def ranked_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings folded by source rank, then judged: hard rules with the junior override, and every term of the score."""
    return judged(spark, sf_dir).select("id", "source", "url", "seen_count", "cut", "score", explained(F.col("why")).alias("why"))


@query(documents._SCORED + """, c AS (SELECT id, company, title, years, CASE WHEN regexp_matches(title, '(?i)licensed') THEN 'title' WHEN years > 6 THEN '>6y experience' WHEN posted_ago > 45 AND id % 5 <> 0 THEN 'open >45d with no close date' END AS cut FROM s),
    n AS (SELECT *, row_number() OVER (PARTITION BY cut ORDER BY company NULLS FIRST, title NULLS FIRST, id) AS place FROM c WHERE cut IS NOT NULL)
    SELECT cut, CAST(place AS INTEGER) AS place, company, title, years AS years_required FROM n WHERE place <= 12""")
def refilter_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve rows that each hard rule cut, which a report names."""
    return filters.cut_examples(filters.retroactive(documents.checked(spark, sf_dir), F.lit(documents.AS_OF), title="(?i)licensed", max_years=6, max_open=45))
