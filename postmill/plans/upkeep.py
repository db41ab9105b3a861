"""Queries over suppliers, customers, parts and orders: the registry's upkeep, the collection filter, and landed answers of boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import dates, udfs, web
from postmill.operators import extract, fold, match
from postmill.operators.filters import CollectionRules
from postmill.plans.registry import query
from postmill.session import narrow_batches
from postmill.sources import payloads, registry_tables
from postmill.sources.tables import table


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


_RULES = CollectionRules(
    include=["small (?:ring|bolt)"], roles=["ring|bolt|gear"], domains=["economy|promo|bolt"], exclude=["hot|large", "red"], rank_words=["red"], junior=["widget|gear"], home=["nation_1"], away=["nation_2", "nation_15", "cold"],
    locations=["nation_[0-9]$", "nation_1", "nation_2"],
)


@query("""WITH p AS (SELECT p_partkey, p_name || ' ' || p_type AS title, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE n_name || CASE WHEN p_partkey % 5 = 0 THEN ', NATION_15' ELSE '' END END AS location FROM part JOIN nation ON n_nationkey = p_partkey % 25),
    m AS (SELECT *, regexp_extract(title, '(?i)ring|bolt|gear') AS role, regexp_extract(title, '(?i)economy|promo|bolt') AS dom, regexp_extract(title, '(?i)hot|large|red') AS hit FROM p),
    k AS (SELECT *, regexp_matches(title, '(?i)small (?:ring|bolt)') OR (role <> '' AND dom <> '' AND NOT (strpos(title, role) = strpos(title, dom) AND len(role) = len(dom))) AS matched,
        hit <> '' AND NOT (regexp_matches(title, '(?i)widget|gear') AND lower(hit) = 'red') AS barred,
        NOT regexp_matches(title, '(?i)nation_2|nation_15|cold') AND (location = '' OR regexp_matches(location, '(?i)nation_1') OR (NOT regexp_matches(location, '(?i)nation_2|nation_15|cold') AND regexp_matches(location, '(?i)nation_[0-9]$|nation_1|nation_2'))) AS placed FROM m)
    SELECT p_partkey, CASE WHEN NOT matched THEN 'no match' WHEN barred THEN 'excluded word' WHEN NOT placed THEN 'location' END AS verdict FROM k""")
def collection_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole collection filter over parts as titles: phrases, pairs of words at different spans, the junior override, and places."""
    p, n = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    where = F.when(F.col("p_partkey") % 7 == 0, "").otherwise(_text(F.col("n_name"), F.when(F.col("p_partkey") % 5 == 0, ", NATION_15").otherwise("")))
    rows = p.join(n, F.col("p_partkey") % 25 == F.col("n_nationkey")).select("p_partkey", _text(F.col("p_name"), " ", F.col("p_type")).alias("title"), where.alias("location"))
    return rows.select("p_partkey", _RULES.verdict(F.col("title"), F.col("location")).alias("verdict"))


@query("""SELECT trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS firm, arg_max(category, seq) AS category FROM (
    SELECT 'Firm & Sons-' || (c_custkey % 83) AS name, c_mktsegment AS category, c_custkey AS seq FROM customer UNION ALL SELECT ' firm sons ' || (c_custkey % 41), 'late', c_custkey + 1000000 FROM customer WHERE c_acctbal < 0) GROUP BY firm""")
def firm_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry as a dimension: names normalised, of the same ones the last row."""
    c = table(spark, sf_dir, "customer")
    rows = c.select(_text("Firm & Sons-", F.col("c_custkey") % 83).alias("name"), F.col("c_mktsegment").alias("category"), F.col("c_custkey").alias("seq"))
    late = c.where("c_acctbal < 0").select(_text(" firm sons ", F.col("c_custkey") % 41).alias("name"), F.lit("late").alias("category"), (F.col("c_custkey") + 1_000_000).alias("seq"))
    return registry_tables.categories(rows.unionByName(late))


@query("""WITH n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS verdict, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS misses FROM customer WHERE c_custkey % 2 = 0),
    p AS (SELECT c_custkey AS k, 'old ' || c_mktsegment AS verdict, c_acctbal - 1 AS misses FROM customer WHERE c_custkey % 5 <> 0)
    SELECT coalesce(n.k, p.k) AS c_custkey, coalesce(n.verdict, p.verdict) AS verdict, round(coalesce(n.misses, p.misses), 4) AS misses FROM n FULL JOIN p ON n.k = p.k""")
def carried_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New answers of a run that reached half of the firms, beside the answers of the run before wherever it has none."""
    c = table(spark, sf_dir, "customer")
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("verdict"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("misses"))
    old = c.where("c_custkey % 5 <> 0").select("c_custkey", _text("old ", F.col("c_mktsegment")).alias("verdict"), (F.col("c_acctbal") - 1).alias("misses"))
    return registry_tables.carried(new, old, "c_custkey", ["verdict", "misses"]).withColumn("misses", F.round("misses", 4))


@query("""SELECT s_suppkey, s_name AS name, CASE WHEN s_acctbal < 3000 THEN '' ELSE 's' || s_suppkey || '.example' END AS domain FROM supplier""")
def blanked_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry without the domains that a check found wrong."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"), _text("s", F.col("s_suppkey"), ".example").alias("domain"), "s_acctbal")
    return registry_tables.blanked(s.drop("s_acctbal"), s.where("s_acctbal < 3000"))


@query("""SELECT lower(trim(name)) AS name, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN ' FIRM ' ELSE 'firm ' END || (c_custkey % 1300) AS name FROM customer) GROUP BY ALL HAVING count(*) > 1""")
def repeated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that the registry holds more than once, whatever the case."""
    names = table(spark, sf_dir, "customer").select(_text(F.when(F.col("c_custkey") % 2 == 0, " FIRM ").otherwise("firm "), F.col("c_custkey") % 1300).alias("name"))
    return registry_tables.repeated_names(names)


@query("""SELECT name FROM (SELECT s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'unreachable' ELSE 'ok' END AS verdict, CASE WHEN s_suppkey % 8 = 0 THEN 'HTTP 410' ELSE 'no answer' END AS detail, s_suppkey % 6 AS misses FROM supplier)
    WHERE verdict = 'unreachable' AND (detail = 'HTTP 410' OR misses >= 3)""")
def pruned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firms to drop: missing three times running, or gone for good."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.when(k % 4 == 0, "unreachable").otherwise("ok").alias("verdict"), F.when(k % 8 == 0, "HTTP 410").otherwise("no answer").alias("detail"), (k % 6).cast("int").alias("misses"))
    return fold.prune_missing(rows).select("name")


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN least(CAST(event_id % 200 AS DOUBLE), 120) ELSE least(30, pow(1.6, event_id % 12)) + 2 END ELSE least(30, pow(1.6, event_id % 12)) END AS delay FROM events""")
def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds before each request's next try; errors are refusals for being too many, some of which say how long to wait."""
    told = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 200).cast("string")).otherwise("Wed, 21 Oct")
    delay = dates.retry_delay(F.col("event_id") % 12, F.when(F.col("event_type") == "error", 429).otherwise(503), told)
    return table(spark, sf_dir, "events").select("event_id", delay.alias("delay"))


@query("""WITH e AS (SELECT user_id AS board, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page, CAST(value AS BIGINT) % 40 + 61 AS n, CASE WHEN event_id % 97 = 0 THEN 500 ELSE 200 END AS status, event_id % 89 = 0 AS none FROM events),
    w AS (SELECT board, page, CASE WHEN status >= 400 THEN 'error' WHEN none THEN 'empty' WHEN n < 65 THEN 'short page' WHEN page >= 12 THEN 'ceiling' END AS why FROM e)
    SELECT board, coalesce(arg_min(why, page) FILTER (WHERE why IS NOT NULL), 'not finished') AS stopped FROM w GROUP BY board""")
def why_stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each board's pages ended, by its landed answers in order."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = F.when(F.col("event_id") % 89 == 0, 0).otherwise(F.bround("value", 0).cast("long") % 40 + 61)
    landed = table(spark, sf_dir, "events").select(F.col("user_id").alias("board"), F.row_number().over(order).alias("page"), n.alias("n"), F.when(F.col("event_id") % 97 == 0, 500).otherwise(200).alias("status"))
    return payloads.why_stopped(landed, "board", "page", "n", "status", 65, 12)


@query("""SELECT o_orderpriority AS site, CAST(sum(o_custkey % 120) AS BIGINT) AS found, count(*) FILTER (WHERE o_custkey % 120 >= 100) AS truncated FROM orders GROUP BY ALL""")
def board_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each site brought, and how many of its queries hit the cap."""
    return payloads.board_totals(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("site"), (F.col("o_custkey") % 120).alias("n")), "site", "n", 100)


@query("""WITH o AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE len(text) END AS size, lang FROM documents), n AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE len(text) END AS size, CASE WHEN doc_id % 11 = 0 THEN 'xx' ELSE lang END AS lang FROM documents)
    SELECT n.* FROM n JOIN o USING (doc_id) WHERE n.size IS DISTINCT FROM o.size OR n.lang IS DISTINCT FROM o.lang""")
def reparsed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows whose derived columns change when they are derived again."""
    docs, size = table(spark, sf_dir, "documents"), F.char_length("text").cast("long")
    derived = lambda m: docs.select("doc_id", F.when(F.col("doc_id") % m != 0, size).alias("size"), F.when((F.lit(m) == 6) & (F.col("doc_id") % 11 == 0), "xx").otherwise(F.col("lang")).alias("lang"))
    return extract.reparsed(derived(4), derived(6), "doc_id", ["size", "lang"])


@query("SELECT doc_id, strip_accents(split_part(text, chr(10), 1)) AS plain FROM documents")
def deaccented_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow_batches(spark)
    return table(spark, sf_dir, "documents").select("doc_id", udfs.deaccent(F.substring_index("text", "\n", 1)).alias("plain"))


@query("""SELECT event_id, CASE WHEN event_type <> 'error' AND json_valid(props) THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""")
def json_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of answers that are a 200 and look like JSON."""
    e = table(spark, sf_dir, "events")
    body = web.json_body(F.when(F.col("event_type") == "error", 404).otherwise(200), F.when(F.col("event_id") % 2 == 0, "text/html").otherwise("application/json"), F.col("props"))
    return e.select("event_id", F.try_variant_get(body, "$.k", "bigint").alias("k"))


_LINE_TERMS = "list_distinct(list_transform(regexp_extract_all(lower(coalesce({0}, '')), '[a-z][a-z+#.]{{2,}}'), lambda w: rtrim(w, '.')))"


@query(f"""WITH l AS (SELECT DISTINCT text AS line FROM benchmark), t AS (SELECT line, unnest({_LINE_TERMS.format('line')}) AS term FROM l), d AS (SELECT doc_id, unnest({_LINE_TERMS.format('text')}) AS term FROM documents),
    s AS (SELECT doc_id, line, count(*) AS overlap FROM d JOIN t USING (term) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, line DESC) AS k FROM s)
    SELECT doc_id, line, overlap, CAST(k AS INTEGER) AS k FROM r WHERE k <= 3""")
def leading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three benchmark texts that share most words with each document."""
    lines = table(spark, sf_dir, "benchmark").select(F.col("text").alias("line")).distinct()
    return match.leading_lines(lines, table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
