"""Queries over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import text as T
from postmill.operators import dedupe, filters, fold, health
from postmill.plans.registry import query
from postmill.sources import registry_tables
from postmill.sources.tables import table

RULES = filters.CollectionRules(
    include=["small ring"], roles=["bolt", "ring", "widget"], domains=["red", "blue", "green", "ring"], exclude=["large", "small", "ring"], rank_words=["large", "small"], junior=["blue"],
)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")


_MATCH = "(regexp_matches(p_name, '(?i)small ring') OR (regexp_matches(p_name, '(?i)bolt|ring|widget') AND regexp_matches(p_name, '(?i)red|blue|green|ring') AND NOT (instr(p_name, regexp_extract(p_name, '(?i)bolt|ring|widget')) = instr(p_name, regexp_extract(p_name, '(?i)red|blue|green|ring')) AND len(regexp_extract(p_name, '(?i)bolt|ring|widget')) = len(regexp_extract(p_name, '(?i)red|blue|green|ring')))))"
_EXCLUDED = "(regexp_matches(p_name, '(?i)large|small|ring') AND NOT (regexp_matches(p_name, '(?i)blue') AND regexp_matches(regexp_extract(p_name, '(?i)large|small|ring'), '(?i)^(?:large|small)$')))"


@query(f"SELECT p_partkey, p_name FROM part WHERE {_MATCH}")
def pair_match_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).where(RULES.matches(F.col("p_name"))).select("p_partkey", "p_name")


@query(f"SELECT p_partkey, {_EXCLUDED} AS excluded FROM part")
def exclude_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("p_partkey", RULES.excluded(F.col("p_name")).alias("excluded"))


@query(f"""WITH j AS (SELECT p_partkey, p_name, CASE WHEN NOT {_MATCH} THEN 'no match' WHEN {_EXCLUDED} THEN 'excluded word' END AS why FROM part)
    SELECT p_name, count(*) AS n, arg_min(why, p_partkey) AS reason FROM j WHERE why IS NOT NULL AND p_name NOT IN (SELECT p_name FROM j WHERE why IS NULL) GROUP BY p_name""")
def reject_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.reject_audit(parts(spark, sf_dir), "p_name", RULES.verdict(F.col("p_name"), F.lit("")), "p_partkey")


@query("""SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red') AND (contains(lower(p_name), 'bolt') OR contains(lower(p_type), 'bolt'))""")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).where(filters.all_terms(["red"], "p_name") & filters.all_terms(["bolt"], "p_name", "p_type")).select("p_partkey")


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3""")
def cap_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return dedupe.cap_per_group(o, ["o_custkey"], 3, [F.desc("o_totalprice"), "o_orderkey"])


@query("""SELECT c_custkey, coalesce(r_name, 'unknown') AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20 LEFT JOIN region ON n_regionkey = r_regionkey""")
def dimension_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("r_regionkey"))
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return customers.join(nation, "c_nationkey", "left").join(region, "r_regionkey", "left").select("c_custkey", F.coalesce("r_name", F.lit("unknown")).alias("region"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_returnflag = 'R')")
def semi_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").where("l_quantity >= 50 and l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").join(used, "s_suppkey", "left_semi")


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2001-06-01").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("""SELECT r_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def revenue_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    o, c = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""WITH g AS (SELECT o_custkey AS grp, count(*) AS n, CAST(floor((max(epoch(o_orderdate)) - min(epoch(o_orderdate))) / 86400) AS BIGINT) AS spread FROM orders GROUP BY o_custkey)
    SELECT grp, n, spread, CASE WHEN spread > 14 THEN 'continuous' ELSE 'burst' END AS kind FROM g ORDER BY n DESC, spread DESC, grp LIMIT 18""")
def hiring_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    return health.velocity(o, F.col("o_custkey"), "at")


@query("SELECT CAST(greatest(1, floor((max(epoch(o_orderdate)) - min(epoch(o_orderdate))) / 86400 / 7)) AS BIGINT) AS weeks FROM orders")
def observed_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.observed_weeks(table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp").alias("at")), "at")


@query("""WITH s AS (SELECT o_orderpriority, list_sort(list(o_totalprice)) AS v FROM orders GROUP BY o_orderpriority)
    SELECT o_orderpriority, len(v) AS n, v[1] AS lo, v[len(v)] AS hi, v[least(len(v) - 1, CAST(floor(len(v) * 0.25) AS BIGINT)) + 1] AS p25, v[least(len(v) - 1, CAST(floor(len(v) * 0.5) AS BIGINT)) + 1] AS p50,
        v[least(len(v) - 1, CAST(floor(len(v) * 0.9) AS BIGINT)) + 1] AS p90 FROM s""")
def index_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.index_percentiles(table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice"), "o_totalprice", (0.25, 0.5, 0.9), ["o_orderpriority"])


@query("""SELECT 'all' AS stage, count(*) AS n FROM orders UNION ALL SELECT 'open', count(*) FILTER (WHERE o_orderstatus = 'O') FROM orders
    UNION ALL SELECT 'large', count(*) FILTER (WHERE o_orderstatus = 'O' AND o_totalprice > 250000) FROM orders""")
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_open = F.col("o_orderstatus") == "O"
    return health.funnel(table(spark, sf_dir, "orders"), {"all": F.lit(True), "open": is_open, "large": is_open & (F.col("o_totalprice") > 250000)})


@query("SELECT split_part(o_orderpriority, '-', 1) AS reason, count(*) AS n FROM orders GROUP BY ALL")
def reason_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.reason_counts(table(spark, sf_dir, "orders").select(F.regexp_replace("o_orderpriority", "-", ":").alias("why")), "why")


@query("""WITH f AS (SELECT DISTINCT p_name, split_part(p_name, ' ', 1) AS first FROM part) SELECT first, count(*) AS n FROM f GROUP BY first HAVING count(*) > 1""")
def ambiguous_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(T.norm("p_name").alias("name")).distinct()
    return names.groupBy(F.element_at(F.split("name", " "), 1).alias("first")).agg(F.count("*").alias("n")).where("n > 1")


@query("""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS total FROM orders)
    SELECT o_orderkey FROM o WHERE k IN (SELECT CAST(floor(i * (SELECT max(total) FROM o) / 37) AS BIGINT) FROM range(37) AS t(i))""")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.even_sample(table(spark, sf_dir, "orders").select("o_orderkey"), 37, "o_orderkey")


@query("""WITH u AS (SELECT 'a' AS src, c_custkey AS ord, lower(substr(c_name, 1, 8) || (c_custkey % 50)) AS k FROM customer UNION ALL SELECT 'b', s_suppkey, lower('Customer' || (s_suppkey % 70)) FROM supplier),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY src, ord) AS n FROM u) SELECT src, ord, k FROM r WHERE n = 1""")
def source_union_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.lit("a").alias("src"), F.col("c_custkey").alias("ord"), F.lower(F.concat(F.substring("c_name", 1, 8), (F.col("c_custkey") % 50).cast("string"))).alias("k"))
    b = table(spark, sf_dir, "supplier").select(F.lit("b").alias("src"), F.col("s_suppkey").alias("ord"), F.lower(F.concat(F.lit("Customer"), (F.col("s_suppkey") % 70).cast("string"))).alias("k"))
    return fold.first_per_key(a.unionByName(b), ["k"], ["src", "ord"])


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def name_set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 1000)")
def name_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 1000").select(F.col("c_custkey").alias("k"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct().join(rich, "k", "left_anti")


@query("""WITH f AS (SELECT DISTINCT o_custkey % 40 AS firm, o_orderkey % 14 AS provider, o_orderkey % 5 AS token, CAST(o_totalprice AS BIGINT) % 3 AS n FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY firm ORDER BY token, provider, n) AS k FROM f WHERE n > 0) SELECT firm, provider, token FROM r WHERE k = 1""")
def first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered trials of tokens with providers: the first that returned anything."""
    o = table(spark, sf_dir, "orders")
    tries = o.select((F.col("o_custkey") % 40).alias("firm"), (F.col("o_orderkey") % 14).alias("provider"), (F.col("o_orderkey") % 5).alias("token"), (F.bround("o_totalprice", 0).cast("long") % 3).alias("n")).where("n > 0")
    return fold.first_per_key(tries, ["firm"], ["token", "provider", "n"]).select("firm", "provider", "token")


@query("SELECT lower(c_mktsegment) AS domain, count(*) AS n, count(DISTINCT c_nationkey) AS names FROM customer GROUP BY ALL HAVING count(DISTINCT c_nationkey) > 1")
def shared_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry_tables.shared_domains(table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("name"), F.col("c_mktsegment").alias("domain")))


@query("""SELECT * FROM (VALUES (1, 'Supplier#000000001', 'name taken'), (2, 'Fresh', 'domain taken'), (3, 'Fresh', 'accepted'), (4, 'Other', 'domain taken'), (5, 'Blank', 'accepted'), (6, 'Blank Two', 'accepted'), (7, 'fresh', 'name taken')) AS v(seq, name, verdict)""")
def add_registry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".example")).alias("domain"))
    rows = [(1, "Supplier#000000001", "new.example"), (2, "Fresh", "s2.example"), (3, "Fresh", "fresh.example"), (4, "Other", "fresh.example"), (5, "Blank", ""), (6, "Blank Two", ""), (7, "fresh", "x.example")]
    return fold.accept_new(existing, spark.createDataFrame([(a, b, "x", c) for a, b, c in rows], "seq long, name string, category string, domain string"))


@query("""WITH RECURSIVE c AS (
        SELECT c_custkey AS seq, 'Firm ' || ((c_custkey * 37) % 700) AS name, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'd' || ((c_custkey * 53 + c_nationkey) % 600) || '.example' END AS domain, row_number() OVER (ORDER BY c_custkey) AS k FROM customer),
    w AS (
        SELECT CAST(0 AS BIGINT) AS k, (SELECT list(DISTINCT 'firm ' || ((s_suppkey * 11) % 90)) FROM supplier) AS names, (SELECT list(DISTINCT 'd' || ((s_suppkey * 29) % 500) || '.example') FROM supplier) AS domains, CAST(NULL AS VARCHAR) AS verdict
        UNION ALL SELECT j.k, CASE WHEN j.verdict = 'accepted' THEN list_append(j.names, lower(j.name)) ELSE j.names END, CASE WHEN j.verdict = 'accepted' AND j.domain <> '' THEN list_append(j.domains, j.domain) ELSE j.domains END, j.verdict FROM (
            SELECT c.k, c.name, c.domain, w.names, w.domains, CASE WHEN list_contains(w.names, lower(c.name)) THEN 'name taken' WHEN c.domain <> '' AND list_contains(w.domains, c.domain) THEN 'domain taken' ELSE 'accepted' END AS verdict
            FROM w JOIN c ON c.k = w.k + 1) j)
    SELECT seq, name, verdict FROM w JOIN c USING (k)""")
def registry_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as candidates for a registry of suppliers, each judged after those before it."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    existing = s.select(text("FIRM ", (F.col("s_suppkey") * 11) % 90).alias("name"), text("D", (F.col("s_suppkey") * 29) % 500, ".example").alias("domain"))
    domain = F.when(F.col("c_custkey") % 9 == 0, "").otherwise(text("d", (F.col("c_custkey") * 53 + F.col("c_nationkey")) % 600, ".example"))
    return fold.accept_new(existing, c.select(F.col("c_custkey").alias("seq"), text("Firm ", (F.col("c_custkey") * 37) % 700).alias("name"), F.lit("x").alias("category"), domain.alias("domain")))


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE 'firm ' || s_suppkey = 'firm ' || (c_custkey % 400))""")
def unanswered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without an answer; the answers are written in capitals and with accents, which the comparison looks past."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(" firm "), (F.col("c_custkey") % 400).cast("string")).alias("name"))
    done = table(spark, sf_dir, "supplier").select(F.concat(F.lit("F\u00cdRM "), F.col("s_suppkey").cast("string")).alias("name"))
    return registry_tables.unanswered(c, done).select("c_custkey")
