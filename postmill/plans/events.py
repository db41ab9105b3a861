"""Queries over events: an append-only table of sightings by user and type."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.functions import dates
from postmill.operators import dedupe, fold, health, state
from postmill.plans.registry import query
from postmill.session import scratch_root
from postmill.sources.tables import table

AS_OF = "2024-01-31 00:00:00"
RANKS = {"purchase": 10, "signup": 9, "click": 4, "view": 2, "error": 0}


def rank_of():
    return F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in RANKS.items()])


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sightings: eight slots of a user make the keys, the type is the source, values below 20 mean no salary."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat_ws("-", "user_id", (F.col("event_id") % 8).cast("string")).alias("id"), "event_id", F.col("event_type").alias("source"), F.col("event_type"),
        F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("https://x.example/"), F.col("event_id").cast("string"))).alias("url"),
        F.when(F.col("value") >= 20, F.col("value")).alias("salary_min"), (F.col("value") * 2).alias("salary_max"), F.col("ts").alias("first_seen"),
    )


_FOLDED = """WITH s AS (SELECT user_id || '-' || (event_id % 8) AS id, event_id, event_type AS source, CASE event_type WHEN 'purchase' THEN 10 WHEN 'signup' THEN 9 WHEN 'click' THEN 4 WHEN 'view' THEN 2 ELSE 0 END AS r,
        CASE WHEN event_id % 3 = 0 THEN '' ELSE 'https://x.example/' || event_id END AS url, CASE WHEN value >= 20 THEN value END AS lo, value * 2 AS hi, ts FROM events),
    b AS (SELECT *, max(r) OVER (PARTITION BY id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM s),
    u AS (SELECT *, best IS NULL OR r > best AS up FROM b)
    SELECT id, strftime(min(ts), '%Y-%m-%d') AS first_day, arg_max(source, event_id) FILTER (WHERE up) AS source,
        coalesce(arg_max(url, event_id) FILTER (WHERE up AND url <> ''), arg_min(url, event_id)) AS url, count(*) AS seen_count,
        arg_min(lo, event_id) FILTER (WHERE lo IS NOT NULL) AS salary_min,
        coalesce(arg_min(hi, event_id) FILTER (WHERE lo IS NOT NULL), arg_min(hi, event_id)) AS salary_max FROM u GROUP BY id"""


@query(_FOLDED)
def upsert_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fold.upsert_fold(sightings(spark, sf_dir), ["id"], "event_id", rank_of(), ["first_seen"], salary=["salary_min", "salary_max"])
    return found.select("id", F.date_format("first_seen", "yyyy-MM-dd").alias("first_day"), "source", "url", "seen_count", "salary_min", "salary_max")


@query(_FOLDED)
def incremental_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same state by batches: events of three spans of days, the last first, each merged into the buckets that it touches."""
    f = state.Fold(("id",), "event_id", rank_of(), ("first_seen",), salary=("salary_min", "salary_max"))
    rows = sightings(spark, sf_dir)
    kept = state.BucketedState(spark, f"{scratch_root(spark)}/postmill/state-{uuid.uuid4().hex}", f, buckets=16)
    ends = ["2024-01-10", "2024-01-20", None]
    since = lambda day: F.lit(True) if day is None else F.col("first_seen") >= F.lit(day).cast("timestamp")
    for batch, (start, end) in enumerate(reversed(list(zip([None, *ends], ends)))):
        kept.apply(rows.where(since(start) & (F.lit(True) if end is None else ~since(end))), batch)
    return kept.read().select("id", F.date_format("first_seen", "yyyy-MM-dd").alias("first_day"), "source", "url", "seen_count", "salary_min", "salary_max")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.latest_per_key(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id"], ["event_id"])


@query("""WITH c AS (SELECT user_id AS id, arg_max(event_type, event_id) AS status FROM events WHERE event_type <> 'view' GROUP BY user_id)
    SELECT u.id, coalesce(c.status, 'new') AS status FROM (SELECT DISTINCT user_id AS id FROM events) u LEFT JOIN c USING (id)""")
def status_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    changes = e.where("event_type <> 'view'").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.col("event_id").alias("seq"))
    return fold.with_status(e.select(F.col("user_id").alias("id")).distinct(), changes)


@query("""WITH g AS (SELECT user_id, event_type FROM events GROUP BY ALL HAVING count(*) >= 3 AND floor((max(epoch(ts)) - min(epoch(ts))) / 86400) >= 20)
    SELECT event_id FROM events JOIN g USING (user_id, event_type)""")
def ghost_reposts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return dedupe.reposted(e, [F.col("user_id"), F.col("event_type")], "ts", 3, 20).select("event_id")


@query("""WITH e AS (SELECT * FROM (VALUES ('click', NULL), ('view', NULL), ('signup', NULL), ('purchase', NULL), ('error', 'no key'), ('refund', NULL), ('import', 'no key'), ('mirror', 'known broken'), ('partner', 'not run here')) AS v(source, known)),
    n AS (SELECT CASE WHEN event_type = 'view' AND ts > TIMESTAMP '2024-01-24' THEN 'view late' WHEN event_type = 'signup' AND ts > TIMESTAMP '2024-01-24' AND event_id % 8 <> 0 THEN 'signup rest' WHEN event_type = 'click' AND event_id % 1500 = 0 AND ts <= TIMESTAMP '2024-01-24' THEN 'rare' ELSE event_type END AS source, ts FROM events),
    c AS (SELECT source, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-24') AS week, count(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-24' AND ts > TIMESTAMP '2023-12-27') / 4 AS usual FROM n GROUP BY source)
    SELECT source, coalesce(week, 0) AS week, round(coalesce(usual, 0), 4) AS usual, CASE WHEN usual IS NULL THEN coalesce(known, 'never seen') WHEN usual >= 2 AND week = 0 THEN 'silent'
        WHEN usual >= 5 AND week < usual * 0.3 THEN 'falling' ELSE 'ok' END AS health FROM e FULL JOIN c USING (source)""")
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of every state: event types, some of whose last week goes under other names, and four that never brought anything."""
    known = [("click", None), ("view", None), ("signup", None), ("purchase", None), ("error", "no key"), ("refund", None), ("import", "no key"), ("mirror", "known broken"), ("partner", "not run here")]
    t, e = F.col("ts").cast("timestamp"), table(spark, sf_dir, "events")
    late = t > F.lit("2024-01-24").cast("timestamp")
    name = (
        F.when((F.col("event_type") == "view") & late, "view late").when((F.col("event_type") == "signup") & late & (F.col("event_id") % 8 != 0), "signup rest")
        .when((F.col("event_type") == "click") & (F.col("event_id") % 1500 == 0) & ~late, "rare").otherwise(F.col("event_type"))
    )
    return health.source_health(e.select(name.alias("source"), t.alias("first_seen")), spark.createDataFrame(known, "source string, known string"), AS_OF)


@query("""WITH o AS (SELECT *, event_type = 'error' AS miss FROM events),
    i AS (SELECT *, sum(CASE WHEN miss THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM o)
    SELECT event_id, CAST(sum(CASE WHEN miss THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY event_id) AS BIGINT) AS misses FROM i""")
def miss_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return fold.miss_streaks(e, "user_id", "event_id", F.col("event_type") == "error").select("event_id", "misses")


@query("""WITH o AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)
    SELECT event_id, n * 3600000 + max(a - n * 3600000) OVER (PARTITION BY user_id ORDER BY n) AS start_ms FROM o""")
def throttle_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return fold.throttled(e, "user_id", F.unix_millis(F.col("ts").cast("timestamp")), ["ts", "event_id"], 3_600_000).select("event_id", "start_ms")


@query("""WITH RECURSIVE o AS (SELECT user_id AS host, epoch_us(ts) / 1e6 AS t, event_type IN ('view', 'click') AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type IN ('view', 'click'), event_id) AS n FROM events),
    w AS (SELECT host, n, t, ok, CASE WHEN ok THEN 'ok' ELSE 'failed' END AS state, CASE WHEN ok THEN 0 ELSE 1 END AS streak, CAST(-1 AS DOUBLE) AS until FROM o WHERE n = 1
        UNION ALL SELECT o.host, o.n, o.t, o.ok, CASE WHEN o.t < w.until THEN 'skipped' WHEN o.ok THEN 'ok' ELSE 'failed' END,
            CASE WHEN o.t < w.until THEN w.streak WHEN o.ok THEN 0 WHEN w.streak + 1 >= 3 THEN 0 ELSE w.streak + 1 END, CASE WHEN o.t >= w.until AND NOT o.ok AND w.streak + 1 >= 3 THEN o.t + 86400 ELSE w.until END
        FROM w JOIN o ON o.host = w.host AND o.n = w.n + 1)
    SELECT host, t AS "at", ok, state FROM w""")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("host"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at"), F.col("event_type").isin("view", "click").alias("ok"))
    return fold.circuit_breaker(e.withColumn("at", F.col("at") / 1e6), failures=3, cool_down=86400.0)


@query("""SELECT event_id, CAST(floor((epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts))) / 86400) AS BIGINT) AS days,
    CASE WHEN floor((epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts))) / 86400) <= 3 THEN 20 WHEN floor((epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts))) / 86400) <= 7 THEN 12
        WHEN floor((epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts))) / 86400) <= 14 THEN 5 WHEN floor((epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts))) / 86400) <= 30 THEN 0 END AS points FROM events""")
def days_since_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = dates.days_since(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(AS_OF))
    return table(spark, sf_dir, "events").select("event_id", age.alias("days"), dates.stepped(age, [(3, 20), (7, 12), (14, 5), (30, 0)]).alias("points"))


@query("""WITH f AS (SELECT event_id, ts, ts > TIMESTAMP '2024-01-30 12:00:00' AS fresh FROM events),
    n AS (SELECT count(*) AS have FROM f WHERE fresh), o AS (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS k FROM f WHERE NOT fresh)
    SELECT event_id, false AS carried_over FROM f WHERE fresh UNION ALL SELECT event_id, true FROM o, n WHERE k <= 500 - have""")
def backfill_topup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    return dedupe.backfilled(e, F.col("ts").cast("timestamp") > F.lit("2024-01-30 12:00:00").cast("timestamp"), 500, [F.desc("ts"), "event_id"]).select("event_id", "carried_over")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50 AS high FROM events WHERE json_valid(props)")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "events").withColumn("v", F.try_parse_json("props")).where("v is not null")
    k = F.try_variant_get("v", "$.k", "bigint")
    return v.select("event_id", k.alias("k"), (k >= 50).alias("high"))


@query("""SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def daily_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH s AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
    SELECT user_id, event_id, k FROM s WHERE k <= 5""")
def keep_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).alias("k")).where("k <= 5")
