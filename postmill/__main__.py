"""Command line: ``python -m postmill COMMAND --help``. Every command reads tables, runs one job and writes tables."""

from __future__ import annotations

import argparse
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.functions import text as T
from postmill.functions import udfs
from postmill.operators import dedupe, filters, fold, health, match
from postmill.operators.score import explained
from postmill.plans import ranking, report
from postmill.session import exists
from postmill.sources import registry_tables, settings

STATUSES = ("new", "applied", "ignored", "interviewing", "rejected", "offer")
MOST_FAILED = 4


def rules_at(spark: SparkSession, path: str | None) -> dict:
    return settings.load_rules("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())) if path else {}


def validate(spark: SparkSession, a: argparse.Namespace) -> int:
    """Say what is wrong with rule files and the registry; the exit code counts it."""
    scoring, collection = rules_at(spark, a.scoring), rules_at(spark, a.collection)
    wrong = settings.scoring_problems(scoring) + settings.pattern_problems(scoring) + settings.pattern_problems(collection)
    wrong += [] if wrong else settings.collection_of(collection, written=True).problems(a.keep, a.drop)
    if a.registry:
        columns = ["name", "category", "domain"]
        there = spark.read.option("header", True).csv(a.registry).columns
        wrong += [f"the registry lacks the column {c}" for c in columns if c not in there]
        firms = registry_tables.read_csv(spark, a.registry, columns)
        wrong += [f"name {r['name']} stands {r.n} times" for r in registry_tables.repeated_names(firms).orderBy("name").toLocalIterator()]
        shared = registry_tables.shared_domains(firms)
        claims = shared.orderBy("domain")
        wrong += [f"domain {r.domain} is claimed by {r.names} names" for r in claims.toLocalIterator()]
    print("\n".join(wrong) or "all well")
    return min(len(wrong), 100)


def ingest(spark: SparkSession, a: argparse.Namespace) -> int:
    """Append a drop folder's well-formed postings that the collection filter keeps to the sightings, and count what went where.

    All counts are observed on the one job that writes.
    """
    rules = settings.collection_of(rules_at(spark, a.collection))
    rows = registry_tables.inbox(spark, a.inbox)
    rows = rows.withColumns({c: udfs.clean_text(c) for c in ("company", "title", "location")})
    reason = F.coalesce(filters.invalid_reason(), rules.verdict(F.col("title"), F.col("location")))
    rows = rows.withColumn("why", reason).withColumn("id", T.canonical_key("company", "title"))
    if exists(spark, a.sightings):
        known = spark.read.parquet(a.sightings).select("id").distinct().withColumn("known", F.lit(True))
        rows = rows.join(known, "id", "left")
    else:
        rows = rows.withColumn("known", F.lit(None).cast("boolean"))
    fresh = F.row_number().over(Window.partitionBy("id", F.col("why").isNull()).orderBy("url")) == 1
    rows = rows.withColumn("new", F.col("why").isNull() & F.col("known").isNull() & fresh)
    rows, counts = report.observed(rows, {"raw": F.lit(True), "matched": F.col("why").isNull(), "new": F.col("new"), **{w: F.col("why") == w for w in filters.REASONS}})
    band = T.stated_salary(F.col("salary_min").try_cast("double"), F.col("salary_max").try_cast("double"), "currency", "salary_text")
    kept = rows.where("why is null").select("id", "company", "title", "location", F.trim("url").alias("url"), "source", "posted", F.lit(a.as_of).alias("first_seen"), band["lo"].alias("salary_min"), band["hi"].alias("salary_max"), band["currency"].alias("currency"))
    kept.write.mode("append").parquet(a.sightings)
    for name, n in counts.get.items():
        if n or name in ("raw", "matched", "new"):
            print(f"{name}: {n}")
    return 0


def rank(spark: SparkSession, a: argparse.Namespace) -> int:
    """Rank sightings into a digest, a scored CSV and, if asked, a recorded run."""
    scoring, collection = rules_at(spark, a.scoring), rules_at(spark, a.collection)
    postings = ranking.state_of(spark.read.parquet(a.sightings))
    state = fold.with_status(postings, spark.read.parquet(a.statuses)) if a.statuses else postings
    seniority, said = scoring.get("seniority") or {}, scoring.get("report") or {}
    since = report.last_run(spark.read.parquet(a.runs)) if a.new_only and a.runs else None
    d = ranking.Digest(
        a.top or said.get("top_n", 60), said.get("min_score", 0), said.get("shortlist_threshold", 60), said.get("max_per_firm", 3), since, said.get("backfill_to", 0), a.include_unverified, None,
        settings.collection_of(collection) if collection else None, seniority.get("exclude_over_years"), (scoring.get("verification") or {}).get("exclude_days_open"),
    )
    categories = registry_tables.categories(registry_tables.read_csv(spark, a.registry, ["name", "category", "domain"]).withColumn("seq", F.monotonically_increasing_id())) if a.registry else None
    checks = spark.read.parquet(a.checks) if a.checks else None
    digest, kept, cuts = ranking.rank_postings(state, checks, categories, settings.rubric_of(scoring, collection), a.as_of, ranking.everything(d) if a.everything else d)
    digest.withColumn("why", explained(F.col("why"))).write.mode("overwrite").parquet(f"{a.out}/digest")
    report.write_scored(kept.orderBy(F.desc("score"), "id"), f"{a.out}/scored")
    cuts.write.mode("overwrite").parquet(f"{a.out}/cuts")
    if a.record and a.runs and a.failed_stages <= MOST_FAILED:  # after a broken run the next one must still see this one's postings
        report.record_run(spark, a.runs, a.as_of, state.count(), kept.count())
    return 0


def apply_list(spark: SparkSession, a: argparse.Namespace) -> int:
    """The scored CSV without links, brokers and stale rows, in bands."""
    rows = spark.read.option("header", True).csv(a.scored).withColumn("score", F.coalesce(F.col("score").try_cast("double").cast("int"), F.lit(0)))
    rows = filters.apply_list(rows.withColumn("seq", F.monotonically_increasing_id()), "seq", a.max_age, a.keep_brokers, a.hide_recruiters)
    rows.where("cut is null").orderBy(F.desc("score"), "seq").drop("seq", "cut").write.mode("overwrite").option("header", True).csv(a.out)
    return 0


def matches(spark: SparkSession, a: argparse.Namespace) -> int:
    """Descriptions by their likeness to one text."""
    docs = spark.read.parquet(a.checks).select("id", F.col("description").alias("text"))
    scored = match.relative_scores(match.tfidf_cosine(docs, "id", spark.read.text(a.text, wholetext=True).withColumnRenamed("value", "text")))
    scored.where(F.col("relative") >= a.min_score).orderBy(F.desc("cosine"), "id").limit(a.top).write.mode("overwrite").parquet(a.out)
    return 0


def track(spark: SparkSession, a: argparse.Namespace) -> int:
    """Set the status of the postings that hold every term; without terms, count the statuses."""
    seen = spark.read.parquet(a.sightings).groupBy("id").agg(F.min("company").alias("company"), F.min("title").alias("title"))
    if a.terms:
        found = seen.where(filters.all_terms(a.terms, "company", "title")).select("id", F.lit("new" if a.status == "reopen" else a.status).alias("status"), F.lit(a.as_of).alias("seq"))
        found.write.mode("append").parquet(a.statuses)
    else:
        fold.with_status(seen, spark.read.parquet(a.statuses)).groupBy("status").agg(F.count("*").alias("n")).orderBy(F.desc("n")).show()
    return 0


def insights(spark: SparkSession, a: argparse.Namespace) -> int:
    """Who hires, who posts again and again, and how long all this was watched."""
    seen = spark.read.parquet(a.sightings).withColumn("at", F.col("first_seen").try_cast("timestamp"))
    health.velocity(seen, F.col("company"), "at").show(truncate=False)
    ghosts: DataFrame = dedupe.reposted(seen, [T.norm("company"), T.norm("title")], "at")
    ghosts.groupBy("company", "title").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "company", "title").limit(20).show(truncate=False)
    health.observed_weeks(seen, "at").show()
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="postmill", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    now = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")

    def command(name, run, *needed, flags=(), **optional):
        p = commands.add_parser(name, help=run.__doc__)
        p.set_defaults(run=run)
        p.add_argument("--as-of", default=now)
        for n in needed:
            p.add_argument(f"--{n}", required=True)
        for n, default in optional.items():
            p.add_argument(f"--{n.replace('_', '-')}", default=default, type=int if isinstance(default, int) else str)
        for n in flags:
            p.add_argument(f"--{n}", action="store_true")
        return p

    p = command("validate", validate, scoring=None, collection=None, registry=None)
    p.add_argument("--keep", nargs="*", default=[])
    p.add_argument("--drop", nargs="*", default=[])
    command("ingest", ingest, "inbox", "sightings", "collection")
    command("rank", rank, "sightings", "scoring", "out", collection=None, registry=None, checks=None, statuses=None, runs=None, top=0, failed_stages=0, flags=("new-only", "record", "everything", "include-unverified"))
    command("apply-list", apply_list, "scored", "out", max_age=45, flags=("keep-brokers", "hide-recruiters"))
    command("match", matches, "checks", "text", "out", top=20, min_score=0)
    p = command("track", track, "sightings", "statuses")
    p.add_argument("status", choices=(*STATUSES, "reopen", "stats"))
    p.add_argument("terms", nargs="*")
    command("insights", insights, "sightings")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(spark or SparkSession.builder.appName("postmill").getOrCreate(), a)


if __name__ == "__main__":
    raise SystemExit(main())
