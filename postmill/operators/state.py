"""The upsert fold as a summary that merges, kept in buckets of which a batch rewrites only those it touches."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from postmill.session import drop_scratch, exists, materialise


@dataclass(frozen=True)
class Fold:
    """What a fold reads: its key, the order of sightings, a source's rank, and the columns it keeps.

    ``rank`` is a Column over the sightings; null ranks count as 0. ``salary`` names fields that are taken together; the first
    of them says whether a sighting tells a salary.
    """

    key: tuple[str, ...]
    seq: str
    rank: Column
    keep_first: tuple[str, ...] = ()
    source: str = "source"
    url: str | None = "url"
    salary: tuple[str, ...] = field(default_factory=tuple)


def summaries(sightings: DataFrame, f: Fold) -> DataFrame:
    """One row a key: ``first`` sighting, ``steps`` (sightings of higher rank than all before, in order), ``paid`` (first with a salary), ``seen_count``.

    Sightings are first combined by key and rank, before the shuffle, so a key that holds half of all rows reaches its group as a
    few rows a task. Repeated orders of one key count by their values, so the result depends on no row order.
    """
    seq = F.col(f.seq).alias("seq")
    held = lambda names: F.struct(*[F.col(c).alias(c) for c in names]) if names else F.struct(F.lit(0).alias("none"))
    url = F.col(f.url) if f.url and f.url in sightings.columns else F.lit(None).cast("string")
    rows = sightings.select(
        *f.key, F.coalesce(f.rank, F.lit(0)).cast("int").alias("__rank"), F.struct(seq, held([c for c in f.keep_first if c not in f.key]).alias("kept"), held(f.salary).alias("salary")).alias("__first"),
        F.struct(seq, F.coalesce(f.rank, F.lit(0)).cast("int").alias("rank"), F.col(f.source).alias("source"), url.alias("url")).alias("__step"),
        *([F.when(F.col(f.salary[0]).isNotNull(), F.struct(seq, held(f.salary).alias("salary"))).alias("__paid")] if f.salary else []),
    )
    aggs = [F.min("__first").alias("first"), F.min("__step").alias("step"), F.count("*").alias("n")] + ([F.min("__paid").alias("paid")] if f.salary else [])
    by_rank = rows.groupBy(*f.key, "__rank").agg(*aggs)
    out = [F.min("first").alias("first"), _records(F.collect_list("step")).alias("steps"), F.sum("n").alias("seen_count")] + ([F.min("paid").alias("paid")] if f.salary else [])
    return by_rank.groupBy(*f.key).agg(*out)


def _records(steps: Column) -> Column:
    """Of steps in any order, those of higher rank than all before them: as many as there are ranks, at most."""
    ordered = F.array_sort(steps)
    last = lambda acc: F.element_at(acc, -1)["rank"]
    return F.aggregate(F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), F.slice(ordered, 1, 1), lambda acc, x: F.when(x["rank"] > last(acc), F.array_append(acc, x)).otherwise(acc))


def merged(parts: DataFrame, f: Fold) -> DataFrame:
    """Summaries of the same keys as one each. Any grouping and order of the parts gives the same row."""
    aggs = [F.min("first").alias("first"), _records(F.flatten(F.collect_list("steps"))).alias("steps"), F.sum("seen_count").alias("seen_count")]
    return parts.groupBy(*f.key).agg(*aggs, *([F.min("paid").alias("paid")] if f.salary else []))


def folded(summary: DataFrame, f: Fold) -> DataFrame:
    """The state that replaying the sightings one after the other leaves, from their summary."""
    first, steps = F.col("first"), F.col("steps")
    out = [first["kept"][c].alias(c) for c in f.keep_first if c not in f.key] + [F.element_at(steps, -1)["source"].alias(f.source)]
    if f.url:
        linked = F.filter(steps, lambda s: F.coalesce(s["url"], F.lit("")) != "")
        out.append(F.when(F.size(linked) > 0, F.element_at(F.slice(linked, -1, 1), 1)["url"]).otherwise(F.element_at(steps, 1)["url"]).alias(f.url))
    if f.salary:
        out += [F.when(F.col("paid").isNotNull(), F.col("paid")["salary"][c]).otherwise(first["salary"][c]).alias(c) for c in f.salary]
    return summary.select(*f.key, *out, "seen_count")


class BucketedState:
    """Summaries in ``<path>/bucket=<n>``. A batch rewrites the buckets that its keys fall into; all other files stay.

    Every bucket carries the number of the last batch that it took. A batch that was cut short can be applied again: buckets that have
    it already stay as they are. Batches are numbered upwards; the sightings in them may come in any order of ``seq``.
    """

    def __init__(self, spark: SparkSession, path: str, fold: Fold, buckets: int = 256) -> None:
        self.spark, self.path, self.fold, self.buckets = spark, path.rstrip("/"), fold, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.fold.key), F.lit(self.buckets)).cast("int")

    def _stored(self, schema: ST.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path)

    def apply(self, sightings: DataFrame, batch: int) -> list[int]:
        """Merge a batch's sightings; the buckets that were rewritten.

        The batch is summarised first, so what is joined to the state is a row a key. Only the touched buckets' files are read
        (partition pruning), merged by one shuffle and written back by a dynamic overwrite; the merged rows lie in the
        shared scratch folder before, so the overwrite doesn't read what it replaces.
        """
        new, new_path = materialise(summaries(sightings, self.fold).withColumn("bucket", self._bucket()), "batch")
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # as many as there are buckets, at most
        if exists(self.spark, self.path):
            schema = ST.StructType([f for f in new.schema if f.name != "bucket"]).add("batch", ST.LongType()).add("bucket", ST.IntegerType())
            old = self._stored(schema).where(F.col("bucket").isin(touched))
            done = [r["bucket"] for r in old.groupBy("bucket").agg(F.max("batch").alias("batch")).where(F.col("batch") >= batch).collect()]
            touched = [b for b in touched if b not in set(done)]
            parts = old.drop("batch").where(F.col("bucket").isin(touched)).unionByName(new.where(F.col("bucket").isin(touched)))
            whole = merged(parts, self.fold).withColumn("bucket", self._bucket())
        else:
            whole = new
        if touched:
            rows, rows_path = materialise(whole.withColumn("batch", F.lit(batch).cast("long")).hint("rebalance", "bucket"), "merged")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
            drop_scratch(self.spark, rows_path)
        drop_scratch(self.spark, new_path)
        return sorted(touched)

    def read(self) -> DataFrame:
        """The folded state of all buckets."""
        return folded(self.spark.read.parquet(self.path), self.fold)
