"""The drop folder as a stream, gated by the collection filter, and the upsert fold as stateful streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from postmill.operators.state import BucketedState

POSTING_CSV = "company string, title string, location string, url string, source string, posted string"
STATE = "company string, title string, source string, url string, rank int, seen_count long"


def inbox_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """New CSV files of a drop folder as rows; the checkpoint of the query replaces emptying the folder."""
    rows = spark.readStream.schema(POSTING_CSV).option("header", True).option("maxFilesPerTrigger", per_trigger).csv(folder)
    return rows.select(*[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in rows.columns]).where("url <> ''")


def ingest(stream: DataFrame, reason: Column, out: str, checkpoint: str):
    """Append the rows that the filter keeps (a null ``reason``) to a Parquet table of sightings; runs over what is there, then stops."""
    kept = stream.where(reason.isNull())
    return kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def folded(stream: DataFrame, kept: BucketedState, checkpoint: str):
    """The upsert fold, salary included, over a stream of sightings: every micro-batch merges into the bucketed state.

    Summaries merge in any order, so late sightings and any split into batches give the state that one fold over all would. A batch that
    is run again after a failure changes nothing that it has changed already. Runs over what is there, then stops.
    """
    return stream.writeStream.foreachBatch(kept.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_state(stream: DataFrame, key: Column, rank: Column) -> DataFrame:
    """The upsert fold over a stream: one updated row for each key that a batch touches.

    First sightings fix company and title; a strictly higher source rank replaces the source, and the url if it has
    one. Rows of a key within one batch count in the order of ``seq``, batches in the order of their arrival: ``folded`` is for
    sightings that may come late.
    """

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        for r in rows.itertuples(index=False):
            if now is None:
                now = [r.company, r.title, r.source, r.url, int(r.rank_), 1]
                continue
            now[5] += 1
            if r.rank_ > now[4]:
                now[2], now[4] = r.source, int(r.rank_)
                now[3] = r.url or now[3]
        state.update(tuple(now))
        yield pd.DataFrame([[k[0], *now]], columns=["id", "company", "title", "source", "url", "rank", "seen_count"])

    rows = stream.withColumn("id", key).withColumn("rank_", F.coalesce(rank, F.lit(0)).cast("int"))
    return rows.select("id", "seq", "company", "title", "source", "url", "rank_").groupBy("id").applyInPandasWithState(fold, f"id string, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, at: str, by: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by source and tumbling window; rows later than the watermark are dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
