"""Readers for the star-schema and document tables laid out as ``<dir>/<name>.parquet``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder; the path may be in any store Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a scan with fewer splits than the session has cores, dealt to all of them; a larger table's scan stays as it is.

    A small table of one row group is read by one task, which then does all work up to the first shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
