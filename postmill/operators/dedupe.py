"""Collapsing rows that are one posting, capping groups, ranking and cutting into sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions import text as T
from postmill.functions.web import url_key
from postmill.session import materialise


def url_collapse(rows: DataFrame, url: str = "url", score: str = "score", seq: str = "seq") -> DataFrame:
    """The best row of each URL; rows without one all stay, each a group of its own, so the rows are made once."""
    key = F.coalesce(F.nullif(url_key(F.col(url)), F.lit("")), F.concat(F.lit("\n"), F.col(seq).cast("string")))
    w = Window.partitionBy("__u").orderBy(F.desc(score), seq)
    return rows.withColumn("__u", key).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__u")


def description_collapse(rows: DataFrame, company: str, title: str, description: str, score: str = "score", seq: str = "seq", least: int = 400) -> DataFrame:
    """Without rows that repeat the best row of their firm and description under a title that contains, or lies in, its title.

    Short descriptions have no fingerprint and are never merged: each is a group of its own. One window, so the rows and
    their scores are made once.
    """
    key = F.coalesce(T.fingerprint(description, least), F.concat(F.lit("\n"), F.col(seq).cast("string")))
    keyed = rows.withColumns({"__c": T.norm(company), "__fp": key, "__t": F.array_distinct(F.split(T.norm(title), " "))})
    w = Window.partitionBy("__c", "__fp").orderBy(F.desc(score), seq)
    full = keyed.withColumns({"__n": F.row_number().over(w), "__keep": F.first("__t").over(w)})
    return full.where((F.col("__n") == 1) | ~T.either_contains(F.col("__t"), F.col("__keep"))).drop("__n", "__keep", "__c", "__fp", "__t")


def cap_per_group(rows: DataFrame, group: list[Column | str], cap: int | None, order: list[Column | str]) -> DataFrame:
    """At most ``cap`` rows of each group, best first; no cap, no change. Spark prunes by rank before the shuffle."""
    if not cap:
        return rows
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= cap).drop("__n")


def two_sections(rows: DataFrame, group: Column | str, threshold: int, least: int, cap: int, top: int, key: str = "id", score: str = "score", seq: str = "seq") -> DataFrame:
    """``shortlist``: rows from the threshold, capped by group, best ``top``; ``rest``: others from ``least``, best ``top``."""
    order = [F.desc(score), seq]
    rows, _ = materialise(rows, "sections")  # read three times
    short = cap_per_group(rows.where(F.col(score) >= threshold), [group], cap, order).orderBy(*order).limit(top).withColumn("section", F.lit("shortlist"))
    rest = rows.where(F.col(score) >= least).join(short.select(key), key, "left_anti").orderBy(*order).limit(top).withColumn("section", F.lit("rest"))
    return short.unionByName(rest)


def backfilled(rows: DataFrame, fresh: Column, floor: int, order: list[Column | str]) -> DataFrame:
    """Fresh rows; if fewer than ``floor``, older ones in order up to it, marked ``carried_over``."""
    new = rows.where(fresh).withColumn("carried_over", F.lit(False))
    have = new.limit(floor).count()
    if have >= floor:
        return new
    older = rows.where(~fresh).orderBy(*order).limit(floor - have).withColumn("carried_over", F.lit(True))
    return new.unionByName(older)


def reposted(sightings: DataFrame, group: list[Column], at: str, least: int = 3, days: int = 60) -> DataFrame:
    """All sightings of groups seen at least ``least`` times over at least ``days`` days.

    Groups are found by aggregation, which combines before the shuffle; rows then meet them in a join, whose hot
    keys Spark can split.
    """
    names = [f"__g{i}" for i in range(len(group))]
    keyed = sightings.withColumns(dict(zip(names, group)))
    span = F.floor((F.max(F.unix_timestamp(at)) - F.min(F.unix_timestamp(at))) / 86400)
    groups = keyed.groupBy(*names).agg(F.count("*").alias("__n"), span.alias("__d")).where((F.col("__n") >= least) & (F.col("__d") >= days))
    return keyed.join(groups.select(*names), names, "left_semi").drop(*names)


def even_sample(rows: DataFrame, n: int, order: str) -> DataFrame:
    """``n`` evenly spaced rows in an order: positions int(i * total / n).

    Positions come from counts by range partition, so no task sees all rows.
    """
    # range bounds are sampled anew on every run, so counts and positions must come from one written table
    ranged, _ = materialise(rows.repartitionByRange(order).withColumn("__p", F.spark_partition_id()), "ranged")
    sizes = {r["__p"]: r["count"] for r in ranged.groupBy("__p").count().collect()}
    total = sum(sizes.values())
    if total <= n:
        return ranged.drop("__p")
    start, pairs = 0, []
    for p in sorted(sizes):
        pairs += [F.lit(p), F.lit(start)]
        start += sizes[p]
    at = F.create_map(*pairs)[F.col("__p")] + F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1
    step = total / n
    wanted = F.array(*[F.lit(int(i * step)).cast("long") for i in range(n)])
    return ranged.withColumn("__at", at).where(F.array_contains(wanted, F.col("__at").cast("long"))).drop("__at", "__p")
