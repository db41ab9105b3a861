"""Balanced shards by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.session import materialise


def differencing(sizes: list[int], ways: int) -> list[int]:
    """Part of each item by the largest differencing method.

    Every item starts as a partial partition (its size in one part, nothing in the others). The two partial
    partitions of largest spread are combined in opposite order, the fullest part with the emptiest, until
    one is left.
    """
    order = itertools.count()
    heap: list[tuple] = []
    for i, s in enumerate(sizes):
        heap.append((-s, next(order), [(s, i)] + [(0, None)] * (ways - 1)))
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        cells = sorted(((x + y, _both(p, q)) for (x, p), (y, q) in zip(a, reversed(b))), key=lambda c: -c[0])
        least = cells[-1][0]
        cells = [(s - least, t) for s, t in cells]
        heapq.heappush(heap, (-cells[0][0], next(order), cells))
    part = [0] * len(sizes)
    if heap:
        for k, (_, tree) in enumerate(heap[0][2]):
            stack = [tree]
            while stack:
                t = stack.pop()
                if isinstance(t, tuple):
                    stack.extend(t)
                elif t is not None:
                    part[t] = k
    return part


def _both(p, q):
    return q if p is None else p if q is None else (p, q)


def shard_documents(
    docs: DataFrame, n_shards: int = 16, bins: int = 8192, heavy_share: int = 4096, bucket_rows: int = 1_000_000
) -> DataFrame:
    """Deal documents into ``n_shards`` of nearly equal bytes, keeping equal texts in one shard.

    Groups of equal texts are indivisible. A group that holds at least 1/``heavy_share`` of all bytes is an
    item of its own (there are at most ``heavy_share`` such); lighter groups meet in ``bins`` bins by a hash of
    their text. So the driver differences at most ``bins + heavy_share`` items, whatever the input's size, and
    both assignment tables have that bound when they are broadcast. Rows never move by group, so a group that
    holds a third of all rows is no hot key.

    Null texts count as one group of size 1 a row, with crc 0; empty texts are another group. Repeated rows are
    all kept, and rows without an id are dealt like others. Groups of equal size go by their hash; slots follow a
    hash of the row, then the id. Texts are read whole, for their size and hash alone. An empty table gives no rows. Other columns are ignored.
    Result: doc_id, size, text_crc32, law, shard, slot, grown_shard.
    """
    spark = docs.sparkSession
    base, _ = materialise(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(F.col("text").isNull(), F.col("text")).alias("grp"),
            F.monotonically_increasing_id().alias("rid"),
        ),
        "shard-base",
    )
    base = base.withColumn("bin", F.pmod(F.xxhash64(F.lit(5), F.col("grp")), F.lit(bins)).cast("int"))
    by_bin = base.groupBy("bin").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    total, n_rows = sum(r["bytes"] for r in by_bin), sum(r["n"] for r in by_bin)
    heavy = (
        base.groupBy("grp", "bin").agg(F.sum("size").alias("bytes"))
        .where(F.col("bytes") * heavy_share >= F.lit(total)).collect()
    )
    light = {r["bin"]: r["bytes"] for r in by_bin}
    for r in heavy:
        light[r["bin"]] -= r["bytes"]
    items = [("g", r["grp"], r["bytes"]) for r in heavy] + [("b", b, s) for b, s in sorted(light.items()) if s]
    items.sort(key=lambda x: (-x[2], x[0], x[1]))
    part = differencing([x[2] for x in items], n_shards)
    of_bin = [(k, p) for (kind, k, _), p in zip(items, part) if kind == "b"]
    of_grp = [(k, p) for (kind, k, _), p in zip(items, part) if kind == "g"]
    bin_df = spark.createDataFrame(of_bin or [(-1, 0)], "bin int, bin_shard int")
    grp_df = spark.createDataFrame(of_grp, "grp long, grp_shard int")
    dealt = (
        base.join(F.broadcast(grp_df), "grp", "left").join(F.broadcast(bin_df), "bin", "left")
        .withColumn("shard", F.coalesce("grp_shard", "bin_shard"))
    )
    buckets = max(64, -(-n_rows // bucket_rows))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64(F.lit(9), F.col("rid")), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "rid")
    return (
        dealt.withColumn("at", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "bucket"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("start") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
