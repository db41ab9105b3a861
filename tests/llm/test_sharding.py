import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from postmill.llm.sharding import differencing, shard_documents


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1000), max_size=40), st.integers(1, 7))
def test_differencing_is_a_tight_partition(sizes, ways):
    part = differencing(sizes, ways)
    sums = [0] * ways
    for s, p in zip(sizes, part):
        sums[p] += s
    assert len(part) == len(sizes) and sum(sums) == sum(sizes)
    assert max(sums) - min(sums) <= max(sizes, default=0)  # a difference never exceeds the largest item


def test_differencing_beats_greedy():
    sizes = [8, 7, 6, 5, 4]
    part = differencing(sizes, 2)
    assert sorted([sum(s for s, p in zip(sizes, part) if p == k) for k in (0, 1)]) == [14, 16]


def test_shards(spark, docs_of):
    rng = random.Random(2)
    texts = ["hot copy " * 20] * 150 + [None, None, "", "", "é"] + ["w" * rng.randrange(1, 400) + str(i) for i in range(500)]
    rows = shard_documents(docs_of(texts, extra=True)).collect()
    assert len(rows) == len(texts)
    by_text, shards = {}, {}
    for r in rows:
        t = texts[r.doc_id]
        assert r["size"] == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32((t or "").encode()) and r.law == "bytes" and r.grown_shard is None
        by_text.setdefault(t, set()).add(r.shard)
        shards.setdefault(r.shard, []).append(r)
    assert all(len(s) == 1 for s in by_text.values()) and all(0 <= s < 16 for s in shards)
    for s in shards.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
    hot = by_text["hot copy " * 20].pop()
    rest = [sum(r["size"] for r in v) for k, v in shards.items() if k != hot]
    assert max(rest) - min(rest) <= 0.02 * max(rest)


def test_empty(spark, docs_of):
    assert shard_documents(docs_of([])).count() == 0


def test_spread_equals_differencing_of_every_group(spark):
    """Many more groups than bins, a hot one and a long text: the bins cost no balance against differencing each group alone."""
    from pyspark.sql import functions as F

    size = F.pmod(F.xxhash64("id"), F.lit(150)).cast("int") + 1
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "hot").when(F.col("id") == 7, F.repeat(F.lit("long "), F.lit(4000))).otherwise(F.concat(F.repeat(F.lit("x"), size), F.col("id").cast("string"))).alias("text"))
    sums = [r.b for r in shard_documents(docs).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    groups = [r.b for r in docs.groupBy("text").agg(F.sum(F.octet_length("text") + 1).alias("b")).collect()]
    best = [0] * 16
    for g, k in zip(groups, differencing(groups, 16)):
        best[k] += g
    assert len(groups) > 25_000 and max(sums) - min(sums) <= max(best) - min(best) + 1


def test_repeated_rows_all_stay(spark, docs_of):
    docs = docs_of(["a", "a", None, "b"])
    got = shard_documents(docs.unionByName(docs)).collect()
    assert len(got) == 8 and len({r.shard for r in got if r.doc_id in (0, 1)}) == 1
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
