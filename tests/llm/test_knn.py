import math
import random

import duckdb
from pyspark.sql import functions as F

from postmill.llm import queries
from postmill.llm.knn import exact_topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5, mod=50):
    import struct

    f32 = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    ok = {(i, tuple(math.floor(256 * f32(x)) for x in v)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and len(v)}
    out = set()
    for q, qv in ok:
        if q % mod == 0:
            best = sorted({(-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q and len(v) == len(qv)})[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def got(df, **kw):
    return {tuple(r) for r in exact_topk(df, F.col("vec_id") % 50 == 0, **kw).collect()}


def test_equals_brute_force_with_ties_and_bad_vectors(spark):
    rng = random.Random(1)
    common = [0.5, -0.25, 0.125, 0.0]
    rows = [(i, common if rng.random() < 0.4 else [rng.uniform(-1, 1) for _ in range(4)], 0) for i in range(400)]
    rows += [(1000, None, 0), (1050, [1.0, None, 0.0, 0.0], 0), (1100, [float("nan"), 0.0, 0.0, 0.0], 0), (1150, [float("inf")] * 4, 0), (None, common, 0), (1200, [1.0, 2.0], 0), (1201, [1.0, 1.0], 0), (1250, [], 0)]
    rows += rows[:30]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"shard": F.lit("x"), "id": F.lit("y")})
    want = brute(rows)
    assert got(df, least_shards=1) == want
    assert got(df, shard_rows=37, leaf=4) == want


def test_few_rows_and_none(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == set()
    assert got(spark.createDataFrame([(0, [1.0], 0)], SCHEMA)) == set()
    assert got(spark.createDataFrame([(0, [1.0], 0), (-50, [2.0], 0)], SCHEMA)) == {(0, 1, -50, 512 * 256), (-50, 1, 0, 512 * 256)}


def test_huge_components_stay_exact(spark):
    rows = [(0, [2.0**20, 1.0], 0), (1, [2.0**20, 1.0], 0), (2, [2.0**20, -1.0], 0)]
    assert got(spark.createDataFrame(rows, SCHEMA), k=1) == brute(rows, k=1)


def test_query_equals_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    res = con.execute(queries.ORACLE_SQL["op1_topk_search"])
    at = [d[0] for d in res.description]
    want = {tuple(int(r[at.index(c)]) for c in ("query_id", "rank", "vec_id", "score")) for r in res.fetchall()}
    assert {tuple(r) for r in queries.op1_topk_search(spark, data).collect()} == want
