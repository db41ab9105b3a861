"""K-means by Drake's bounds against plain Lloyd rounds over exact integers."""

import hashlib
import random

import pytest

from postmill.llm import clusters, queries


def plain_kmeans(rows, k, rounds, seed, scale, dim):
    import math

    points = [(i, [math.floor(float(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in points if i is not None)[:k]
    centroids = [v for _, v in start]
    nearest = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in points:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    return sorted((i if i is not None else -1, nearest(v)[1], nearest(v)[0]) for i, v in points), centroids


@pytest.mark.parametrize("k,spread", [(8, 0.05), (5, 1.0), (1, 1.0), (20, 0.3)])
def test_equals_plain_rounds(spark, k, spread):
    rnd = random.Random(k)
    heads = [[rnd.uniform(-1, 1) for _ in range(4)] for _ in range(7)]
    rows = [(i, [h + rnd.gauss(0, spread) for h in heads[i % 7]]) for i in range(400)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(200)]  # a third are the same
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    found = clusters.drake_kmeans(df, k=k, dim=4, rounds=6)
    want, centroids = plain_kmeans(rows, k, 6, 3, 1024, 4)
    assert found.centroids == centroids
    assert sorted((r.vec_id, r.cluster, r.distance) for r in found.assigned.collect()) == want
    assert found.inertia == [sum(d for _, c, d in want if c == j) for j in range(len(centroids))]
    if spread < 0.1:  # clear clusters: most vectors are certified by their bounds
        assert found.computed[3] < len(rows) * k / 3


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0]), (5, [float("inf"), 0.0]), (6, [None, 1.0]), (None, [9.0, 9.0]), (7, [-0.0001, 3.0]), (8, [1e30, -1e30])]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "vec_id long, embedding array<double>, cluster string")
    got = clusters.cluster_report(df, k=3, dim=2, rounds=4).collect()
    assert sorted((r.vec_id or 0) for r in got) == [0, 1, 1, 7, 8]
    top = clusters.holding(2)
    held = [(i, v if i != 8 else [top / 1024, -top / 1024]) for i, v in rows]
    want, centroids = plain_kmeans(held, 3, 4, 3, 1024, 2)
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance) for r in got) == want
    assert {(r.cluster, r.centroid_sha256) for r in got} <= {(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)}
    assert clusters.cluster_report(df.limit(0), k=3, dim=2).count() == 0
    assert clusters.cluster_report(df.where("vec_id is null"), k=3, dim=2).columns == clusters.cluster_report(df, k=3, dim=2).columns


def test_query_equals_plain_rounds(spark, data):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, centroids = plain_kmeans(rows, 8, 10, 3, 1024, 64)
    got = queries.op11_clusters(spark, data).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == want
    assert {r.inertia for r in got} == {sum(d for _, _, d in want)}
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest() for r in got)
