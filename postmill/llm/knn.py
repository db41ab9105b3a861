"""Exact top-k inner-product search over sharded KD-trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.session import materialise

NONE = -(1 << 63)


def finite_ints(vec: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, or null where the vector can't take part."""
    ok = vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(ok, F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class Tree:
    """A KD-tree over integer vectors: splits at the median position of the widest dimension, tight boxes.

    Splitting by position keeps the halves equal even when thousands of vectors are the same.
    """

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, leaf: int) -> None:
        perm = np.arange(len(ids))
        spans: list[list[tuple[int, int]]] = [[(0, len(ids))]]
        while spans[-1][0][1] - spans[-1][0][0] > leaf:
            level = []
            for a, b in spans[-1]:
                own = vecs[perm[a:b]]
                if b - a < 2:
                    level += [(a, b), (b, b)]
                    continue
                d = int(np.argmax(own.max(0) - own.min(0)))
                m = (b - a) // 2
                perm[a:b] = perm[a:b][np.argpartition(own[:, d], m)]
                level += [(a, a + m), (a + m, b)]
            spans.append(level)
        self.ids, self.vecs = ids[perm], vecs[perm]
        self.spans = spans
        self.boxes = []
        for level in spans:
            low = np.stack([self.vecs[a:b].min(0) if b > a else np.zeros(vecs.shape[1]) for a, b in level])
            high = np.stack([self.vecs[a:b].max(0) if b > a else np.zeros(vecs.shape[1]) for a, b in level])
            first = np.array([self.ids[a:b].min() if b > a else np.iinfo(np.int64).max for a, b in level])
            full = np.array([b > a for a, b in level])
            self.boxes.append((low, high, first, full))

    def search(self, qids: np.ndarray, q: np.ndarray, top_s: np.ndarray, top_i: np.ndarray) -> None:
        """Improve each query's k best (score, id), in place, best boxes first.

        ``top_s``/``top_i`` may come in with results from other shards: their kth entry prunes from the start.
        """
        pos, neg = np.maximum(q, 0), np.minimum(q, 0)
        # Down the levels: a pair of query and node lives while the node's bound can still beat the kth.
        alive = np.ones((len(q), 1), bool)
        bound = None
        for depth, (low, high, first, full) in enumerate(self.boxes):
            if depth:
                alive = np.repeat(alive, 2, axis=1)
            bound = pos @ high.T + neg @ low.T
            alive &= full & self._can(bound, first, top_s[:, -1], top_i[:, -1])
            if not alive.any():
                return
        first = self.boxes[-1][2]
        bound = np.where(alive, bound, -np.inf)
        order = np.argsort(-bound, axis=1, kind="stable")
        done, take = 0, 1
        while done < order.shape[1]:
            block = order[:, done:done + take]
            rows = np.repeat(np.arange(len(q)), block.shape[1])
            cols = block.ravel()
            live = self._can_pairs(bound[rows, cols], first[cols], top_s[rows, -1], top_i[rows, -1])
            # the first leaf of a block has its largest bound: with none left there, a query is finished
            if not live.any():
                head = order[:, done]
                if not self._can_pairs(bound[np.arange(len(q)), head], np.full(len(q), NONE), top_s[:, -1], top_i[:, -1]).any():
                    return
            rows, cols = rows[live], cols[live]
            by = np.argsort(cols, kind="stable")
            rows, cols = rows[by], cols[by]
            cuts = np.flatnonzero(np.diff(cols)) + 1
            for r, c in zip(np.split(rows, cuts), np.split(cols, cuts)):
                if len(r):
                    a, b = self.spans[-1][c[0]]
                    self._merge(r, qids, q, a, b, top_s, top_i)
            done, take = done + take, take * 4

    @staticmethod
    def _can(bound, first, s, i):
        return (bound > s[:, None]) | ((bound == s[:, None]) & (first[None, :] < i[:, None]))

    @staticmethod
    def _can_pairs(bound, first, s, i):
        return (bound > s) | ((bound == s) & (first < i))

    def _merge(self, r, qids, q, a, b, top_s, top_i) -> None:
        ids = self.ids[a:b]
        s = q[r] @ self.vecs[a:b].T
        better = ((s > top_s[r, -1][:, None]) | ((s == top_s[r, -1][:, None]) & (ids[None, :] < top_i[r, -1][:, None]))) & (ids[None, :] != qids[r][:, None])
        hit = better.any(1)
        if not hit.any():
            return
        r, s, better = r[hit], s[hit], better[hit]
        s = np.where(better, s, -np.inf if s.dtype.kind == "f" else None if s.dtype == object else NONE)
        i = np.where(better, ids[None, :], np.iinfo(np.int64).max)
        if s.dtype == object:
            s[~better] = -(1 << 200)
        both_s, both_i = np.concatenate([top_s[r], s], 1), np.concatenate([top_i[r], i], 1)
        k = top_s.shape[1]
        if both_s.dtype == object:
            for x, (ss, ii) in enumerate(zip(both_s, both_i)):
                best = sorted(range(len(ss)), key=lambda j: (-ss[j], ii[j]))[:k]
                top_s[r[x]], top_i[r[x]] = ss[best], ii[best]
            return
        o = np.lexsort((both_i, -both_s), axis=1)[:, :k]
        top_s[r], top_i[r] = np.take_along_axis(both_s, o, 1), np.take_along_axis(both_i, o, 1)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _searcher(k: int, leaf: int, home: bool):
    """Over rows sorted by (shard, kind): build a shard's tree from its vectors, then answer queries in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, tree = None, [], None
        exact = float

        def build():
            ids = np.concatenate([x[0] for x in held])
            vecs = np.concatenate([x[1] for x in held])
            if len(ids) > 1:  # a repeated row counts once
                o = np.lexsort((*vecs.T[::-1], ids))
                ids, vecs = ids[o], vecs[o]
                new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (vecs[1:] != vecs[:-1]).any(1)])
                ids, vecs = ids[new], vecs[new]
            return Tree(ids, vecs, leaf)

        def answer(qids, q, s0, i0):
            top_s = np.full((len(qids), k), -np.inf) if exact is float else np.full((len(qids), k), -(1 << 200), object)
            top_i = np.full((len(qids), k), np.iinfo(np.int64).max)
            known = i0 != NONE
            top_s[known, -1], top_i[known, -1] = s0[known], i0[known]
            start = top_i.copy()
            tree.search(qids, q, top_s, top_i)
            new = (top_i != np.iinfo(np.int64).max) & ~(known[:, None] & (top_i == start[:, -1:]))
            r, c = np.nonzero(new)
            limit = (1 << 63) - 1
            scores = top_s[r, c].astype(np.int64) if exact is float else np.array([min(limit, max(-limit - 1, int(x))) for x in top_s[r, c]], np.int64)
            return qids[r], top_i[r, c].astype(np.int64), scores

        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column("shard").to_numpy(zero_copy_only=False)
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            mark = shard * 2 + kind
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(mark)) + 1, [len(mark)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = batch.slice(a, b - a)
                ids = part.column("id").to_numpy(zero_copy_only=False)
                vecs = _matrix(part.column("vec"), int(dims[a]))
                if shard[a] != key:
                    key, held, tree, exact = shard[a], [], None, float
                if kind[a] == 0:
                    held.append((ids, vecs))
                    tree = None
                    continue
                if not held:
                    continue
                if tree is None:
                    big = max([int(np.abs(x[1]).max(initial=0)) for x in held] + [int(np.abs(vecs).max(initial=0)), 0])
                    exact = float if big * big * int(dims[a]) < (1 << 53) else int
                    held = [(i, v.astype(np.float64) if exact is float else v.astype(object)) for i, v in held]
                    tree = build()
                for lo in range(0, len(ids), 512):
                    cut = slice(lo, lo + 512)
                    v = vecs[cut].astype(np.float64 if exact is float else object)
                    s0 = part.column("kth_score").to_numpy(zero_copy_only=False)[cut]
                    i0 = part.column("kth_id").to_numpy(zero_copy_only=False)[cut]
                    qi, vi, sc = answer(ids[cut], v, s0, i0)
                    yield pa.RecordBatch.from_arrays([pa.array(qi, pa.int64()), pa.array(vi, pa.int64()), pa.array(sc, pa.int64())], ["query_id", "vec_id", "score"])

    return run


def exact_topk(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding",
    shard_rows: int = 131_072, least_shards: int = 12, leaf: int = 64,
) -> DataFrame:
    """Each query row's ``k`` best other rows by integer inner product, ties to the smaller id.

    Vectors are dealt to shards by a hash of their id. First every query searches the KD-tree of the shard it
    lies in. Its kth score then travels with it to the other shards, whose trees prune against it from the
    root on. Tasks hold one shard's tree and a few hundred queries; hits meet in a window by query.

    Vectors that are null or hold null or non-finite components, and rows without an id, take no part. Vectors of
    different lengths never meet. Repeated rows (same id and vector) count as one; a query never meets rows of its
    own id. Scores outside a long's range are held at its ends. An empty table gives no rows.
    Result: query_id, rank (from 1), vec_id, score.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), finite_ints(F.col(vec_col), scale).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).withColumn("dim", F.size("vec"))
    by_dim = {r["dim"]: r["n"] for r in rows.where("dim > 0").groupBy("dim").agg(F.count("*").alias("n")).collect()}
    base, shards_of = 0, {}
    for dim, n in sorted(by_dim.items()):
        shards_of[dim] = (base, max(min(least_shards, -(-n // 1024)), -(-n // shard_rows)))
        base += shards_of[dim][1]
    if not shards_of:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    start = F.create_map(*[F.lit(x) for d, (b, _) in shards_of.items() for x in (d, b)])
    many = F.create_map(*[F.lit(x) for d, (_, m) in shards_of.items() for x in (d, m)])
    rows = rows.where("dim > 0").withColumn("base", start[F.col("dim")]).withColumn("many", many[F.col("dim")])
    rows = rows.withColumn("shard", (F.col("base") + F.pmod(F.xxhash64("id"), F.col("many"))).cast("int"))
    cols = ["shard", "kind", "id", "dim", "vec", "kth_score", "kth_id"]
    plain = rows.withColumns({"kind": F.lit(0), "kth_score": F.lit(0).cast("long"), "kth_id": F.lit(NONE).cast("long")})
    asked = plain.where("q").withColumn("kind", F.lit(1)).dropDuplicates(["id", "vec"])
    out = "query_id long, vec_id long, score long"
    at_home = plain.select(cols).unionByName(asked.select(cols)).repartition(base, "shard").sortWithinPartitions("shard", "kind")
    home, _ = materialise(at_home.mapInArrow(_searcher(k, leaf, True), out), "knn-home")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = (
        home.withColumn("n", F.row_number().over(best)).where(F.col("n") == k)
        .select(F.col("query_id").alias("id"), F.col("score").alias("kth_score"), F.col("vec_id").alias("kth_id"))
    )
    away = (
        asked.drop("kth_score", "kth_id").join(kth, "id", "left")
        .withColumns({"kth_score": F.coalesce("kth_score", F.lit(0)), "kth_id": F.coalesce("kth_id", F.lit(NONE).cast("long")), "own": F.col("shard")})
        .withColumn("shard", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("many") - 1)))
        .where(F.col("shard") != F.col("own"))
    )
    away = plain.select(cols).unionByName(away.select(cols)).repartition(base, "shard").sortWithinPartitions("shard", "kind")
    found = home.unionByName(away.mapInArrow(_searcher(k, leaf, False), out)).distinct()
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )
