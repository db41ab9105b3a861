"""Exact integer k-means with Drake's adaptive bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.session import drop_scratch, materialise

_STATE = "kind int, vec_id long, vec array<int>, cluster int, distance long, upper double, near array<int>, low array<double>, rest double, n long, sums array<decimal(38,0)>, used int, computed long"
_SLACK = 1e-9


def holding(dim: int) -> int:
    """The largest component for which squared distances of ``dim`` components stay within a long; larger ones are held there."""
    return min((1 << 30) - 1, int((2.0**62 / dim) ** 0.5 / 2))


def squared(vecs: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of every vector to every centroid (int64): products of doubles where those are whole, else differences."""
    big = max(int(np.abs(vecs).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * big * big * vecs.shape[1] < 1 << 53:
        v, c = vecs.astype(np.float64), centroids.astype(np.float64)
        return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    out = np.empty((len(vecs), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        d = vecs.astype(np.int64) - c
        out[:, j] = (d * d).sum(1)
    return out


def squared_pairs(vecs: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    d = vecs.astype(np.int64) - centroids
    return (d * d).sum(-1)


@dataclass
class Bounds:
    """What is known of each vector: its centroid, an upper bound of the distance to it, and lower bounds to the others.

    ``near`` names the next nearest centroids and ``low`` bounds the distance to each; ``rest`` bounds all that aren't named.
    """

    cluster: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    low: np.ndarray
    rest: np.ndarray

    @classmethod
    def scan(cls, vecs: np.ndarray, centroids: np.ndarray, b: int) -> tuple[Bounds, np.ndarray]:
        """Distances to all centroids, nearest first (ties: the smaller number)."""
        d = squared(vecs, centroids)
        order = np.argsort(d, axis=1, kind="stable")
        far = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
        out = cls(order[:, 0], far[:, 0] * (1 + _SLACK), order[:, 1:1 + b], far[:, 1:1 + b] * (1 - _SLACK), far[:, 1 + b] * (1 - _SLACK) if far.shape[1] > 1 + b else np.full(len(vecs), np.inf))
        return out, d[np.arange(len(d)), order[:, 0]]

    def move(self, steps: np.ndarray) -> None:
        """Loosen every bound by how far the centroids went, and a little for rounding."""
        give = lambda x, s: x - s - _SLACK * (np.abs(x) + s)
        with np.errstate(invalid="ignore"):
            self.upper = self.upper + steps[self.cluster] + _SLACK * (self.upper + steps[self.cluster])
            self.low = give(self.low, steps[self.near])
            self.rest = np.where(np.isinf(self.rest), self.rest, give(self.rest, steps.max(initial=0.0)))

    def narrow(self, b: int) -> None:
        """Keep ``b`` named bounds; the others fall into the remainder's."""
        if b < self.near.shape[1]:
            self.rest = np.minimum(self.rest, self.low[:, b:].min(1))
            self.near, self.low = self.near[:, :b], self.low[:, :b]

    def settle(self, vecs: np.ndarray, centroids: np.ndarray) -> tuple[int, int]:
        """Make every assignment exact; (distances computed, the most named bounds that one vector needed).

        Where the upper bound stays below all lower ones the order is certain. Else the own distance is computed; where
        that doesn't do but the remainder's bound lies above it, only the named centroids are compared, and where it
        doesn't either, all are.
        """
        open_ = np.flatnonzero(self.upper >= np.minimum(self.low.min(1, initial=np.inf), self.rest))
        computed, used = len(open_), 0
        own = squared_pairs(vecs[open_], centroids[self.cluster[open_]])
        self.upper[open_] = np.sqrt(own.astype(np.float64)) * (1 + _SLACK)
        still = self.upper[open_] >= np.minimum(self.low[open_].min(1, initial=np.inf), self.rest[open_])
        open_, own = open_[still], own[still]
        named = (self.upper[open_] < self.rest[open_]) & (self.near.shape[1] > 0)
        at = open_[named]
        if len(at):
            who = np.concatenate([self.cluster[at, None], self.near[at]], 1)
            d = np.concatenate([own[named, None], squared_pairs(vecs[at, None, :], centroids[self.near[at]])], 1)
            computed += self.near[at].size
            needed = (self.low[at] <= self.upper[at, None]).any(0)
            used = int(np.flatnonzero(needed).max(initial=-1)) + 1
            order = np.lexsort((who, d), axis=1)
            who, d = np.take_along_axis(who, order, 1), np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
            self.cluster[at], self.near[at] = who[:, 0], who[:, 1:]
            self.upper[at], self.low[at] = d[:, 0] * (1 + _SLACK), d[:, 1:] * (1 - _SLACK)
        at = open_[~named]
        if len(at):
            b = self.near.shape[1]
            full, _ = Bounds.scan(vecs[at], centroids, b)
            computed, used = computed + len(at) * len(centroids), b
            self.cluster[at], self.upper[at], self.near[at], self.low[at], self.rest[at] = full.cluster, full.upper, full.near, full.low, full.rest
        return computed, used


def _matrix(column: pa.Array, kind) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind) if len(flat) else np.zeros((len(column), 0), kind)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel(), kind))


def _round(centroids: np.ndarray, steps: np.ndarray | None, b: int, last: bool):
    """One pass over the state: move the bounds, settle the assignments, hand on the state and a row of sums for each cluster that changed.

    The first pass has no bounds and scans; later ones add up only vectors that changed their cluster. The last one
    computes every vector's own distance and adds those up.
    """
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(k, np.int64)
        sums = [[0] * dim for _ in range(k)]
        touched, used, computed, inertia = np.zeros(k, bool), 0, 0, [0] * k

        def add(clusters: np.ndarray, vecs: np.ndarray, sign: int) -> None:
            order = np.argsort(clusters, kind="stable")
            who, at = np.unique(clusters[order], return_index=True)
            if not len(who):
                return
            part = np.add.reduceat(vecs[order].astype(np.int64), at, axis=0)
            many = np.diff(np.concatenate([at, [len(order)]]))
            for c, p, m in zip(who.tolist(), part.tolist(), many.tolist()):
                sums[c] = [x + sign * y for x, y in zip(sums[c], p)]
                n[c] += sign * m
                touched[c] = True

        for batch in batches:
            if not batch.num_rows:
                continue
            vecs = _matrix(batch.column("vec"), np.int32)
            if steps is None:
                state, own = Bounds.scan(vecs, centroids, b)
                computed += len(vecs) * k
                add(state.cluster, vecs, 1)
            else:
                state = Bounds(
                    batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("upper").to_numpy(zero_copy_only=False).copy(),
                    _matrix(batch.column("near"), np.int64), _matrix(batch.column("low"), np.float64), batch.column("rest").to_numpy(zero_copy_only=False).copy(),
                )
                before = state.cluster.copy()
                state.move(steps)
                state.narrow(b)
                extra, need = state.settle(vecs, centroids)
                computed, used = computed + extra, max(used, need)
                changed = np.flatnonzero(state.cluster != before)
                add(before[changed], vecs[changed], -1)
                add(state.cluster[changed], vecs[changed], 1)
                own = squared_pairs(vecs, centroids[state.cluster]) if last else np.zeros(len(vecs), np.int64)
            if last:
                computed += len(vecs)
                for c in np.unique(state.cluster).tolist():
                    inertia[c] += sum(own[state.cluster == c].tolist())
            size = len(vecs)
            null = lambda t: pa.nulls(size, t)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.zeros(size, np.int32)), batch.column("vec_id"), batch.column("vec"), pa.array(state.cluster.astype(np.int32)), pa.array(own),
                pa.array(state.upper), _lists(state.near, pa.int32()), _lists(state.low, pa.float64()), pa.array(state.rest),
                null(pa.int64()), null(pa.list_(pa.decimal128(38, 0))), null(pa.int32()), null(pa.int64()),
            ], names)
        rows = [c for c in range(k) if touched[c] or inertia[c]] or [0]
        size = len(rows)
        null = lambda t: pa.nulls(size, t)
        values = [[Decimal(x) for x in sums[c]] + [Decimal(inertia[c])] for c in rows]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.ones(size, np.int32)), null(pa.int64()), null(pa.list_(pa.int32())), pa.array(rows, pa.int32()), null(pa.int64()), null(pa.float64()), null(pa.list_(pa.int32())), null(pa.list_(pa.float64())), null(pa.float64()),
            pa.array(n[rows]), pa.array(values, pa.list_(pa.decimal128(38, 0))), pa.array([used] * size, pa.int32()), pa.array([computed] + [0] * (size - 1), pa.int64()),
        ], names)

    names = [c.split()[0] for c in _STATE.split(", ")]
    return run


@dataclass
class Clustering:
    """Vectors with their cluster, the final centroids, each cluster's summed distance, and the distances computed in each pass."""

    assigned: DataFrame
    centroids: list[list[int]]
    inertia: list[int] = field(default_factory=list)
    computed: list[int] = field(default_factory=list)


def drake_kmeans(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024, dim: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> Clustering:
    """Lloyd's k-means over floor(scale * x) by Drake's adaptive bounds, exact in every round.

    Kept are vectors of ``dim`` components of which none is null, NaN or infinite. The first centroids are the kept
    vectors with the smallest hex sha256 of ``<seed>:<id>``, in that order (repeated ids: by components, then all the same
    row counts). Each round assigns every vector to its nearest centroid (ties: the smaller number) and replaces every
    non-empty one by floor(sum / count); then vectors are assigned once more.

    A vector carries its centroid with an upper bound of the distance, lower bounds to its ``b`` next nearest centroids and one
    bound for the remainder. Bounds are widened by how far the centroids went; only vectors whose order they can't
    certify are compared again, with the named centroids or with all. ``b`` starts at a quarter of k and
    shrinks to what the round before needed, an eighth of k at least. A pass reads the state, writes it anew to the
    shared scratch folder and adds a row of sums for each cluster and task, which Spark adds up: no shuffle
    of vectors, and only k centroids reach the driver. The table of the pass before is dropped.

    Rows without an id are assigned like others but never start as centroids (if no row has an id there is no result).
    Repeated rows each count. Fewer vectors than k give as many clusters. An empty table gives no rows. Components
    beyond ``holding(dim)`` are held there, so that distances fit a long.
    """
    spark = vectors.sparkSession
    top = float(holding(dim))
    ok = F.col(vec_col).isNotNull() & (F.size(vec_col) == dim) & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vec_col, lambda x: F.greatest(F.lit(-top), F.least(F.lit(top), F.floor(F.greatest(F.lit(-2 * top), F.least(F.lit(2 * top), x.cast("double") * scale))).cast("double"))).cast("int"))
    points = vectors.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("vec"))
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = points.where("vec_id is not null").withColumn("h", first).orderBy("h", "vec").limit(k).collect()
    if not start:
        return Clustering(spark.createDataFrame([], "vec_id long, cluster int, distance long"), [])
    centroids = [list(r["vec"]) for r in start]
    k = len(centroids)
    least = max(1, k // 8)
    b, steps, path = min(k - 1, max(least, -(-k // 4))), None, None
    n, sums, computed = [0] * k, [[0] * dim for _ in range(k)], []
    state, inertia = points, [0] * k
    for step in range(rounds + 1):
        last = step == rounds
        task = _round(np.array(centroids, np.int64), steps, b, last)
        new, new_path = materialise(state.mapInArrow(task, _STATE), "clusters")
        if path:
            drop_scratch(spark, path)
        path = new_path
        state = new.where("kind = 0").select("vec_id", "vec", "cluster", "upper", "near", "low", "rest") if not last else new.where("kind = 0")
        tell = new.where("kind = 1")
        each = tell.select("cluster", "n", "used", "computed", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at")
        moved = each.agg(F.sum("n").alias("n"), F.sum("x").cast("decimal(38,0)").alias("x"), F.max("used").alias("used"), F.sum("computed").alias("computed")).collect()
        used = max(r["used"] for r in moved)
        computed.append(sum(r["computed"] for r in moved if r["at"] == dim))
        for r in moved:
            if r["at"] == dim:
                inertia[r["cluster"]] += int(r["x"])
                n[r["cluster"]] += r["n"]
            else:
                sums[r["cluster"]][r["at"]] += int(r["x"])
        if last:
            break
        then = centroids
        centroids = [[x // n[c] for x in sums[c]] if n[c] else then[c] for c in range(k)]
        steps = np.array([sum((x - y) ** 2 for x, y in zip(p, q)) ** 0.5 for p, q in zip(then, centroids)]) * (1 + _SLACK)
        if step:
            b = max(min(least, k - 1), min(b, used))
    return Clustering(state.select("vec_id", "cluster", "distance"), centroids, inertia, computed)


def cluster_report(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector; sums beyond a long are held at its end."""
    found = drake_kmeans(vectors, **options)
    held = lambda x: F.lit(min(x, (1 << 63) - 1)).cast("long")
    if not found.centroids:
        return found.assigned.selectExpr("*", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256")
    by = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    prints = [F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in found.centroids]
    return found.assigned.select(
        "vec_id", "cluster", "distance", by([held(x) for x in found.inertia]).alias("cluster_inertia"), held(sum(found.inertia)).alias("inertia"), by(prints).alias("centroid_sha256")
    )
