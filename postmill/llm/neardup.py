"""Near-duplicate groups by HyperMinHash: compressed registers, banding, corrected estimates, exact links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import mix64, split_words, text_slices, wide_rows
from postmill.session import drop_scratch, materialise

MANTISSA = 10


def shingle_sets(texts: pa.Array, words_each: int) -> list[np.ndarray]:
    """Each text's distinct word shingles as sorted 64-bit hashes; fewer words make one shingle, none make an empty set."""
    offsets, code, words = split_words(texts)
    token = np.array([xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()], np.uint64)
    h = token[code] if len(code) else np.zeros(0, np.uint64)
    out = []
    whole = np.zeros(0, np.uint64)
    if len(h) >= words_each:
        whole = mix64(h[: len(h) - words_each + 1] + np.uint64(1))
        for k in range(1, words_each):
            whole = mix64(whole * np.uint64(31) + h[k:len(h) - words_each + 1 + k])
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= words_each:
            s = np.sort(whole[a:b - words_each + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            x = np.array([b - a], np.uint64)
            for k in range(a, b):
                x = mix64(x * np.uint64(31) + h[k:k + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _multipliers(n: int, seed: int = 2024) -> np.ndarray:
    return np.random.default_rng(seed).integers(1 << 62, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers(sets: list[np.ndarray], buckets: int) -> np.ndarray:
    """A row of ``buckets`` 16-bit registers for each set: 6 bits of leading zeros of the bucket's least hash, 10 bits of mantissa."""
    out = np.full((len(sets), buckets), 0xFFFF, np.uint16)
    mult = _multipliers(buckets)
    full = [i for i, s in enumerate(sets) if len(s)]
    start = 0
    while start < len(full):  # runs of about 16k elements stay in the cache
        stop, total = start, 0
        while stop < len(full) and (stop == start or total + len(sets[full[stop]]) <= 16_384):
            total += len(sets[full[stop]])
            stop += 1
        rows = full[start:stop]
        x = np.concatenate([sets[i] for i in rows])
        at = np.concatenate([[0], np.cumsum([len(sets[i]) for i in rows])[:-1]])
        least = np.stack([np.minimum.reduceat(x * m, at) for m in mult], 1)
        out[rows] = _compress(least)
        start = stop
    return out


def _compress(least: np.ndarray) -> np.ndarray:
    # a float64 holds 53 bits: its exponent gives the leading zeros of the upper bits exactly
    high = (least >> np.uint64(12)).astype(np.float64)
    _, e = np.frexp(high)
    zeros = np.minimum(52 - e, 52).astype(np.uint64)
    shifted = (least << np.uint64(1)) << zeros  # without the leading one
    return ((zeros << np.uint64(MANTISSA)) | (shifted >> np.uint64(64 - MANTISSA))).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register rows, corrected for registers that agree by chance.

    Two independent least values of sets of sizes n and m share a register with probability about
    sum over cells of p_n(cell) p_m(cell). A cell of relative width 2^-mantissa around the value v has
    p_n about n v 2^-mantissa exp(-n v), so the sum is about 2^-mantissa nm / (n + m)^2, 1/4 of 2^-mantissa at most
    (over a factor below 1.5 for the cells' uneven widths).
    """
    same = (a == b).mean(-1)
    chance = 1.5 * n * m / np.maximum(1, n + m) ** 2 / (1 << MANTISSA)
    return (same - chance) / (1 - chance)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 |A and B| >= percent |A or B|, on full sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(s.tobytes()) >> 1 for s in sets], np.int64)


def _sketcher(words_each: int, buckets: int, rows_each: int, with_set: bool):
    mix = np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                sets = shingle_sets(batch.column("text"), words_each)
                n = np.array([len(s) for s in sets], np.int64)
                if with_set:
                    want = batch.column("digest").to_numpy(zero_copy_only=False)
                    own = pa.array(np.flatnonzero(_digests(sets) == want))
                    items = pa.array([s.tobytes() for s in sets], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column("node").take(own), items.take(own)], ["node", "items"])
                    continue
                lo = _digests(sets)
                reg = registers(sets, buckets)
                keys = np.empty((len(sets), buckets // rows_each), np.uint64)
                for k in range(keys.shape[1]):
                    h = np.full(len(sets), k + 1, np.uint64) * mix
                    for j in range(rows_each):
                        h = mix64(h + reg[:, k * rows_each + j].astype(np.uint64) + np.uint64(1))
                    keys[:, k] = h
                yield pa.RecordBatch.from_arrays([
                    batch.column("id"), pa.array(n), pa.array(lo), pa.array([r.tobytes() for r in reg], pa.binary()), pa.array(list(_long(keys)), pa.list_(pa.int64())),
                ], ["id", "n", "digest", "reg", "keys"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _estimator(percent: int, slack: float):
    """Keep the pairs whose sizes allow a link and whose registers make one likely, with their estimate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("hub_n", "n"))
            near = estimate(_matrix(batch.column("hub_reg")), _matrix(batch.column("reg")), n, m)
            ok = pa.array((near >= slack) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)))
            yield pa.RecordBatch.from_arrays([batch.column("hub").filter(ok), batch.column("node").filter(ok), pa.array(near).filter(ok)], ["hub", "node", "near"])

    return run


def _verifier(percent: int):
    """Keep the pairs that hold on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column("hub_items"), batch.column("items"))]
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("hub").filter(ok), batch.column("node").filter(ok)], ["a", "b"])

    return run


def _core(table: pa.Table) -> pa.Table:
    """The shingles that at least half of a group's sampled sets hold."""
    sets = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
    items, held = np.unique(np.concatenate(sets), return_counts=True)
    return pa.table({"g": table.column("g").slice(0, 1), "core": pa.array([items[2 * held >= len(sets)].tobytes()], pa.binary())})


def _deviations(percent: int):
    """Each node's differences from its group's core: shingles beyond it and, under another hash, those of it that are missing.

    ``f`` is 100 for each missing one and ``percent`` for each further one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, nc, out, before, core = [], [], [], None, np.zeros(0, np.uint64)
            for x, c in zip(batch.column("items").to_pylist(), batch.column("core").to_pylist()):
                if c != before:
                    before, core = c, np.frombuffer(c, np.uint64)
                own = np.frombuffer(x, np.uint64)
                more, less = np.setdiff1d(own, core, assume_unique=True), np.setdiff1d(core, own, assume_unique=True)
                f.append(percent * len(more) + 100 * len(less))
                nc.append(len(core))
                out.append(_long(np.concatenate([more, mix64(less + np.uint64(1))])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("g"), batch.column("node"), batch.column("comp"), batch.column("j"), pa.array(f, pa.int64()), pa.array(nc, pa.int64()), pa.array(out, pa.list_(pa.int64()))],
                ["g", "node", "comp", "j", "f", "nc", "dev"],
            )

    return run


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096, run: int = 1 << 22) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, exact.

    Items that many of both sides hold are counted as products of 0/1 matrices of ``columns`` items, the others by
    their postings, about ``run`` pairs at a time; both bound the memory whatever the sets' sizes.
    """
    out = np.zeros((len(left), len(right)), np.int32)
    own, other = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    shared = np.intersect1d(own, other)
    if not len(shared):
        return out
    sides = []
    for sets, items in ((left, own), (right, other)):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(shared, items), len(shared) - 1)
        ok = shared[at] == items
        order = np.argsort(at[ok], kind="stable")
        row, at = row[ok][order], at[ok][order]
        sides.append((row, at, np.bincount(at, minlength=len(shared))))
    (lrow, lat, lmany), (rrow, rat, rmany) = sides
    pairs = lmany * rmany
    common = pairs * 32 > out.size
    dense = np.flatnonzero(common)
    for c in range(0, len(dense), columns):
        cols = dense[c:c + columns]
        parts = []
        for row, at, _ in sides:
            k = np.minimum(np.searchsorted(cols, at), len(cols) - 1)
            ok = cols[k] == at
            m = np.zeros((len(left) if len(parts) == 0 else len(right), len(cols)), np.float32)
            m[row[ok], k[ok]] = 1
            parts.append(m)
        out += (parts[0] @ parts[1].T).astype(np.int32)
    start = np.cumsum(rmany) - rmany
    rare = np.flatnonzero(~common[lat])
    many = rmany[lat[rare]]
    ends = np.cumsum(many)
    cuts = np.searchsorted(ends, np.arange(run, (ends[-1] if len(ends) else 0) + run, run), side="right")
    a = 0
    for b in [*cuts.tolist(), len(rare)]:
        if b > a:
            part, n = rare[a:b], many[a:b]
            at = np.repeat(start[lat[part]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out += np.bincount(np.repeat(lrow[part], n) * out.shape[1] + rrow[at], minlength=out.size).reshape(out.shape).astype(np.int32)
            a = b
    return out


def _across(percent: int):
    """Over one block of a group's lesser components and one block of all its nodes: links between components.

    Every pair of different components is tested, by its deviations from the group's core. Of the links found, as many
    come out as join different components: a spanning set, not all pairs.
    """

    def run(table: pa.Table) -> pa.Table:
        node, comp, f, nc = (table.column(c).to_numpy() for c in ("node", "comp", "f", "nc"))
        rest = table.column("rest").to_numpy() == 1
        dev = table.column("dev").combine_chunks()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(dev).to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat = dev.flatten().to_numpy(zero_copy_only=False)
        size = np.diff(ends)
        r, o = np.flatnonzero(rest), np.flatnonzero(~rest)
        a, b = [], []
        if len(r) and len(o):
            need = -((100 - percent) * nc[0] - f[r][:, None] - f[o][None, :]) / (100 + percent)
            near = (comp[r][:, None] != comp[o][None, :]) & (need <= np.minimum(size[r][:, None], size[o][None, :]))
            rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
            if len(rows):
                r, o = r[rows], o[cols]
                both = shared_counts([flat[ends[i]:ends[i + 1]] for i in r], [flat[ends[i]:ends[i + 1]] for i in o])
                # 100 |A and B| >= percent |A or B|, told by deviations
                link = near[np.ix_(rows, cols)] & ((100 + percent) * both.astype(np.int64) >= f[r][:, None] + f[o][None, :] - (100 - percent) * nc[0])
                label = comp.copy()
                for k in np.flatnonzero(link.any(1)).tolist():
                    js = o[link[k]]
                    for c in np.unique(label[js]).tolist():
                        if c != label[r[k]]:
                            a.append(int(node[r[k]]))
                            b.append(int(node[js[label[js] == c][0]]))
                            label[label == c] = label[r[k]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


class Scratch:
    """Tables written on the way to a result, removed together once nothing reads them."""

    def __init__(self) -> None:
        self.held: list[tuple[DataFrame, str]] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.held.append(materialise(df, name))
        return self.held[-1][0]

    def drop(self) -> None:
        for df, path in self.held:
            drop_scratch(df.sparkSession, path)
        self.held = []


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, comp): the smallest node reachable from each node of ``links`` (a, b).

    Alternating large-star and small-star steps until a round changes nothing. Each step's links and minima are
    written to the shared folder, which cuts lineage and leaves plain joins, whose hot keys Spark can split; the
    minima themselves are combined before the shuffle.
    """
    spark = links.sparkSession

    def lowest(edges: DataFrame) -> tuple[DataFrame, str]:
        return materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "low")

    edges, path = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    tag = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = tag(edges)
    for _ in range(rounds if before[0] else 0):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low, low_path = lowest(both)
        # large star: every larger neighbour of u is tied to the least of u and its neighbours
        large, large_path = materialise(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "edges")
        low2, low2_path = lowest(large)
        # small star: every smaller neighbour of u, and u itself, is tied to the least of them
        tied = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v")))
        new, new_path = materialise(tied.distinct(), "edges")
        after = tag(new)
        for p in (path, low_path, large_path, low2_path):
            drop_scratch(spark, p)
        edges, path = new, new_path
        if before == after:  # the same number of links and the same sum of their hashes
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("the links did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _contract(comp: DataFrame, links: DataFrame, keep: Scratch) -> tuple[DataFrame, DataFrame]:
    """(node, comp) after the links (a, b) of nodes have joined the components they touch, and (comp, top): what became of each."""
    ends = links.join(comp.select(F.col("node").alias("a"), F.col("comp").alias("x")), "a", "left").join(comp.select(F.col("node").alias("b"), F.col("comp").alias("y")), "b", "left")
    over = keep(components(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))).select(F.col("node").alias("comp"), F.col("comp").alias("top")), "over")
    moved = comp.join(over, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    new = over.select(F.col("comp").alias("node"), F.col("top").alias("comp")).join(comp.select("node").distinct(), "node", "left_anti")
    return keep(moved.unionByName(new), "comp"), over


def near_duplicates(
    docs: DataFrame, words_each: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text",
    buckets: int = 80, rows_each: int = 4, block: int = 2048, sampled: int = 15,
) -> DataFrame:
    """Components of documents linked by 100 |A and B| >= percent |A or B| over word shingles.

    1. Every text becomes its shingle set's digest and ``buckets`` HyperMinHash registers; equal sets collapse to one
       node, the smallest id (any number of copies costs one row each).
    2. Bands of ``rows_each`` registers give each node 20 keys. In every bucket the least and the greatest node are
       the hubs. Registers travel to the pairs of hub and member, and only pairs that pass the corrected estimate
       fetch full sets: first each node's most popular hub, then the pairs that those links do not tie already.
    3. A bucket whose nodes lie in more than one component is open; nodes of open buckets with the same main component
       form a group. A group's core C holds the shingles that half of ``sampled`` of its nodes share. Told by
       deviations from C (m missing, x further shingles), A and B are linked exactly if
       (100 + percent) s >= f(A) + f(B) - (100 - percent) |C|, with f = 100 m + percent x and s the deviations they
       share. So a pair that shares none is linked only if both are linked to the node of least f, the centre. In groups
       of more than one block the centre is compared with all others first. Any C gives right results; a good one
       leaves little to do.
    4. Groups that are still open compare the nodes outside their main component with all others, by deviations, in
       blocks of about ``block`` nodes and 512 deviations a node: each pair of blocks is a task of its own. Rows are
       linear in a group's size as long as one block holds what the centre leaves; beyond, a row is repeated once for
       every block of them. No link that banding can see is lost, and no task grows with a group.

    In buckets of up to three nodes the two hubs have met all others, so these are never open; the same link
    test holds at every size, and ``block`` and ``sampled`` change the work, not the result. At the threshold a pair
    misses all bands with probability (1 - 0.85^4)^20, about 4e-7; the estimate's margin is over five standard
    deviations. Null and empty texts have size 0, link with nothing and stay; ids that are null are kept as
    documents of their own, linked with nothing; of repeated ids the texts all count, under that id. Texts of any
    length are read whole. Other columns are ignored. An empty table gives no rows. The session's Arrow batches are
    held to 2,000 rows. Result: doc_id, n_shingles, component_id, kept.
    """
    wide_rows(docs)
    keep = Scratch()
    share = percent / 100
    slack = share - 5.5 * float(np.sqrt(share * (1 - share) / buckets)) - 0.005
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketch, _ = materialise(rows.mapInArrow(_sketcher(words_each, buckets, rows_each, False), "id long, n long, digest long, reg binary, keys array<long>"), "sketch")
    copies = sketch.where("n > 0 and id is not null").groupBy("digest", "n").agg(F.min_by(F.struct("reg", "keys"), "id").alias("best"), F.min("id").alias("doc"))
    nodes = keep(copies.select(F.xxhash64("digest", "n").alias("node"), "doc", "digest", "n", "best.reg", "best.keys"), "nodes")
    bands = nodes.select("node", "n", F.explode("keys").alias("key"))
    hubs = keep(bands.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("hub2"), F.count("*").alias("size")).where("size > 1"), "hubs")
    members = keep(bands.join(hubs, "key"), "members")

    stars = members.select(F.explode(F.array("hub", "hub2")).alias("hub"), "node").where("hub <> node").distinct()
    drawn = nodes.select("node", "reg", "n")
    pairs = stars.join(drawn, "node").join(drawn.select(F.col("node").alias("hub"), F.col("reg").alias("hub_reg"), F.col("n").alias("hub_n")), "hub")
    near = keep(pairs.mapInArrow(_estimator(percent, slack), "hub long, node long, near double"), "near")
    used = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "digest", F.col("doc").alias("id"))
    texts = rows.where("id is not null").join(used, "id").select("node", "digest", "text")
    sets = keep(texts.mapInArrow(_sketcher(words_each, buckets, rows_each, True), "node long, items binary").dropDuplicates(["node"]), "sets")

    def verified(some: DataFrame) -> DataFrame:
        both = some.select("hub", "node").join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("items").alias("hub_items")), "hub")
        return keep(both.mapInArrow(_verifier(percent), "a long, b long"), "links")

    # each node meets the hub that most nodes are near to; pairs that this one link each has tied already need no more
    degree = near.groupBy("hub").agg(F.count("*").alias("degree"))
    best = near.join(degree, "hub").groupBy("node").agg(F.max_by("hub", F.struct("degree", "hub")).alias("hub"))
    first = verified(keep(best, "best"))
    tied = first.select(F.col("b").alias("node"), F.col("a").alias("x"))
    ends = near.join(tied, "node", "left").join(tied.select(F.col("node").alias("hub"), F.col("x").alias("y")), "hub", "left")
    apart = ends.where((F.coalesce("x", "node") != F.coalesce("y", "hub")) & ~F.col("x").eqNullSafe(F.col("hub")) & ~F.col("y").eqNullSafe(F.col("node")))
    comp = keep(components(first.unionByName(verified(apart))), "comp")

    def main_of(state: DataFrame, key: str) -> DataFrame:
        """The largest component of each key whose nodes lie in several, with counts."""
        by_comp = state.groupBy(key, "comp").agg(F.count("*").alias("m"), F.sum("w").alias("w"))
        every = by_comp.groupBy(key).agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.max("m").alias("main_size"), F.sum("m").alias("size"), F.sum("w").alias("mass"), F.count("*").alias("parts"))
        return every.where("parts > 1").drop("parts")

    state = keep(members.select("key", "node", "n").join(comp, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"), F.col("n").alias("w")), "state")
    open_ = keep(main_of(state, "key").where("size > 3").select("key", F.col("main").alias("g")), "open")
    groups = keep(state.join(open_, "key").select("g", "node", "comp", "w").distinct(), "groups")
    parts = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("mass") / (512 * block))).cast("int")
    sizes = keep(groups.groupBy("g").agg(F.count("*").alias("size"), F.sum("w").alias("mass")).select("g", parts.alias("parts")), "sizes")
    spread = lambda c: F.pmod(F.xxhash64(F.lit(3), "node"), F.col(c)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j")
    drawn = groups.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64(F.lit(5), "node"), "node"))).where(F.col("k") <= sampled)
    cores = keep(drawn.join(sets, "node").select("g", "items").groupBy("g").applyInArrow(_core, "g long, core binary"), "cores")
    placed = groups.join(sizes, "g").select("g", "node", "comp", spread("parts").alias("j")).join(sets, "node").join(cores.join(sizes, "g").select("g", each, "core"), ["g", "j"])
    devs = keep(placed.select("g", "node", "comp", "j", "items", "core").mapInArrow(_deviations(percent), "g long, node long, comp long, j int, f long, nc long, dev array<long>"), "devs")
    state = devs.select("g", "node", "comp", "f", "nc", "dev", F.size("dev").alias("w"))
    large = sizes.where("parts > 1")
    if not large.isEmpty():
        least = devs.join(large, "g", "left_semi").groupBy("g").agg(F.min(F.struct("f", "node")).alias("b")).select("g", F.col("b.node").alias("node"))
        centres = keep(devs.join(least, ["g", "node"]).join(sizes, "g").select("g", F.col("node").alias("c_node"), F.col("comp").alias("c_comp"), F.col("f").alias("c_f"), F.col("dev").alias("c_dev"), each), "centres")
        met = devs.join(centres, ["g", "j"]).where((F.col("comp") != F.col("c_comp")) & ((100 + percent) * F.size(F.array_intersect("dev", "c_dev")) >= F.col("f") + F.col("c_f") - (100 - percent) * F.col("nc")))
        comp, over = _contract(comp, keep(met.select(F.col("node").alias("a"), F.col("c_node").alias("b")), "links"), keep)
        state = keep(state.join(over, "comp", "left").withColumn("comp", F.coalesce("top", "comp")).drop("top"), "state")
    blocks = keep(main_of(state, "g").select("g", "main", parts.alias("all_blocks"), F.ceil(parts * (F.col("size") - F.col("main_size")) / F.col("size")).cast("int").alias("rest_blocks")), "blocks")
    left = state.join(blocks, "g")
    columns = ["g", "node", "comp", "f", "nc", "dev"]
    rest = left.where("comp <> main").select(*columns, F.lit(1).alias("rest"), spread("rest_blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("j"))
    every = left.select(*columns, F.lit(0).alias("rest"), F.explode(F.sequence(F.lit(0), F.col("rest_blocks") - 1)).alias("i"), spread("all_blocks").alias("j"))
    more = keep(rest.unionByName(every).groupBy("g", "i", "j").applyInArrow(_across(percent), "a long, b long"), "links")
    if not more.isEmpty():
        comp, _ = _contract(comp, more, keep)

    placed = keep(nodes.select("node", "doc", "digest", "n").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "placed")
    least = placed.groupBy("comp").agg(F.min("doc").alias("component_id"))
    of_set, _ = materialise(placed.join(least, "comp").select("digest", "n", "component_id"), "of-set")
    keep.drop()
    return (
        sketch.select(F.col("id"), "n", "digest").join(of_set, ["digest", "n"], "left")
        .select(
            F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
            F.when(F.col("id").isNull(), F.col("id")).otherwise(F.coalesce("component_id", "id")).alias("component_id"),
        )
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
    )
