import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from postmill.llm import neardup
from postmill.llm.neardup import near_duplicates


def brute(docs, words_each, percent):
    """(sizes, component by row) from all pairs."""
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append(frozenset([tuple(w[i:i + words_each]) for i in range(len(w) - words_each + 1)] if len(w) >= words_each else [tuple(w)] if w else []))
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = defaultdict(lambda: math.inf)
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least[root(i)], d)
    return [len(s) for s in sets], [least[root(i)] for i in range(len(docs))]


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(4000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"x{rng.randrange(9999)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("words_each", "percent", "buckets"), [(3, 85, 80), (5, 80, 128)])
def test_equals_all_pairs(spark, words_each, percent, buckets):
    rng = random.Random(11)
    # edits that put many pairs on either side of the threshold, so components hang on single links
    texts = family(rng, 150, 120, 6) + family(rng, 40, 30, 1) + family(rng, 40, 400, 12) + [f"only one {i}" for i in range(20)]
    texts += ["Same Text here", "same text HERE", "same\ttext  here\n", "hi", "hi", "HI", "hi there", None, None, "", " \t", "a b c d", "d c b a"]
    rng.shuffle(texts)
    docs = [(3 * i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(d, t, "node", 7) for d, t in docs], "doc_id long, text string, node string, comp int")
    got = {r.doc_id: r for r in near_duplicates(df, words_each, percent, buckets=buckets, block=16).collect()}
    sizes, comp = brute(docs, words_each, percent)
    assert len(got) == len(docs)
    for (d, _), n, c in zip(docs, sizes, comp):
        assert (got[d].n_shingles, got[d].component_id, got[d].kept) == (n, c, c == d)


def test_repeated_null_and_empty(spark):
    schema = "doc_id long, text string"
    t = "one two three four five six seven"
    rows = near_duplicates(spark.createDataFrame([(5, t), (5, t), (2, t), (None, t), (7, "other words entirely here")], schema)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (2, 2, True), (5, 2, False), (5, 2, False), (7, 7, True)]
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_registers_hold_zeros_and_mantissa():
    least = np.array([[1 << 63, (1 << 62) | (1 << 61), 1 << 30, (1 << 63) | (1 << 62)]], np.uint64)
    got = neardup._compress(least)[0]
    assert [int(x) >> 10 for x in got] == [0, 1, 33, 0] and [int(x) & 1023 for x in got] == [0, 512, 0, 512]


def test_estimates_follow_jaccard():
    rng = np.random.default_rng(3)
    for j in (0.0, 0.5, 0.85):
        est = []
        for _ in range(40):
            shared, own = int(600 * j), (600 - int(600 * j)) // 2
            x = [np.unique(np.concatenate([s, rng.integers(0, 1 << 63, own).astype(np.uint64)])) for s in [rng.integers(0, 1 << 63, shared).astype(np.uint64)] * 2]
            r = neardup.registers(x, 80)
            est.append(float(neardup.estimate(r[0], r[1], np.float64(len(x[0])), np.float64(len(x[1])))))
        assert abs(np.mean(est) - j) < 0.03


def test_shared_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(np.concatenate([rng.integers(0, 40, rng.integers(0, 30)), rng.integers(0, 5000, rng.integers(0, 60))])) for _ in range(60)]
    for columns, run in ((4096, 1 << 22), (8, 7)):
        got = neardup.shared_counts(sets[:25], sets[10:], columns, run)
        assert all(got[i, j] == len(np.intersect1d(sets[i], sets[10 + j])) for i in range(25) for j in range(50))
    assert neardup.shared_counts([np.zeros(0, np.int64)], [np.array([3])]).tolist() == [[0]]


def test_a_group_of_near_copies_costs_rows_in_proportion(spark, monkeypatch):
    """Doubling a group of near copies may not do much more than double what is read into the block comparisons."""
    seen = []
    across = neardup._across

    def counted(percent):
        run = across(percent)

        def count(table):
            out = run(table)
            return pa.table({"a": pa.array([table.num_rows, *out.column("a").to_pylist()], pa.int64()), "b": pa.array([table.num_rows, *out.column("b").to_pylist()], pa.int64())})

        return count

    monkeypatch.setattr(neardup, "_across", counted)
    keep = neardup.Scratch.__call__

    def note(self, df, name):
        out = keep(self, df, name)
        if name == "links":
            seen.append(out.where("a = b").agg({"a": "sum"}).first()[0] or 0)
        return out

    monkeypatch.setattr(neardup.Scratch, "__call__", note)
    rows = []
    for n in (300, 600):
        rng = random.Random(5)
        docs = list(enumerate(family(rng, n, 150, 12)))
        seen.clear()
        near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85).count()
        rows.append(max(seen))
    assert 0 < rows[1] <= 2.5 * rows[0]


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5000, 4999), (4999, 4999)]
    got = {r.node: r.comp for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert Counter(got.values()) == {0: 61, 1000: 80, 4999: 2}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0
