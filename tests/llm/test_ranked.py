"""Ranked search against plain sums, and its parts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from postmill.llm import queries, ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(docs, items, k=20):
    of = lambda t: TERM.findall((t or "").translate(LOW))
    counts = [(d, Counter(of(t))) for d, t in docs]
    n_docs = sum(1 for _, c in counts if c)
    length = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for i, text in items:
        best = {}
        for d, c in counts:
            if d is None or i is None:
                continue
            m = 75 + 25 * sum(c.values()) * n_docs // max(1, length)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in of(text) if t in c)
            best[d] = max(best.get(d, 0), s)
        out += [(i, r + 1, d, s) for r, (d, s) in enumerate(sorted(((d, s) for d, s in best.items() if s > 0), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


def rows_of(df):
    return sorted((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize("block_bytes", [4 << 20, 300])
def test_equals_plain_sums(spark, block_bytes):
    rnd = random.Random(3)
    words = ["the", "of", "Äpfel", "ÄPFEL", "b2b", "x"] + [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(words[min(int(rnd.expovariate(0.08)), len(words) - 1)] + rnd.choice(["", ".", "-", "\n"]) for _ in range(n))
    docs = [(i, text(rnd.randint(0, 80))) for i in range(300)] + [(400 + i, "the same w1 w2") for i in range(150)] + [(700, None), (701, ""), (702, " .. ")]
    items = [(i, text(rnd.randint(1, 20))) for i in range(25)] + [(30, None), (31, ""), (32, "nothing9 of that"), (33, "the the THE w1")]
    got = ranked.ranked_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame(items, "item_id long, text string"), k=7, block_bytes=block_bytes)
    assert rows_of(got) == plain_search(docs, items, 7)


def test_odd_rows(spark):
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    docs = [(1, "apple pear", "a"), (1, "apple pear", "a"), *[(2, "apple", "b")] * 40, (3, None, "c"), (None, "apple pear", "d"), (4, "plum", "e"), (5, "apple plum fig", "f"), (6, long, "g"), (7, long + " fig", "h"), (5, "fig", "f")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id string").selectExpr("*", "'mine' as score", "1 as rank", "2 as n", "3 as terms")
    items = spark.createDataFrame([(1, "apple pear fig", 0), (1, "apple pear fig", 0), (None, "apple", 0), (2, None, 0), (3, "word3 fig", 0)], "item_id long, text string, doc_id int")
    got = rows_of(ranked.ranked_search(frame, items, k=3))
    kept = [(d, t) for d, t, _ in docs if d is not None]
    assert got == plain_search(kept, [(1, "apple pear fig"), (3, "word3 fig")], 3)
    assert ranked.ranked_search(frame.limit(0), items).count() == 0
    assert ranked.ranked_search(frame, items.limit(0)).count() == 0


def test_radix_order():
    rnd = np.random.default_rng(4)
    for top in (1, 1 << 10, 1 << 20, 1 << 40, 1 << 62):
        keys = rnd.integers(0, top, 5000)
        assert (ranked.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    assert len(ranked.radix_order(np.zeros(0, np.int64))) == 0


def test_query_equals_plain_sums(spark, data):
    rows = lambda name, key: [(r[0], r[1]) for r in spark.read.parquet(f"{data}/{name}.parquet").select(key, "text").collect()]
    assert rows_of(queries.op12_ranked_search(spark, data)) == plain_search(rows("documents", "doc_id"), rows("benchmark", "item_id"))
