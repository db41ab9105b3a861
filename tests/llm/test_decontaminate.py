import random

import numpy as np

from postmill.llm import decontaminate as D

ITEMS = [(1, "What is the capital city of the northern province, and how many bridges cross its river?"), (2, "Name three alloys; give for each the two metals that it is made of most often."), (3, "tiny"), (4, None), (5, "")]


def edits_brute(item, text):
    """Least edits of the item to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for k, c in enumerate(item, 1):
        new = [k]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def mutate(rng, text, n):
    t = list(text)
    for _ in range(n):
        i = rng.randrange(len(t))
        k = rng.randrange(3)
        if k == 0:
            t[i] = rng.choice("abcdefgh")
        elif k == 1:
            t.insert(i, rng.choice("abcdefgh"))
        elif len(t) > 1:
            del t[i]
    return "".join(t)


def test_items_within_the_budget_are_found_and_no_others():
    rng = random.Random(6)
    bench = D.Benchmark.build([(i, t) for i, t in ITEMS if t])
    assert bench.ids == [1, 2, 3]
    for _ in range(120):
        k = rng.randrange(2)
        source = bench.texts[k].decode()
        words = lambda n: " ".join("".join(rng.choice("klmnopqrst") for _ in range(5)) for _ in range(n))
        text = words(30) + mutate(rng, source, rng.randrange(0, 16)) + words(30)
        norm = D.normalise(text)
        want = {i for i in range(2) if edits_brute(bench.texts[i], norm) <= bench.budget[i]}
        got = D.find_items(norm, bench)
        assert {i for i, *_ in got} == want
        for i, s, e, n in got:
            assert edits_brute(bench.texts[i], norm[max(0, s - 1):e + 1]) <= n and n == edits_brute(bench.texts[i], norm)


def test_copies_that_follow_at_once_are_all_found():
    rng = random.Random(8)
    bench = D.Benchmark.build([(i, t) for i, t in ITEMS if t])
    for n in range(60):
        k = n % 2
        source = bench.texts[k].decode().strip()
        gap = " ".join(["", *["zq"] * (n % 5), ""])
        copies = [mutate(rng, source, rng.randrange(4)) for _ in range(rng.randrange(1, 5))]
        norm = D.normalise("klm nop " + gap.join(copies) + " qrs tuv")
        got = [g for g in D.find_items(norm, bench) if g[0] == k]
        assert len(got) == len(copies) and all(b[1] >= a[2] - 1 for a, b in zip(got, got[1:])), (copies, got)
        for g, c in zip(got, copies):
            assert g[3] <= edits_brute(bench.texts[k], D.normalise(c)) and abs(g[2] - g[1] - len(D.normalise(c))) <= 8


def test_normalised_positions():
    for t in ["  Ab — c!", "", "…", "É x.Y", "a", "İstanbul «q» 12", "x　y"]:
        norm = D.normalise(t)
        at = D.source_positions(t)
        assert len(at) == len(norm)
        for b, i in zip(norm, at):
            if 97 <= b < 123 and t[i].isascii():
                assert t[i].lower() == chr(b)


def test_rows(spark, docs_of):
    item = ITEMS[0][1]
    texts = ["lead in. " + item.upper().replace(",", " --") + " tail", "clean text of no concern", None, "", item, "x " * 50_000 + item, item]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: r.matches for r in D.contamination(docs_of(texts, extra=True), bench).collect()}
    assert [[m.item_id for m in got[i]] for i in range(7)] == [[1], [], [], [], [1], [1], [1]]
    m = got[0][0]
    assert texts[0][m.start:m.end].startswith("WHAT IS") and texts[0][m.start:m.end].endswith("RIVER") and m.edits == 0
    many = {r.doc_id: [m.item_id for m in r.matches] for r in D.contamination(docs_of(texts), bench, block_bytes=10).collect()}
    assert many == {k: [m.item_id for m in v] for k, v in got.items()}
    left = D.drop_contaminated(docs_of(texts, extra=True), bench)
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 3] and left.columns == docs_of(texts, extra=True).columns
    assert D.contamination(docs_of([]), bench).count() == 0
    assert all(r.matches == [] for r in D.contamination(docs_of(texts), bench.limit(0)).collect())


def test_short_items_are_found_whole(spark, docs_of):
    items = [(1, "blue moon tea"), (2, "tiny"), (3, "a b"), (4, "no"), (5, "Blue moon"), (6, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = ["we drank Blue-Moon  tea.", "tinyish notes", "TINY!", "say no, no", "a (b) a b", "blue moons", None, ""]
    want = [[1, 5], [], [2], [4, 4], [3, 3], [], [], []]
    for held in (1_000_000, 0):
        got = {r.doc_id: [m.item_id for m in r.matches] for r in D.contamination(docs_of(texts), bench, held_bytes=held).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_a_large_benchmark_is_joined_with_the_same_matches(spark, docs_of):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 16)))) for i in range(300)]
    items += [(7, items[7][1]), (301, "of the " * 9)]
    texts = []
    for k in range(150):
        inner = mutate(rng, items[rng.randrange(len(items))][1], rng.randrange(6)) if k % 2 else ""
        texts.append(" ".join(word() for _ in range(30)) + " of the " + inner + " " + " ".join(word() for _ in range(30)))
    texts += [None, "", texts[1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    small = D.contamination(docs_of(texts, extra=True), bench, block_bytes=200)
    large = D.contamination(docs_of(texts, extra=True), bench, held_bytes=0)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    a, b = (D.drop_contaminated(docs_of(texts, extra=True), bench, held_bytes=h) for h in (1_000_000, 0))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.columns == b.columns
    assert D.contamination(docs_of(texts), bench.where("text = '...'"), held_bytes=-1).where("size(matches) > 0").count() == 0


def test_python_stages_do_not_grow_with_the_benchmark(spark, docs_of):
    plans = []
    for n in (10, 1000):
        bench = spark.createDataFrame([(i, f"item number {i} of a benchmark that goes on with more and more items {i * 7919}") for i in range(n)], "item_id long, text string")
        plans += [D.contamination(docs_of(["some text"]), bench, block_bytes=200, held_bytes=h)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") for h in (10_000_000, 0)]
    assert plans[:2] == plans[2:] and plans[0] == 1


def test_qgrams_are_windows():
    data = b" abcabcabc "
    g = D.qgrams(data, 4)
    assert len(g) == len(data) - 3 and g[1] == g[4] == g[7 - 3] and np.unique(g).size == len({data[i:i + 4] for i in range(len(data) - 3)})
