"""The inverted index against plain cosines: terms, every pair, the best documents, and blocks that are skipped."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postmill.functions.text import content_terms
from postmill.operators import match
from postmill.operators.index import content_runs, text_index


def terms_of(text, stop=()):
    return [t for t in (w.rstrip(".") for w in re.findall(r"[a-z][a-z+#.]{2,}", (text or "").lower())) if t not in stop]


def plain(docs, query, stop=()):
    """Cosines with the query counted as one document more."""
    counts = {d: Counter(terms_of(t, stop)) for d, t in docs}
    q = Counter(terms_of(query, stop))
    df = Counter(t for c in [*counts.values(), q] for t in c)
    w = {t: math.log(1 + (len(docs) + 1) / (1 + n)) for t, n in df.items()}
    norm = lambda c: math.sqrt(sum((n * w[t]) ** 2 for t, n in c.items()))
    return {d: sum(n * q[t] * w[t] ** 2 for t, n in c.items() if t in q) / (norm(c) * norm(q)) for d, c in counts.items() if set(c) & set(q)}


def made(n, seed):
    rnd = random.Random(seed)
    words = ["the", "and", "c++", "c#.", "net...", "node.js", "ab", "größe", "a.b."] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(120)]
    text = lambda: rnd.choice(["", "x ", "..."]) + " ".join(words[min(int(rnd.expovariate(0.05)), len(words) - 1)] for _ in range(rnd.randint(0, 60)))
    return [(f"d{i:04d}", text()) for i in range(n)] + [("none", None), ("empty", "")]


def test_terms_of_batches(spark):
    texts = [t for _, t in made(300, 1)] + ["abc", "abc", "a..", "..abc..", "zzz+", "+zz#q", "abc\nabcd", "ABC"]
    low = [t.lower() if t is not None else None for t in texts]
    doc, terms = content_runs(pa.array(low, pa.string()))
    want = [(r.i, w) for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", content_terms("t").alias("w")).orderBy("i").collect() for w in r.w]
    assert list(zip(doc.tolist(), (t.decode() if isinstance(t, bytes) else t for t in terms.to_pylist()))) == want
    assert content_runs(pa.array([], pa.string()))[1].to_pylist() == []


@pytest.mark.parametrize("stop", [(), ("the", "and")])
def test_cosines(spark, stop):
    docs = made(250, 2)
    df = spark.createDataFrame(docs, "id string, text string").repartition(3)
    index = text_index(df, "id", stop=stop, block_rows=16)
    queries = [(1, "the c++ and wabx wacx"), (2, "unknown words alone"), (3, docs[7][1]), (4, "")]
    got = {}
    for r in index.search(spark.createDataFrame(queries, "qid int, text string"), stop=stop).collect():
        got.setdefault(r.qid, {})[r.doc] = r.cosine
    for q, text in queries:
        assert got.get(q, {}) == pytest.approx(plain(docs, text, stop))
    one = match.tfidf_cosine(df, "id", spark.createDataFrame([(queries[0][1],)], "text string"), stop=stop)
    assert {r.id: r.cosine for r in one.collect()} == pytest.approx(plain(docs, queries[0][1], stop))


def test_best_documents_skip_blocks(spark):
    docs = made(400, 3) + [(f"z{i}", "rare words of one kind " * (i + 1)) for i in range(6)]
    df = spark.createDataFrame(docs, "id string, text string").coalesce(1)
    index = text_index(df, "id", block_rows=8)
    queries = [(1, "rare words of one kind"), (2, "the wabx wbbx"), (3, "nothing")]
    best, blocks = index.top(spark.createDataFrame(queries, "qid int, text string"), 4)
    got = {}
    for r in best.collect():
        got.setdefault(r.qid, []).append((r.place, r.doc, round(r.cosine, 9)))
    for q, text in queries:
        want = sorted(((-round(c, 9), d) for d, c in plain(docs, text).items()))[:4]
        assert [c for _, _, c in sorted(got.get(q, []))] == pytest.approx([-c for c, _ in want])
    read = blocks.groupBy("qid").agg(F.count("*").alias("n"), F.count_if("read").alias("read")).collect()
    assert any(r.read < r.n for r in read)  # an exact bound spared some blocks


def test_queries_open_their_shards_alone(spark):
    index = text_index(spark.createDataFrame(made(100, 4), "id string, text string"), "id", shards=16)
    asked = index.asked(spark.createDataFrame([(1, "the")], "qid int, text string"))
    plan = index._read(asked)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "FileScan parquet" in line)
    assert "PartitionFilters: [isnotnull(shard" in scan and "EqualTo(term,the)" in scan
    assert text_index(spark.createDataFrame([], "id string, text string"), "id").search(spark.createDataFrame([(1, "the")], "qid int, text string")).count() == 0


def test_no_pair_of_query_and_document_is_shuffled(spark):
    docs = made(300, 9)
    index = text_index(spark.createDataFrame(docs, "id string, text string").repartition(3), "id", block_rows=32)
    texts = spark.createDataFrame([(i, docs[i][1]) for i in range(40)] + [(40, None), (41, "unknown words")], "qid int, text string")
    found = index.search(texts)
    assert "hashpartitioning(qid" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(q, d): c for q in range(40) for d, c in plain(docs, docs[q][1]).items()}
    for rows in (found, index._scores(index.asked(texts, part=3))):  # one part of the queries, and many
        assert {(r.qid, r.doc): pytest.approx(r.cosine, abs=1e-9) for r in rows.collect()} == want
    best = index._scores(index.asked(texts, part=5), k=2).join(index.norms.select("doc", "block"), "doc")
    assert best.groupBy("qid", "block").count().agg(F.max("count")).first()[0] == 2


def overlaps(lines, docs, top):
    """Leading lines by plain sets, documents of one key together."""
    found = {}
    for d, text in docs:
        for line in lines:
            found[d, line] = found.get((d, line), 0) + len(set(terms_of(text)) & set(terms_of(line)))
    out = set()
    for d in {d for d, _ in docs}:
        best = sorted(((n, line.encode(), line) for (k, line), n in found.items() if k == d and n), reverse=True)[:top]
        out |= {(d, line, n, k) for k, (n, _, line) in enumerate(best, 1)}
    return out


def test_leading_lines_shuffle_no_texts(spark):
    docs, lines = made(150, 7), [t for _, t in made(40, 8) if t] + ["größe the net.", "größe the and", "\U0001f600 the and", "－ the and", "12 ab"]
    df = spark.createDataFrame(docs, "id string, text string")
    reference = spark.createDataFrame([(x,) for x in dict.fromkeys(lines)] + [(None,)], "line string")
    for top in (1, 3, 100):
        found = match.leading_lines(reference, df, "id", top)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in found.collect()} == overlaps(set(lines), docs, top)
    joined = match.leading_lines(reference, df, "id", 3, most_bytes=10)  # a reference text beyond the bound
    assert {tuple(r) for r in joined.collect()} == overlaps(set(lines), docs, 3) and joined.columns == found.columns
    twice = docs + [(docs[3][0], "the and net node.js"), (docs[4][0], "größe the")]  # documents that share a key
    assert {tuple(r) for r in match.leading_lines(reference, spark.createDataFrame(twice, df.schema), "id").collect()} == overlaps(set(lines), twice, 3)
    for none in (reference.limit(0), reference.where("line is null"), reference.where("line = '12 ab'")):
        assert match.leading_lines(none, df, "id").count() == 0


def gaps_of(text, query, top, show, stop=()):
    """The most frequent terms that the query lacks, by plain counts."""
    own = terms_of(text, stop)
    best = sorted(Counter(own).items(), key=lambda x: (-x[1], own.index(x[0])))[:top]
    return " ".join([t for t, _ in best if t not in terms_of(query, stop)][:show])


def test_gaps_shuffle_no_terms(spark):
    docs = made(200, 11) + [("long", " ".join(f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)))]
    df = spark.createDataFrame(docs, "id string, text string")
    for query, top, show, stop in (("the c++ and wabx", 60, 8, ()), (None, 5, 3, ("the", "net")), ("the and", 3, 100, ())):
        found = match.gaps(df, "id", spark.createDataFrame([(query,)], "text string"), top=top, show=show, stop=stop)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in found.collect()} == {(d, g) for d, t in docs if (g := gaps_of(t, query, top, show, stop))}
    twice = spark.createDataFrame([(1, "abc def"), (1, "def ghi"), (2, "xyz")], "id int, text string")  # documents that share a key
    assert {r.id: r.gaps.split()[0] for r in match.gaps(twice, "id", spark.createDataFrame([("abc",)], "text string")).collect()} == {1: "def", 2: "xyz"}
