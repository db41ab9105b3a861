"""Token counts against the tokenizers library, and the machines' parts."""

import json
import random

import numpy as np
import pytest

from postmill.llm import queries, tokencount as T

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    tok = tokenizers.Tokenizer.from_file(T.MODEL)
    return lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def counted(spark):
    return lambda texts, **o: [r.n_tokens for r in T.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **o).orderBy("doc_id").collect()]


def test_words_and_quotes(counted, library):
    rnd = random.Random(5)
    parts = [*"abcdeslmtvr' \n\t!1éß漢", " ", "　", "'s", "'re", "'ll", "'", "  ", " the", "<|endoftext|>", "<|end"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(4000)]
    assert counted(texts) == library(texts)


def test_any_characters(counted, library):
    rnd = random.Random(6)
    one = lambda: chr(rnd.choice([rnd.randint(32, 126), rnd.randint(128, 0x2FFF), rnd.randint(0x3000, 0xD7FF), rnd.randint(0x10000, 0x3FFFF)]))
    texts = ["".join(one() for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    assert counted(texts) == library(texts)


def test_words_beyond_a_chunk(counted, library):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (4095, 4096, 4097, 12_000)]
    texts += ["a" * 9000, "漢字" * 3000, "=" * 9000, " " * 9000, "\n" * 5000 + "x", "ab" * 5000, "".join(rnd.choice("ab") for _ in range(9000))]
    assert counted(texts) == library(texts)


def test_texts_in_pieces(counted, library):
    rnd = random.Random(8)
    text = "".join(rnd.choice(["word", " ", "  ", "\n", "it's ", "'re", "é", "x" * 90, "<|endoftext|>"]) for _ in range(6000))
    assert "".join(p.decode() for p in T.pieces_of(text.encode(), 500)) == text
    assert counted([text, "no cut " * 3, "y" * 4000, "tail "], giant=500) == library([text, "no cut " * 3, "y" * 4000, "tail "])


def test_prefix_scan():
    rnd = np.random.default_rng(9)
    maps = rnd.integers(0, 9, (37, 9), dtype=np.uint8)
    maps[5] = 3
    got, state = T.compose(maps)[:, 0], 0
    for row, end in zip(maps, got):
        state = row[state]
        assert state == end
    words = T.WordMachine()
    for n in (1, 7, 63, 64, 65, 128, 1000):  # chunks of any width mark the same words
        cls = rnd.integers(0, 10, n).astype(np.uint8)
        cls[0] += T.FIRST
        one = words.starts(cls, width=n)
        assert all((words.starts(cls, width=w) == one).all() for w in (1, 3, 16, 64))


def test_odd_rows(spark, library):
    long = " ".join(f"word{i % 977} and{i}" for i in range(30_000))
    rows = [(1, "plain"), (1, "plain"), (2, None), (3, ""), (None, "no id"), (4, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'mine' as n_tokens", "1 as n_bytes")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in T.count_tokens(df).collect())
    want = [(d or 0, len((t or "").encode()), n, n > 1024) for (d, t), n in zip(rows, library([t or "" for _, t in rows]))]
    assert got == sorted(want)
    assert T.count_tokens(df.limit(0)).count() == 0
    broken = spark.sql("select 1 as doc_id, cast(x'61ff62' as string) as text")
    assert [(r.n_bytes, r.n_tokens) for r in T.count_tokens(broken).collect()] == [(3, library(["a�b"])[0])]


def test_other_files_are_refused(tmp_path):
    spec = json.load(open(T.MODEL, encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        T.ByteMachine(str(tmp_path / "t.json"))


def test_query_equals_the_library(spark, data, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in queries.op13_token_counts(spark, data).collect()}
    assert {d: r.n_tokens for d, r in got.items()} == dict(zip(docs, library(list(docs.values()))))
    assert all(r.n_bytes == len(docs[d].encode()) and r.over_limit == (r.n_tokens > 1024) for d, r in got.items())
