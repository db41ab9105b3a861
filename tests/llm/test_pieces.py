import os
import random

import numpy as np
import pyarrow as pa
import pytest

from postmill.llm import pieces as P

pytestmark = pytest.mark.skipif(not os.path.exists(P.MODEL), reason="no tokenizer files")
TEXTS = ["", "Hello  world", " lead and trail ", "▁ literal ▁▁", "日本語のテキスト🙂 mixed\ttabs\n\nlines", "a" * 300, "nul \0 char", "    four", "x", "supercalifragilistic " * 30, None]


@pytest.fixture(scope="module")
def voc():
    return P.load_vocabulary()


def score_of(voc, ids, text):
    """Sum of piece scores; a run of byte pieces of one character costs what an unknown character does."""
    value = {int(i): int(s) for i, s in zip(voc.ids, voc.scores)}
    total, k, bytes_ = 0, 0, set(voc.byte_ids.tolist())
    while k < len(ids):
        if ids[k] in bytes_:
            b = int(np.flatnonzero(voc.byte_ids == ids[k])[0])
            total += voc.unknown
            k += 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        else:
            total += value[ids[k]]
            k += 1
    return total


def test_round_trip_and_brute_force(voc):
    ids, scores = voc.encode(pa.array(TEXTS))
    assert voc.decode(ids).to_pylist() == [t or "" for t in TEXTS]
    for t, i, s in zip(TEXTS, ids.to_pylist(), scores):
        best = voc.forward(" " + t)[-1] if t else 0
        assert s == best == score_of(voc, i, t)


def test_equals_the_library(voc):
    import sentencepiece

    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    m = pb.ModelProto()
    m.ParseFromString(open(P.MODEL, "rb").read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        if p.type == 1:
            p.score = voc.table[p.piece.replace("▁", " ")][1] / P.UNIT
    lib = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    texts = [t for t in TEXTS if t and "▁" not in t and "a" * 300 != t] + ["The quick brown fox jumps over the lazy dog, twice."]
    for t, ids in zip(texts, voc.encode(pa.array(texts))[0].to_pylist()):
        assert score_of(voc, lib.encode(t), t) == score_of(voc, ids, t)


def by_chunks(voc, s, chunk):
    """Ids of ``s`` (with its blank in front) by the scan over chunks."""
    n = (len(s) - 1) // chunk + 1
    cut = [(s[k * chunk:(k + 1) * chunk], s[(k + 1) * chunk:(k + 1) * chunk + voc.longest - 1]) for k in range(n)]
    v = [x.tolist() for x in P.scan_scores([voc.transfer(*c) for c in cut])]
    exits = P.scan_exits([voc.entries(*c, x) for c, x in zip(cut, v)])
    return [i for c, x, e in zip(cut, v, exits) for i in voc.between(*c, x, e).tolist()]


@pytest.mark.parametrize("chunk", [1, 2, 5, 16, 17, 40, 128, 1000])
def test_chunks_give_the_same_ids(voc, chunk):
    rng = random.Random(chunk)
    base = "the internationalisation of under­standing 日本 and \n so on, with extraordinary words aaaaaaa     x ----- 1234567".split(" ")
    for case in range(12):
        s = " " + ("" if case % 3 == 0 else " ").join(rng.choice(base) for _ in range(40))
        ids = by_chunks(voc, s, chunk)
        assert ids == voc.encode(pa.array([s[1:]]))[0][0].as_py()
        assert voc.decode(pa.array([ids], pa.list_(pa.int32()))).to_pylist() == [s[1:]]


def own_vocabulary(words, score):
    """A small unigram vocabulary with scores of its own."""
    pieces = ["<unk>", *[f"<0x{b:02X}>" for b in range(256)], *words]
    return P.Vocabulary(pieces, [0.0] * 257 + [score(w) for w in words], [True] * 257 + [False] * len(words), list(range(1, 257)))


def test_real_scores_and_ties():
    """Segmentations by real-valued scores, and by scores under which nearly everything ties, equal brute force."""
    words = ["▁", "a", "b", "c", "ab", "ba", "abc", "bca", "▁a", "▁ab", "aa", "aaa", "▁b", "cab"]
    rng = random.Random(3)
    for score in (lambda w: -rng.random() * 9 - 0.5, lambda w: -float(len(w)) - 0.25, lambda w: -0.5 * len(w)):
        voc = own_vocabulary(words, score)
        value = {k: s for k, (_, s) in voc.table.items()}
        for _ in range(40):
            t = "".join(rng.choice("aabbc  x") for _ in range(rng.randrange(1, 14)))
            s, found = " " + t, []

            def walk(p, path, total):
                if p == len(s):
                    found.append((total, path))
                for k in range(1, min(voc.longest, len(s) - p) + 1):
                    u = s[p:p + k]
                    if u in value:
                        walk(p + k, [*path, u], total + value[u])
                    elif k == 1:
                        walk(p + k, [*path, u], total + voc.unknown)

            walk(0, [], 0)
            top = max(x for x, _ in found)
            want = max((p for x, p in found if x == top), key=lambda p: [len(u) for u in reversed(p)])
            ids = [i for u in want for i in ([voc.table[u][0]] if u in value else voc.byte_ids[list(u.encode())].tolist())]
            assert voc.encode(pa.array([t]))[0][0].as_py() == ids, t
            for chunk in (1, 2, 3, 5):
                assert by_chunks(voc, s, chunk) == ids, (t, chunk)


def test_max_plus_is_associative():
    rng = np.random.default_rng(0)
    a, b, c = (rng.integers(-50, 0, (5, 5)) for _ in range(3))
    assert (P.max_plus(P.max_plus(a, b), c) == P.max_plus(a, P.max_plus(b, c))).all()


def test_documents(spark, docs_of, voc):
    texts = [*TEXTS, "word " * 500 + "end", "z" * 700, "word " * 500 + "end", "extra long text " * 9000, "q" * 70_000]
    docs = docs_of(texts, extra=True)
    whole = {r.doc_id: r for r in P.decode_documents(P.encode_documents(docs, voc, chunk_chars=1 << 30), voc).collect()}
    for chunk in (64, 65_536):
        got = {r.doc_id: r for r in P.encode_documents(docs, voc, chunk_chars=chunk, verify=True).collect()}
        assert len(got) == len(whole) == len(texts)
        for i, t in enumerate(texts):
            assert got[i].round_trip and whole[i].decoded == (t or "")
            assert got[i].ids == whole[i].ids
    assert P.encode_documents(docs_of([]), voc).count() == 0
