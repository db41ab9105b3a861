import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from postmill.llm import common, language, quality, queries, toxicity


def test_segments_equal_the_recursive_definition():
    def brute(s):
        def rec(a, b):
            best = None
            for i in range(a, b):
                t = 0.0
                for j in range(i, b):
                    t += s[j]
                    if t > 0 and (best is None or t > best[0]):
                        best = (t, i, j + 1)
            return [] if best is None else rec(a, best[1]) + [best[1:]] + rec(best[2], b)

        return rec(0, len(s))

    rng = random.Random(0)
    for _ in range(800):
        s = [rng.uniform(-2, 2) for _ in range(rng.randrange(14))]
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(s)] == brute(s)


def corpus(spark, n=500):
    rng = random.Random(3)
    calm = ["river", "garden", "window", "letter", "music", "paper", "winter", "market", "bridge", "story"]
    rude = ["grumbleworth", "snarkle", "vexhole"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        junk = i % 5 == 0
        w = [rng.choice(calm) for _ in range(rng.randrange(30, 80))]
        if toxic:
            at = rng.randrange(len(w))
            w[at:at] = [rng.choice(rude) for _ in range(5)]
        if junk:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, int(not junk), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_and_quality(spark):
    docs, labels = corpus(spark)
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "grumbleworth " * 3, "en", "s", 1)] * 2, docs.schema)
    truth = {r.doc_id: r for r in labels.collect()}
    tox = toxicity.toxicity_report(docs.unionByName(odd), labels.withColumn("text", F.lit("clash"))).collect()
    assert len(tox) == 506 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in tox)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in tox)
    held = [r for r in tox if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id].toxic for r in held]) > 0.95
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in held:
        for p in r.passages:
            assert texts[r.doc_id][p.start:p.end].strip() and not texts[r.doc_id][p.start:p.end].startswith(" ")
    q = quality.quality_report(docs.unionByName(odd), labels).collect()
    assert np.mean([r.predicted == truth[r.doc_id].quality for r in q if r.held_out and r.doc_id in truth]) > 0.95
    assert {r.doc_id: r.score for r in q}[9001] == {r.doc_id: r.score for r in q}[9002]


def test_toxic_scores_equal_brute_force(spark):
    """Segments by their recursive definition over every token, and the extreme-value sums as their formulas stand."""
    import math
    import re

    docs, labels = corpus(spark, 300)
    model = toxicity.train_toxicity(docs, labels)
    long = " ".join(["river", "grumbleworth", "snarkle snarkle"] * 700)
    rows = [(r.doc_id, r.text) for r in docs.limit(40).collect()] + [(9001, None), (9002, ""), (9003, long), (9003, long), (9004, "grumbleworth")]
    got = toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as score", "1 as passages"), model).collect()
    assert len(got) == len(rows)
    score = {r.doc_id: r.score for r in got}
    for d, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        each = [model.token_score(w.lower()) for w in words]
        each = [min(x, model.drift) if k and words[k].lower() == words[k - 1].lower() else x for k, x in enumerate(each)]
        norm = sorted((model.scale * v - model.log_k - math.log(max(len(words), 1)) for *_, v in toxicity.maximal_segments(each)), reverse=True)
        best, total = 0.0, 0.0
        for r, v in enumerate(norm, 1):
            total += v
            x = max(total, 1e-6)
            if x >= r:
                best = max(best, x - (r - 1) * math.log(x) + math.lgamma(r + 1) + math.lgamma(r))
        stats = [min(20, max(-5, norm[0])) if norm else -5, min(50.0, best)]
        w = model.calibration
        assert abs(score[d] - 1 / (1 + math.exp(-(stats[0] * w[0] + stats[1] * w[1] + w[2])))) < 1e-9, d


def test_models_without_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = docs_of(["a b c", None, ""])
    assert [r.score for r in toxicity.toxicity_report(docs, none).collect()] == [0.5] * 3
    assert [r.score for r in quality.quality_report(docs, none).collect()] == [0.5] * 3
    assert quality.quality_report(docs_of([]), none).count() == toxicity.toxicity_report(docs_of([]), none).count() == 0


def test_additive_model_is_a_sum_of_tables():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = quality.fit_additive(x, y, np.ones(len(y)))
    assert (0, 1) in m.pairs and ((m.score(x) > 0.5) == y).mean() > 0.85  # an interaction no sum of single features shows


def test_features_ignore_array_offsets():
    texts = ["Zeile eins\nZeile eins", "ÀB cd", None, "", "x | y | z 12"]
    whole = quality.features(pa.array(texts))
    for i in range(5):
        assert np.allclose(quality.features(pa.array(texts).slice(i, 1))[0], whole[i])
    assert (whole[2] == 0).all() and (whole[3] == 0).all()


def test_words_are_split_as_specified():
    import re

    texts = ["  A b\t\tC d\x0be\x1ff ", "", None, "É\nx", "a b"]
    offsets, code, words = common.split_words(pa.array(texts))
    w = words.to_pylist()
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    for i, t in enumerate(texts):
        assert [w[c] for c in code[offsets[i]:offsets[i + 1]]] == re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))


def test_codewords_keep_their_distance():
    for n in (2, 3, 4, 5, 9, 40):
        c = language.codewords(n)
        d = min((a != b).sum() for i, a in enumerate(c) for b in c[:i])
        assert d >= (1 if n == 2 else 2 if n == 3 else 4)


def test_language(spark):
    rng = random.Random(8)
    stock = {"aa": ["kalo", "mira", "sune"], "bb": ["zwert", "pfing", "schob"], "cc": ["quei", "aux", "eau"]}
    rows = [(i, " ".join(rng.choice(stock[k]) for _ in range(12)), k) for i, k in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 34 !!", "bb"), (903, "kalo mira", None), (903, "kalo mira", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = language.identify_language(docs, language.train_language(docs)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == k for i, _, k in rows[:180]) and {by[i].lang_pred for i in (900, 901, 902)} == {"und"} and by[903].lang_pred == "aa"
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    blank = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language.identify_language(blank, language.train_language(blank)).first().lang_pred == "und"


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    got = queries.op9_language(spark, data).join(docs, "doc_id").where("held_out and lang is not null")
    n, right = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert right >= 0.95 * n
