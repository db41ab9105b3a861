"""Language identification by error-correcting output codes over hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import bounded_sample, fit_logistic, held_out, mix64, split_words, sums_by_row, text_slices, wide_rows
from postmill.session import materialise

BINS = 1 << 14


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """An n x bits matrix of -1/1. Up to five languages: every split in two. More: the best of random codes."""
    if n <= 1:
        return np.ones((n, 1), int)
    if n <= 5:
        bits = 2 ** (n - 1) - 1
        return np.array([[1 if (k + 1) >> i & 1 else -1 for k in range(bits)] for i in range(n - 1)] + [[-1] * bits])
    rng = np.random.default_rng(seed)
    bits = 8 * int(np.ceil(np.log2(n)))
    best = None
    for _ in range(100):
        c = rng.choice((-1, 1), (n, bits))
        near = (bits - c @ c.T) / 2 + bits * np.eye(n)
        balanced = (np.abs(c.sum(0)) < n).all()
        if balanced and (best is None or near.min() > best[0]):
            best = (near.min(), c)
    return best[1]


def word_grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed byte n-grams (1 to 3, with word ends marked) of distinct words: (word, bin), and whether a word has a letter."""
    words = pc.utf8_lower(words.cast(pa.large_string()))
    words = pc.replace_substring_regex(words, r"^[^\p{L}]+|[^\p{L}]+$", "")
    letter = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    joined = pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if x is not words else x for x in ("", words, "", " ")))  # " word "
    n = len(joined)
    offs = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset:joined.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(joined.buffers()[2], np.uint8)[offs[0]:offs[-1]].astype(np.uint64) if n else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(n), np.diff(offs))
    own, bins = [], []
    for k in (1, 2, 3):
        if len(data) < k:
            continue
        h = np.full(len(data) - k + 1, k, np.uint64)
        for j in range(k):
            h = h * np.uint64(257) + data[j:len(data) - k + 1 + j]
        fine = row[: len(h)] == row[k - 1:]
        fine &= letter[row[: len(h)]]
        own.append(row[: len(h)][fine])
        bins.append((mix64(h[fine]) >> np.uint64(50)).astype(np.int64))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *own]), np.concatenate([none, *bins]), letter


@dataclass
class CodeModel:
    """Languages, their codewords, and for each bit a table of n-gram weights with its calibration."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    slope: np.ndarray
    shift: np.ndarray
    trust: np.ndarray

    def margins(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Mean n-gram weight of each text for each bit, and whether the text has a letter."""
        wo, code, words = split_words(texts)
        n = len(wo) - 1
        if not len(words):
            return np.zeros((n, self.weights.shape[1])), np.zeros(n, bool)
        own, bins, letter = word_grams(words)
        per = np.zeros((len(words), self.weights.shape[1] + 2))
        for k in range(self.weights.shape[1]):
            per[:, k] = np.bincount(own, self.weights[bins, k], len(words))
        per[:, -2] = np.bincount(own, minlength=len(words))
        per[:, -1] = letter
        total = sums_by_row(per[code], wo)
        return total[:, :-2] / np.maximum(total[:, -2:-1], 1), total[:, -1] > 0

    def decode(self, margin: np.ndarray) -> np.ndarray:
        """Each language's probability by loss-weighted decoding: a bit counts as far as it proved right in training."""
        m = margin * self.slope + self.shift
        loss = np.log1p(np.exp(-np.clip(m[:, None, :] * self.code[None, :, :], -40, 40))) * self.trust
        loss = loss.sum(2) / max(1e-9, self.trust.sum()) * np.log2(max(2, len(self.languages))) * 2
        e = np.exp(-(loss - loss.min(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)


def train_language(docs: DataFrame, cap: int = 1500, modulus: int = 4, remainder: int = 2, most: int = 500) -> CodeModel:
    """Fit on about ``cap`` documents of each of the ``most`` most frequent languages outside the held-out rows.

    For each bit of the codewords, the n-gram counts of the languages on its two sides give a smoothed log ratio by
    n-gram (languages count alike); a logistic fit of the mean ratios calibrates the bit and shows how far to trust it.
    """
    # counts need no texts, so the scan for them reads two narrow columns
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
    known = {(r["lang"],): r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()}
    languages = sorted(k[0] for k in known)
    if not languages:
        return CodeModel([], np.ones((0, 1)), np.zeros((BINS, 1)), np.ones(1), np.zeros(1), np.ones(1))
    texts, _ = materialise(bounded_sample(rows, "doc_id", cap, ["lang"], known).where("text is not null").repartition(16, "doc_id").sortWithinPartitions("doc_id", "text").select("lang", "text"), "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                at = np.array(batch.column("lang").to_pylist(), object)
                wo, code, words = split_words(batch.column("text"))
                own, bins, _ = word_grams(words)
                for lang in set(at.tolist()):
                    used = np.bincount(code[np.repeat(at == lang, np.diff(wo))], minlength=len(words)).astype(float)
                    c = np.bincount(bins, used[own], BINS)
                    k = np.flatnonzero(c)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k, pa.int32()), pa.array(c[k])], ["lang", "bin", "n"])

    counts = np.zeros((len(languages), BINS))
    for r in texts.mapInArrow(count, "lang string, bin int, n double").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect():
        counts[languages.index(r["lang"]), r["bin"]] = r["n"]
    code = codewords(len(languages))
    share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    weights = np.zeros((BINS, code.shape[1]))
    for k in range(code.shape[1]):
        a, b = share[code[:, k] > 0], share[code[:, k] < 0]
        p = a.mean(0) if len(a) else np.zeros(BINS)
        q = b.mean(0) if len(b) else np.zeros(BINS)
        weights[:, k] = np.log((p + 1e-6) / (q + 1e-6))
    bits = code.shape[1]
    model = CodeModel(languages, code, weights, np.ones(bits), np.zeros(bits), np.ones(bits))

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                m, letter = model.margins(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("lang").filter(pa.array(letter)), pa.array(list(m[letter]), pa.list_(pa.float64()))], ["lang", "m"])

    rows = texts.mapInArrow(margins, "lang string, m array<double>").collect()
    if rows and len(languages) > 1:
        m = np.array([r["m"] for r in rows])
        at = np.array([languages.index(r["lang"]) for r in rows])
        order = np.lexsort((*m.T, at))
        m, at = m[order], at[order]
        for k in range(bits):
            w = fit_logistic(m[:, k:k + 1], (code[at, k] > 0).astype(float), ridge=1e-3)
            model.slope[k], model.shift[k] = w
            right = ((m[:, k] * w[0] + w[1] > 0) == (code[at, k] > 0)).mean()
            model.trust[k] = max(0.05, 2 * right - 1)
    return model


def identify_language(docs: DataFrame, model: CodeModel, text_col: str = "text", ambiguous_below: float = 0.6) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ``ambiguous`` (the nearest codeword doesn't stand out) of every document.

    A null text, or one without a letter, is ``und`` with score 0, and ambiguous; so is every text when no language
    could be learned. Of equally near codewords the language that comes first by name is taken. Texts are read whole, however long.
    Repeated rows are answered each; an empty table gives no rows. Only doc_id and text are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                n = batch.num_rows
                names, score, vague = np.full(n, "und", object), np.zeros(n), np.ones(n, bool)
                if model.languages:
                    m, letter = model.margins(batch.column("text"))
                    p = model.decode(m)
                    best = p.argmax(1)
                    names = np.where(letter, np.array(model.languages, object)[best], "und")
                    score = np.where(letter, p.max(1), 0.0)
                    vague = score < ambiguous_below
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(vague)], ["id", "lang_pred", "score", "ambiguous"])

    wide_rows(docs)
    rows = docs.select(F.col("doc_id").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id"), 4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")
