"""Toxic passages as maximum-scoring segments of token log-odds."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import fit_logistic, held_out, labelled_sample, sigmoid, split_words, text_slices, wide_rows

PASSAGES = "array<struct<start:int,end:int,score:double,p:double>>"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring subsequences in linear time: disjoint (start, end, score), every one above 0.

    Each candidate keeps the running total before and after it; a new one is merged backwards with the nearest
    candidate that starts lower, as long as that one also ends lower.
    """
    total = 0.0
    found: list[list] = []  # start, end, total before, total after, index of the nearest earlier one that starts lower
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total, None]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4] if found[j][4] is not None else -1
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j if j >= 0 else None
                found.append(new)
                break
            new = [found[j][0], i + 1, found[j][2], total, None]
            del found[j:]
    return [(a, b, after - before) for a, b, before, after, _ in found]


@dataclass
class ToxicModel:
    """Token scores, the drift of all other tokens, the extreme-value law of clean texts and the calibration."""

    score_of: dict[str, tuple[float, float]] = field(default_factory=dict)
    drift: float = -0.5
    scale: float = 1.0
    log_k: float = 0.0
    calibration: tuple[float, ...] = ()
    prior: float = 0.5
    significant: float = 0.01

    def token_score(self, word: str) -> float:
        """The score of the word's best supported key, else the drift."""
        keys = word_keys(plain_word(word))
        best = max((self.score_of[k] for k in [*keys[:1], *keys[:0:-1]] if k in self.score_of), key=lambda x: x[1], default=(self.drift, 0.0))
        return best[0]

    def p_value(self, score: float, tokens: int) -> float:
        """Chance that a clean text of so many tokens has a segment of this score: 1 - exp(-K n exp(-lambda s))."""
        return float(-np.expm1(-np.exp(min(50.0, self.log_k + np.log(max(tokens, 1)) - self.scale * score))))

    def segments(self, texts: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Token counts, and the maximal segments of each text in token positions."""
        offsets, code, words = split_words(texts)
        table = np.array([self.token_score(w) for w in words.to_pylist()]) if len(words) else np.zeros(0)
        out: list[list[tuple[int, int, float]]] = [[] for _ in range(len(offsets) - 1)]
        each = table[code]
        if len(code) > 1:  # a word said again at once adds nothing
            again = np.flatnonzero(code[1:] == code[:-1]) + 1
            again = again[~np.isin(again, offsets[:-1])]
            each[again] = np.minimum(each[again], self.drift)
        hits = np.flatnonzero(each > 0)
        total = np.concatenate([[0.0], np.cumsum(each)])
        row = np.searchsorted(offsets, hits, side="right") - 1
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1, [len(row)]]) if len(row) else np.zeros(1, int)
        for a, b in zip(cuts[:-1], cuts[1:]):
            at, first = hits[a:b], int(offsets[row[a]])
            # every run of tokens without a positive score counts as one token of its total
            gaps = total[at[1:]] - total[at[:-1] + 1]
            seq = np.zeros(2 * len(at) - 1)
            seq[::2], seq[1::2] = each[at], gaps
            out[int(row[a])] = [(int(at[s // 2]) - first, int(at[(e - 1) // 2]) + 1 - first, v) for s, e, v in maximal_segments(seq.tolist())]
        return np.diff(offsets), out

    def statistics(self, tokens: np.ndarray, segments: list[list[tuple[int, int, float]]]) -> np.ndarray:
        """By text: the best segment's normalised score, and the least p-value (as -log) of the sums of the r best ones.

        The r largest normalised scores of a clean text add up to x or more with probability about
        exp(-x) x^(r-1) / (r! (r-1)!), which lets several weak passages count together.
        """
        out = np.zeros((len(tokens), 2))
        out[:, 0] = -5
        for i, (n, found) in enumerate(zip(tokens.tolist(), segments)):
            if found:
                norm = np.sort([self.scale * v for *_, v in found])[::-1] - self.log_k - np.log(max(n, 1))
                r = np.arange(1, len(norm) + 1)
                x = np.maximum(np.cumsum(norm), 1e-6)
                log_fact = np.concatenate([[0.0], np.cumsum(np.log(r))])
                p = x - (r - 1) * np.log(x) + log_fact[r] + log_fact[r - 1]
                p = p[x >= r]  # the law holds in the tail only
                out[i] = np.clip(norm[0], -5, 20), min(50.0, p.max()) if len(p) else 0.0
        return out

    def probability(self, stats: np.ndarray) -> np.ndarray:
        if not self.calibration:
            return np.full(len(stats), self.prior)
        w = np.array(self.calibration)
        return sigmoid(stats @ w[:-1] + w[-1])


def plain_word(word: str) -> str:
    """Lower case, without what isn't a letter at either end; a word without letters is empty."""
    word = word.lower()
    a, b = 0, len(word)
    while a < b and not word[a].isalpha():
        a += 1
    while b > a and not word[b - 1].isalpha():
        b -= 1
    return word[a:b]


def word_keys(word: str, shortest: int = 3, longest: int = 8) -> list[str]:
    """The word and its stems: prefixes of 3 to 8 letters (``stem*``) that are shorter than it, so that inflected forms of a slur count together."""
    return [word, *(word[:k] + "*" for k in range(shortest, min(longest, len(word) - 1) + 1))] if word else []


def train_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", cap: int = 6000, prior_strength: float = 500.0, z: float = 3.5, least_ratio: float = 1.5,
) -> ToxicModel:
    """Fit on at most about ``cap`` labelled documents of each class outside the held-out rows.

    One half of them (by a hash of the text, so equal texts stay together) gives, for the fit of the calibration, the log-odds ratio of each word and
    of each stem, with an informative Dirichlet prior (half a document, plus a share by the key's frequency over both
    classes). Keys keep a score that lie ``z`` standard deviations or more from zero and whose ratio
    is below 0 or at least ``least_ratio``; the sample's bound is theirs too. A token takes its best supported key's score; without one, the drift. The
    other half gives the extreme-value law (from its clean texts) and the calibration of the score. The final scores
    come from both halves.
    """
    texts, weight = labelled_sample(docs, labels, label, cap)
    half = F.pmod(F.xxhash64("text"), F.lit(2))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                group = batch.column("y").to_numpy(zero_copy_only=False) * 2 + batch.column("half").to_numpy(zero_copy_only=False)
                for g in np.unique(group).tolist():
                    own = batch.column("text").take(pa.array(np.flatnonzero(group == g)))
                    offsets, code, words = split_words(own)
                    row = np.repeat(np.arange(len(own)), np.diff(offsets))
                    keys = [word_keys(plain_word(w)) for w in words.to_pylist()]
                    plain = pa.array([k for ks in keys for k in ks], pa.string()).dictionary_encode()
                    ids = plain.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                    starts = np.concatenate([[0], np.cumsum([len(ks) for ks in keys])]).astype(np.int64)
                    # a key counts once for each document, so one long rant doesn't decide
                    pair = np.unique(row * (len(words) + 1) + code)
                    doc, word = pair // (len(words) + 1), pair % (len(words) + 1)
                    many = starts[word + 1] - starts[word]
                    flat = np.repeat(starts[word] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                    seen = np.unique(np.repeat(doc, many) * (len(plain.dictionary) + 1) + ids[flat]) % (len(plain.dictionary) + 1)
                    n = np.bincount(seen, minlength=len(plain.dictionary))
                    yield pa.RecordBatch.from_arrays([plain.dictionary, pa.array([g % 2] * len(n), pa.int32()), pa.array([g // 2] * len(n), pa.int32()), pa.array(n, pa.int64())], ["word", "half", "y", "n"])

    by_word = (
        texts.select("text", "y", half.alias("half")).dropDuplicates(["text", "y"]).mapInArrow(count, "word string, half int, y int, n long").where("word <> ''")
        .groupBy("word").agg(*[F.sum(F.when((F.col("y") == y) & (F.col("half") <= h), F.col("n")).otherwise(0)).alias(f"{c}{h}") for y, c in ((1, "a"), (0, "b")) for h in (0, 1)])
    ).persist()

    def table(h: int) -> dict[str, tuple[float, float]]:
        """Scores from the first half (0) or from both (1)."""
        a, b = F.col(f"a{h}"), F.col(f"b{h}")
        sums = by_word.agg(F.sum(a), F.sum(b)).first()
        n1, n0 = float(sums[0] or 0), float(sums[1] or 0)
        if not n1 or not n0:
            return {}
        alpha = F.lit(0.5) + (a + b) * (prior_strength / (n1 + n0))
        ratio = F.log((a + alpha) / (n1 + prior_strength - a - alpha)) - F.log((b + alpha) / (n0 + prior_strength - b - alpha))
        top = (
            by_word.select("word", ratio.alias("d"), (ratio / F.sqrt(1 / (a + alpha) + 1 / (b + alpha))).alias("z"))
            .where((F.abs("z") >= z) & ((F.col("d") >= least_ratio) | (F.col("d") < 0))).collect()
        )
        return {r["word"]: (float(np.clip(r["d"], -1.0, 4.0)), abs(r["z"])) for r in top}

    model = ToxicModel()
    counts = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    scaled = {y: counts.get(y, 0) * weight.get(y, 0) for y in (0, 1)}
    model.prior = (scaled[1] + 0.5) / (sum(scaled.values()) + 1)
    model.score_of, final = table(0), table(1)
    by_word.unpersist()
    if len(counts) < 2 or not model.score_of:
        return model

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                tokens, found = model.segments(batch.column("text"))
                flat = [[v for *_, v in f] for f in found]
                width = [[e - s for s, e, _ in f] for f in found]
                yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(tokens), pa.array(flat, pa.list_(pa.float64())), pa.array(width, pa.list_(pa.int64()))], ["y", "tokens", "v", "w"])

    rows = texts.where(half == 1).select("y", "text").mapInArrow(measure, "y int, tokens long, v array<double>, w array<long>").collect()
    rows.sort(key=lambda r: (r["y"], r["tokens"], r["v"]))
    if len({r["y"] for r in rows}) < 2:
        return model
    tokens = np.array([r["tokens"] for r in rows])
    y = np.array([r["y"] for r in rows], float)
    # Extreme-value law of clean texts: segments above x come K exp(-lambda x) to a token. Lambda is the rate of the
    # excesses over the median segment score, K their frequency; one segment more than seen keeps K above zero.
    clean = (y == 0) & (tokens > 0)
    every = np.array([v for r in rows if r["y"] == 0 for v in r["v"]])
    floor = float(np.median(every)) if len(every) >= 20 else 0.0
    over = every[every > floor] - floor
    model.scale = float(np.clip((len(over) + 1) / (over.sum() + 1.0), 0.3, 5.0))
    model.log_k = float(np.log(len(over) + 1) - np.log(max(1, tokens[clean].sum())) + model.scale * floor)
    segs = [[(0, int(w), float(v)) for v, w in zip(r["v"], r["w"])] for r in rows]
    stats = model.statistics(tokens, segs)
    w = np.array([weight[int(v)] for v in y])
    model.calibration = tuple(fit_logistic(stats, y, ridge=0.1, weight=w / w.min()))
    model.score_of = final
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel, text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (score of 0.5 or more) and the significant toxic passages of every document.

    Passages are spans of code points with their segment score and p-value, in text order. Null and empty texts get
    the score of a text without any segment; repeated rows are scored each, alike; an empty table gives no rows; other
    columns are ignored, also those of the result's names. A word that several keys fit takes the best supported one's
    score, of equally supported ones the longest. A token's log-odds are held between -1 and 4, the normalised sum of the
    best segment between -5 and 20, and that of all segments together at 50, so that no single word decides alone. The scan is linear in a
    text's length, however long, and nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passage = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("p", pa.float64())])
        for whole in batches:
            for batch in text_slices(whole):
                texts = pc.fill_null(batch.column("text"), "")
                tokens, found = model.segments(texts)
                score = model.probability(model.statistics(tokens, found))
                spans: list[list[dict]] = [[]] * batch.num_rows
                for i, segs in enumerate(found):
                    kept = [(s, e, v, p) for s, e, v in segs if (p := model.p_value(v, int(tokens[i]))) <= model.significant]
                    if kept:
                        at = [m.span() for m in _WORD.finditer(texts[i].as_py())]
                        spans[i] = [{"start": at[s][0], "end": at[e - 1][1], "score": v, "p": p} for s, e, v, p in kept]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score), pa.array(spans, pa.list_(passage))], ["id", "score", "passages"])

    wide_rows(docs)
    rows = docs.select(F.col("doc_id").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double, passages {PASSAGES}")
    return found.select(F.col("id").alias("doc_id"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the passages of every document."""
    scored = score_toxicity(docs, train_toxicity(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted", "passages")
