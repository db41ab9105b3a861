"""Document quality by a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import held_out, labelled_sample, sigmoid, split_words, sums_by_row, text_slices, wide_rows

FEATURES = (
    "log_words", "mean_word_bytes", "distinct_words", "repeated_neighbours", "top_word", "repeated_trigrams", "upper", "digits", "punctuation",
    "symbols", "bars", "non_ascii", "marked_words", "short_words", "long_words", "capitalised", "words_per_line", "repeated_lines",
    "entropy", "full_stops",
)


def _classes() -> np.ndarray:
    """Byte classes as 0/1 columns: upper, lower, digit, punctuation, symbol, bar, newline, high, full stop, all."""
    m = np.zeros((256, 10))
    for b in range(256):
        c = chr(b)
        m[b, 0] = "A" <= c <= "Z"
        m[b, 1] = "a" <= c <= "z"
        m[b, 2] = "0" <= c <= "9"
        m[b, 3] = c in ".,;:!?'\"()-"
        m[b, 4] = c in "#$%&*@^~_=+<>/\\[]{}|`"
        m[b, 5] = c == "|"
        m[b, 6] = c == "\n"
        m[b, 7] = b >= 128
        m[b, 8] = c in ".!?"
        m[b, 9] = 1
    return m


def features(texts: pa.Array) -> np.ndarray:
    """The feature matrix of whole texts; an empty or null text has zeros."""
    n = len(texts)
    classes = _classes()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    hist = np.zeros((n, 256))
    for i in range(n):
        for a in range(int(offs[i]), int(offs[i + 1]), 1 << 20):
            hist[i] += np.bincount(data[a:min(a + (1 << 20), int(offs[i + 1]))], minlength=256)
    by = hist @ classes
    size = np.maximum(by[:, 9], 1)
    p = hist / size[:, None]
    entropy = -(p * np.log(np.where(p > 0, p, 1))).sum(1)

    wo, code, words = split_words(texts, lower_ascii=False)
    nw = np.diff(wo)
    some = np.maximum(nw, 1)
    length = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.float64) if len(words) else np.zeros(0)
    marked = pc.match_substring_regex(words, r"[^\p{L}\p{N}.,;:!?'\"()-]|[!?.,;:]{2}").to_numpy(zero_copy_only=False).astype(np.float64) if len(words) else np.zeros(0)
    capital = pc.match_substring_regex(words, r"^\p{Lu}").to_numpy(zero_copy_only=False).astype(np.float64) if len(words) else np.zeros(0)
    row = np.repeat(np.arange(n), nw)
    per_word = np.column_stack([length, marked, capital, length <= 2, length >= 15]).astype(np.float64)
    sums = sums_by_row(per_word[code], wo) if len(code) else np.zeros((n, 5))
    same = np.zeros(len(code))
    if len(code) > 1:
        same[1:] = (code[1:] == code[:-1]) & (row[1:] == row[:-1])
    repeated = sums_by_row(same, wo)
    distinct, top, tri = np.zeros(n), np.zeros(n), np.zeros(n)
    if len(code):
        pair, count = np.unique(row * (len(words) + 1) + code, return_counts=True)
        at = pair // (len(words) + 1)
        distinct = np.bincount(at, minlength=n).astype(float)
        np.maximum.at(top, at, count.astype(float))
        if len(code) > 2:
            whole = np.uint64(len(words) + 1)
            c = code.astype(np.uint64)
            key = (c[:-2] * whole + c[1:-1]) * whole + c[2:] + row[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            inside = row[2:] == row[:-2]
            _, first = np.unique(key[inside], return_index=True)
            tri = np.bincount(row[:-2][inside], minlength=n) - np.bincount(row[:-2][inside][first], minlength=n)
    lines = pc.split_pattern(texts, "\n")
    ln = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    lcode = lines.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lrow = np.repeat(np.arange(n), ln)
    key = np.unique(lrow * (len(lcode) + 1) + lcode)
    dup = ln - np.bincount(key // (len(lcode) + 1), minlength=n)
    letters = np.maximum(by[:, 0] + by[:, 1], 1)
    out = np.column_stack([
        np.log1p(nw), sums[:, 0] / some, distinct / np.sqrt(some), repeated / some, top / some, tri / some, by[:, 0] / letters, by[:, 2] / size,
        by[:, 3] / size, by[:, 4] / size, by[:, 5] / size, by[:, 7] / size, sums[:, 1] / some, sums[:, 3] / some, sums[:, 4] / some,
        sums[:, 2] / some, nw / np.maximum(ln, 1), dup / np.maximum(ln, 1), entropy, by[:, 8] / some,
    ])
    out[by[:, 9] == 0] = 0
    return out


@dataclass
class AdditiveModel:
    """Bin edges and a lookup table for each feature, and for each chosen pair on coarser bins."""

    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    intercept: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities: one table lookup and addition for each feature and pair."""
        total = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            total += t[np.searchsorted(e, x[:, j], side="right")]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            total += t[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return sigmoid(total)


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """The Newton step of each bin from a tree of at most ``leaves`` intervals of bins, grown best split first."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    cuts = [0, len(g)]
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    while len(cuts) - 1 < leaves:
        best = (1e-9, None)
        for a, b in zip(cuts[:-1], cuts[1:]):
            m = np.arange(a + 1, b)
            if len(m):
                gain = worth(a, m) + worth(m, b) - worth(a, b)
                k = int(np.argmax(gain))
                best = max(best, (float(gain[k]), int(m[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def fit_additive(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, bins: int = 48, rounds: int = 150, rate: float = 0.1, leaves: int = 4,
    n_pairs: int = 8, pair_bins: int = 8, ridge: float = 2.0,
) -> AdditiveModel:
    """Cyclic boosting: in every round each feature in turn gets a shallow tree on the current residuals, added to its table.

    Then the pairs whose coarse two-way table explains most of what is left are boosted in the same way. With no
    rows, or one class only, the model is a constant.
    """
    model = AdditiveModel()
    if not len(y):
        return model
    weight = weight / weight.mean()
    rate_of_one = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    model.intercept = float(np.log(rate_of_one / (1 - rate_of_one)))
    if len(np.unique(y)) < 2:
        return model
    d = x.shape[1]
    grid = lambda k, q: np.unique(np.quantile(x[:, k], np.linspace(0, 1, q + 1)[1:-1]))
    model.edges = [grid(j, bins) for j in range(d)]
    model.coarse = [grid(j, pair_bins) for j in range(d)]
    code = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    rough = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    f = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for j in range(d):
            p = sigmoid(f)
            g, h = weight * (y - p), weight * p * (1 - p)
            m = len(model.tables[j])
            step = rate * _shallow_tree(np.bincount(code[j], g, m), np.bincount(code[j], h, m), leaves, ridge)
            model.tables[j] += step
            f += step[code[j]]
    p = sigmoid(f)
    g, h = weight * (y - p), weight * p * (1 - p)
    gains = []
    for i in range(d):
        for j in range(i + 1, d):
            cell = rough[i] * (len(model.coarse[j]) + 1) + rough[j]
            cg, ch = np.bincount(cell, g), np.bincount(cell, h)
            gains.append((float((cg**2 / (ch + ridge)).sum()), i, j))
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:n_pairs]]
    model.pair_tables = [np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for i, j in model.pairs]
    for _ in range(rounds // 5):
        for k, (i, j) in enumerate(model.pairs):
            p = sigmoid(f)
            g, h = weight * (y - p), weight * p * (1 - p)
            shape = model.pair_tables[k].shape
            cell = rough[i] * shape[1] + rough[j]
            cg, ch = np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)
            rows = _shallow_tree(cg.sum(1), ch.sum(1), 2, ridge)
            step = np.zeros(shape)
            for part in np.unique(rows):  # a split on one feature, then one on the other in each half
                own = rows == part
                step[own] = _shallow_tree(cg[own].sum(0), ch[own].sum(0), 2, ridge)
            model.pair_tables[k] += rate * step
            f += rate * step[rough[i], rough[j]]
    return model


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", cap: int = 8000) -> AdditiveModel:
    """Fit on at most about ``cap`` labelled documents of each class outside the held-out rows."""
    texts, weight = labelled_sample(docs, labels, label, cap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                x = features(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    rows = texts.select("y", "text").mapInArrow(run, "y int, x array<double>").collect()
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES))
    y = np.array([r["y"] for r in rows], float)
    order = np.lexsort((*x.T, y))  # the rows' order of arrival has no say
    return fit_additive(x[order], y[order], np.array([weight[int(v)] for v in y[order]]))


def score_quality(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``score`` and ``predicted``.

    Null and empty texts get the score of all-zero features; repeated rows are scored each; an empty table gives no
    rows. Columns of these names in the input are replaced. Texts are read whole, however long; equal texts get equal scores, and a
    score of just ``threshold`` counts as 1. Nothing is shuffled.
    """
    wide_rows(docs)
    docs = docs.drop("score", "predicted")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = whole.schema.get_field_index(text_col)
            for batch in text_slices(whole, text_col):
                s = model.score(features(batch.column(at)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train_quality(docs, labels)
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
