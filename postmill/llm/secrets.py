"""Secrets in texts: fixed patterns, and character Markov models for strings that no pattern names."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import labelled_sample, text_slices, wide_rows

KINDS = ("assign", "access", "hex")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
LEAST = 16
BUILT_IN = "item value index name count page file user order total first last next start end table row column text word line list map key node path url link image label title date time size width height color state error result".split()

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_ANY = r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


@dataclass
class MarkovModel:
    """First-order chains over the alphabet: one for identifiers, one for each family of random strings.

    Precision and recall are those of the held-out half of the labelled samples, random strings against as many identifiers.
    """

    identifier: np.ndarray
    families: list[np.ndarray]
    threshold: float
    precision: float = float("nan")
    recall: float = float("nan")

    def ratio(self, token: str) -> float:
        """Log-likelihood ratio of the best random family against the identifiers' chain."""
        code = encode(token)
        a, b = code[:-1], code[1:]
        own = self.identifier[a, b].sum()
        return float(max(f[a, b].sum() for f in self.families) - own - np.log(len(self.families)))


_CODE = np.full(256, len(ALPHABET), np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))


def encode(token: str) -> np.ndarray:
    """Codes of the characters, with a boundary code in front."""
    return np.concatenate([[len(ALPHABET)], _CODE[np.frombuffer(token.encode("latin-1", "replace"), np.uint8)]])


def chain(samples: list[str], smoothing: float = 0.5) -> np.ndarray:
    """Log transition probabilities, smoothed towards the samples' own character frequencies."""
    n = len(ALPHABET) + 1
    counts = np.zeros((n, n))
    for s in samples:
        c = encode(s)
        np.add.at(counts, (c[:-1], c[1:]), 1)
    unigram = counts.sum(0) + 0.5
    unigram /= unigram.sum()
    counts += smoothing * n * unigram
    return np.log(counts / counts.sum(1, keepdims=True))


def random_strings(n: int = 4000, seed: int = 7) -> list[list[str]]:
    """Labelled samples of random strings by family: hex, upper-case base 36, base 62 and base 64."""
    rng = np.random.default_rng(seed)
    families = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", ALPHABET[:62], ALPHABET[:62] + "+/")
    return [["".join(np.array(list(f))[rng.integers(0, len(f), rng.integers(16, 65))]) for _ in range(n)] for f in families]


def identifiers(words: list[str], n: int = 20000, seed: int = 11) -> list[str]:
    """Labelled samples of ordinary identifiers: words as they are, and joined the way names, paths and keys are."""
    rng = np.random.default_rng(seed)
    words = [w for w in words if w.isascii() and w.isalpha()] or BUILT_IN
    out = [w for w in words if len(w) >= 4][: n // 2]
    for _ in range(n):
        k = int(rng.integers(2, 5))
        pick = [words[i] for i in rng.integers(0, len(words), k)]
        style = int(rng.integers(0, 6))
        tail = str(rng.integers(0, 3000)) if rng.random() < 0.3 else ""
        if style == 0:
            out.append("_".join(pick).lower() + tail)
        elif style == 1:
            out.append("-".join(pick).lower() + tail)
        elif style == 2:
            out.append(pick[0].lower() + "".join(w.capitalize() for w in pick[1:]) + tail)
        elif style == 3:
            out.append("/".join(pick).lower() + tail)
        elif style == 4:
            out.append("_".join(pick).upper() + tail)
        else:
            out.append("".join(w.capitalize() for w in pick) + tail)
    return out


def train_markov(docs: DataFrame, labels: DataFrame | None = None, cap: int = 2000, sample_words: int = 20_000) -> MarkovModel:
    """Fit the chains on labelled samples: random strings by family, and identifiers.

    Random strings are labelled by the generator that makes them. Identifiers are made of words that at least two of
    about ``cap`` documents of label ``quality`` 1 hold, ``sample_words`` of them at most (both bound the labelled
    sample; held-out documents stay out); so a secret that stands in one document is no word. Without labels, or if
    they give no words, a few built-in words serve.

    Every second sample of each kind fits the chains; the others give the threshold (the ratio that one in two thousand
    held-out identifiers exceeds, and 12 nats at least), precision and recall.
    """
    words: list[str] = []
    if labels is not None:
        texts, _ = labelled_sample(docs, labels, "quality", cap)
        held = (
            texts.where("y = 1").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0)))).alias("w"))
            .groupBy("w").agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.xxhash64("w"), "w").limit(sample_words)
        )
        words = [r["w"] for r in held.collect()]
    return fit_markov(identifiers(words), random_strings())


def fit_markov(names: list[str], families: list[list[str]]) -> MarkovModel:
    """Chains from the even samples, threshold and quality from the odd ones."""
    model = MarkovModel(chain(names[::2]), [chain(f[::2]) for f in families], 12.0)
    own = np.array([model.ratio(x) for x in names[1::2] if len(x) >= LEAST])
    other = np.array([model.ratio(x) for f in families for x in f[1::2] if len(x) >= LEAST])
    if len(own):
        model.threshold = max(12.0, float(np.quantile(own, 0.9995, method="higher")))
        wrong = float((own > model.threshold).mean())
        model.recall = float((other > model.threshold).mean()) if len(other) else float("nan")
        model.precision = model.recall / max(1e-12, model.recall + wrong)
    return model


def scanner(model: MarkovModel):
    """A function from a text and its flags to all spans, by start, then kind."""
    rank = {k: i for i, k in enumerate((*KINDS, "markov"))}
    known: dict[str, bool] = {}

    def secret(token: str) -> bool:
        if token not in known:
            if len(known) > 200_000:
                known.clear()
            body = token.strip("=-_/+")
            known[token] = len(body) >= LEAST and not body.isdigit() and model.ratio(body) > model.threshold
        return known[token]

    def scan(text: str, plain: bool, run: bool) -> list[dict]:
        base = pattern_spans(text) if plain else []
        every = [(s, rank[k], e, True) for k, s, e in base]
        if run:
            taken = sorted((s, e) for _, s, e in base)
            i = 0
            for m in _RUN.finditer(text):
                if secret(m[0]):
                    a, b = m.span()
                    while i < len(taken) and taken[i][1] <= a:
                        i += 1
                    if not any(s < b and a < e for s, e in taken[max(0, i - 2):i + 3]):
                        every.append((a, 3, b, False))
        return [{"kind": (*KINDS, "markov")[k], "start": s, "end": e, "base": b} for s, k, e, b in sorted(every)]

    return scan


def find_secrets(docs: DataFrame, model: MarkovModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every document; spans are in code points, end exclusive, by start, then kind as listed.

    ``base`` marks what the patterns find. Every other run of 16 or more characters of the alphabet that overlaps
    none of them is judged by the Markov models (kind ``markov``). A null text counts as empty; repeated rows are
    answered each; an empty table gives no rows; other columns are ignored. Texts of any length are read whole, and
    nothing is shuffled. Of spans that start together the kind listed first comes first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(model)
        kind_type = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
        for whole in batches:
            for batch in text_slices(whole):
                spans = spans_of(batch, scan)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, pa.list_(kind_type))], ["id", "spans"])

    wide_rows(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, spans {SPANS}").withColumnRenamed("id", id_col)


def spans_of(batch: pa.RecordBatch, scan) -> list[list[dict]]:
    texts = pc.fill_null(batch.column("text"), "")
    plain = pc.match_substring_regex(texts, _ANY).to_numpy(zero_copy_only=False)
    runs = pc.match_substring_regex(texts, r"[A-Za-z0-9+/_=-]{16}").to_numpy(zero_copy_only=False)
    spans: list[list[dict]] = [[]] * batch.num_rows
    for i in np.flatnonzero(plain | runs).tolist():
        spans[i] = scan(texts[i].as_py(), bool(plain[i]), bool(runs[i]))
    return spans


def redact_secrets(docs: DataFrame, model: MarkovModel, mask: str = "<secret>", text_col: str = "text") -> DataFrame:
    """The same rows and columns with every secret in the text replaced by ``mask``; null texts stay null."""
    wide_rows(docs)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(model)
        for whole in batches:
            at = whole.schema.get_field_index(text_col)
            for batch in text_slices(whole, text_col):
                view = pa.RecordBatch.from_arrays([batch.column(at)], ["text"])
                spans = spans_of(view, scan)
                if any(spans):
                    texts = batch.column(at).to_pylist()
                    for i, found in enumerate(spans):
                        if found:
                            t, out, pos = texts[i], [], 0
                            for s in found:
                                if s["start"] >= pos:
                                    out += [t[pos:s["start"]], mask]
                                pos = max(pos, s["end"])
                            texts[i] = "".join([*out, t[pos:]])
                    columns = [pa.array(texts, batch.schema.field(k).type) if k == at else c for k, c in enumerate(batch.columns)]
                    batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
                yield batch

    return docs.select(*names).mapInArrow(run, docs.schema)
