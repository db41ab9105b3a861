"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.session import materialise

MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (splitmix): every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def text_slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a record batch into runs of rows of about ``max_bytes`` of text (a longer text stands alone).

    The runs are copies: some Arrow kernels (``ascii_lower`` on large strings) misread arrays that start at an offset.
    """
    if batch.num_rows == 0:
        return
    cut = lambda a, n: batch.slice(a, n).take(pa.array(np.arange(n)))
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > max_bytes:
            yield cut(start, i - start)
            start, total = i, 0
        total += n
    yield cut(start, batch.num_rows - start)
    pa.default_memory_pool().release_unused()


def wide_rows(df: DataFrame, rows: int = 2000) -> None:
    """Hold the session's Arrow batches to ``rows`` rows: texts are wide, and a batch stays in memory whole.

    A smaller setting of the user's stays. The setting holds for the session, so every operator that calls this changes it.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))


def split_words(texts: pa.Array, lower_ascii: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: (offsets by text, word index, distinct words)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower_ascii:
        texts = pc.ascii_lower(texts if not texts.offset else texts.take(pa.array(np.arange(len(texts)))))
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    keep = full.to_numpy(zero_copy_only=False)
    if len(keep) and not keep.all():
        flat = flat.filter(full)
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
    coded = flat.dictionary_encode()
    return offsets.astype(np.int64), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def sums_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between successive offsets; empty rows give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[offsets[1:]] - total[offsets[:-1]]


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def bounded_sample(df: DataFrame, key: str, cap: int, by: list[str], known: dict | None = None) -> DataFrame:
    """About ``cap`` rows of each class of ``by``, chosen by a hash of ``key``: the same rows on every run.

    A class of up to ``cap`` rows is taken whole. Only the classes' counts reach the driver.
    """
    known = known if known is not None else {tuple(r[c] for c in by): r["count"] for r in df.groupBy(*by).count().collect()}
    keep = F.lit(False)
    for values, n in known.items():
        share = min(1.0, cap / n)
        same = F.lit(True)
        for c, v in zip(by, values):
            same = same & F.col(c).eqNullSafe(F.lit(v))
        draw = (F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else F.lit(True)
        keep = keep | (same & draw)
    return df.where(keep)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, cap: int, modulus: int = 5, remainder: int = 0) -> tuple[DataFrame, dict[int, float]]:
    """About ``cap`` labelled documents of each class outside the held-out rows, and the weight of one row of each class.

    Ids are drawn from the labels alone; they have that bound, so the documents meet them in a broadcast join and
    aren't shuffled: as many tasks as the table has splits read them, and only the drawn rows meet in 16 parts. An id that has several labels counts once, with the largest. The texts (id, text, y) are
    written to the shared scratch folder for the passes of the training.
    """
    wide_rows(docs)
    rows = (
        labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    full = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    drawn = bounded_sample(rows, "doc_id", cap, ["y"], {(k,): n for k, n in full.items()})
    texts, _ = materialise(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id").repartition(16, "doc_id").sortWithinPartitions("doc_id", "text"), "sample")
    got = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    return texts, {y: full.get(y, 0) / n for y, n in got.items()}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50, weight: np.ndarray | None = None) -> np.ndarray:
    """Newton's method for a ridge-penalised logistic regression; the last coefficient is the intercept."""
    a = np.column_stack([x, np.ones(len(x))])
    each = np.ones(len(x)) if weight is None else weight
    w = np.zeros(a.shape[1])
    pen = np.full(a.shape[1], ridge)
    pen[-1] = 1e-9
    for _ in range(steps):
        p = sigmoid(a @ w)
        g = a.T @ (each * (p - y)) + pen * w
        h = (a * (each * p * (1 - p))[:, None]).T @ a + np.diag(pen + 1e-9)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
