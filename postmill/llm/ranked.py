"""Ranked lexical search by sort-based accumulation of integer impacts."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import split_words, text_slices, wide_rows
from postmill.session import drop_scratch, materialise

#: Bytes 0-9, a-z and those beyond ASCII stay, A-Z become lower case, all others part terms.
_FOLD = np.array([b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)], np.uint8)
_FOLD[0x41:0x5B] += 0x20


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Terms of each text: (offsets by text, index of each occurrence, distinct terms). ``texts`` starts at offset 0."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, ends, data = texts.buffers()
    folded = _FOLD[np.frombuffer(data, np.uint8)] if data is not None and data.size else np.zeros(0, np.uint8)
    return split_words(pa.Array.from_buffers(pa.large_string(), len(texts), [None, ends, pa.py_buffer(folded.tobytes())]), lower_ascii=False)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of non-negative keys, 16 bits a pass from the lowest; numpy sorts 16-bit numbers by counting."""
    order = np.arange(len(keys))
    top = int(keys.max(initial=0))
    for shift in range(0, max(1, top.bit_length()), 16):
        digit = ((keys[order] >> shift) & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]
    return order


class ItemIndex:
    """Terms of a block of items: which items hold each term, and how often."""

    def __init__(self, rows: list[tuple[int, str | None]]) -> None:
        rows = sorted((i, t) for i, t in set(rows) if i is not None and t is not None)
        self.items = np.array([i for i, _ in rows], np.int64)
        offsets, code, words = terms_of(pa.array([t for _, t in rows], pa.string()))
        item = np.repeat(np.arange(len(rows)), np.diff(offsets))
        key, times = np.unique(code * max(1, len(rows)) + item, return_counts=True)
        self.words = words
        self.holder, self.times = key % max(1, len(rows)), times.astype(np.int64)
        self.start = np.searchsorted(key // max(1, len(rows)), np.arange(len(words) + 1))


def _postings(index: ItemIndex):
    """Each document's id, number of terms, and its terms of the index with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                offsets, code, words = terms_of(batch.column("text"))
                found = pc.fill_null(pc.index_in(words, index.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                term = found[code] if len(code) else np.zeros(0, np.int64)
                doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
                hit = term >= 0
                many = max(1, len(index.words))
                key, tf = np.unique(doc[hit] * many + term[hit], return_counts=True)
                at = pa.array(np.searchsorted(key // many, np.arange(batch.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(at, pa.array((key % many).astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(tf.astype(np.int32))),
                ], ["doc_id", "n", "terms", "tf"])

    return run


def accumulate(doc: np.ndarray, term: np.ndarray, impact: np.ndarray, index: ItemIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Summed impacts as (item, doc, score): every posting meets the items of its term, packed keys are sorted, runs are added up."""
    many = index.start[term + 1] - index.start[term]
    total = int(many.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 3
    at = np.repeat(index.start[term] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(total)
    key = (index.holder[at] << 32) | np.repeat(doc, many)
    score = np.repeat(impact, many) * index.times[at]
    order = radix_order(key)
    key, score = key[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first] >> 32, key[first] & 0xFFFFFFFF, np.add.reduceat(score, first)


class Best:
    """The best documents of each item so far, a heap each: (score, -doc_id), an id once with its best score."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.heaps = k, [[] for _ in range(items)]
        self.held: list[dict[int, int]] = [{} for _ in range(items)]
        self.floor = np.zeros(items, np.int64)

    def offer(self, item: np.ndarray, doc_id: np.ndarray, score: np.ndarray) -> None:
        able = np.flatnonzero(score > np.maximum(self.floor[item] - 1, 0))  # equal scores may win by their id
        for i, d, s in zip(item[able].tolist(), doc_id[able].tolist(), score[able].tolist()):
            heap, held, entry = self.heaps[i], self.held[i], (s, -d)
            if d in held:
                if s <= held[d]:
                    continue
                heap[heap.index((held[d], -d))] = entry
                heapq.heapify(heap)
            elif len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                del held[-heapq.heapreplace(heap, entry)[1]]
            else:
                continue
            held[d] = s
            if len(heap) == self.k:
                self.floor[i] = heap[0][0]


def _search(index: ItemIndex, weight: np.ndarray, docs: int, length: int, k: int, run_of: int = 1 << 21):
    """The best ``k`` documents of each item among a task's, from postings in runs of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(index.items), k)
        spread = np.diff(index.start)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "n"))
            per = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(batch.num_rows), per)
            term = batch.column("terms").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            tf = batch.column("tf").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            live = weight[term] > 0
            doc, term, tf = doc[live], term[live], tf[live]
            m = 75 + 25 * n * docs // max(1, length)
            impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
            # whole documents in each run, so that a run's sums are final
            done = np.cumsum(spread[term])
            a = 0
            while a < len(doc):
                b = int(np.searchsorted(done, (done[a - 1] if a else 0) + run_of))
                b = len(doc) if b >= len(doc) else int(np.searchsorted(doc, doc[max(a, b)], "left"))
                if b <= a:
                    b = int(np.searchsorted(doc, doc[a], "right"))
                i, d, s = accumulate(doc[a:b], term[a:b], impact[a:b], index)
                best.offer(i, ids[d], s)
                a = b
        rows = [(i, -d, s) for i, heap in enumerate(best.heaps) for s, d in heap]
        if rows:
            i, d, s = map(np.array, zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(index.items[i]), pa.array(d, pa.int64()), pa.array(s, pa.int64())], ["item_id", "doc_id", "score"])

    return run


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[ItemIndex]:
    """Items in blocks of about ``block_bytes`` of text; one block at a time reaches the driver."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        if rows:
            yield ItemIndex([(r["item_id"], r["text"]) for r in rows])


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """Each item's ``k`` best documents by summed integer impacts: (item_id, rank, doc_id, score), scores above 0, ties to the smaller id.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. With N documents of at
    least one term, L terms in all, df documents that hold a term: weight w = floor(1000 ln((2 N + 2) / (2 df + 1))), and a
    document of n terms has m = 75 + 25 n N div L. Its score adds w ((10^9 tf) div (1000 tf + 12 m)) over the item's terms,
    repeats included.

    The first pass reads the texts once and writes each document's length and its terms of the items to the shared scratch
    folder; N, L and df come from there. The second turns postings into (item, document, impact) entries, sorts their packed keys by
    radix, adds up runs and keeps a heap of k for each item; what tasks found meets in a window by item,
    k rows a task and item. Items travel in blocks of about ``block_bytes`` of text (one block: a single pass over the
    texts; a single longer item is a block of its own), so what is broadcast is bounded.

    Null and empty texts have no terms: such documents are never found, such items find nothing. Rows without an id take
    no part. Repeated rows of one id and text count as one document in a result but each in the statistics; an id that
    has different texts is ranked by its best. Repeated items find what one finds, and an item id with two texts what both find,
    each document by its better score. Empty tables give no rows.
    """
    spark = docs.sparkSession
    wide_rows(docs)
    texts = docs.where(F.col(doc_col).isNotNull()).select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = items.where(F.col(item_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).distinct()
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for index in _blocks(asked, block_bytes):
        postings, path = materialise(texts.mapInArrow(_postings(index), "doc_id long, n long, terms array<int>, tf array<int>"), "postings")
        count, length = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(index.words), np.int64)
        for r in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[r["t"]] = r["count"]
        weight = np.floor(1000 * np.log((2 * count + 2) / (2 * df + 1))).astype(np.int64)
        hits, _ = materialise(postings.where(F.size("terms") > 0).mapInArrow(_search(index, weight, count, length, k), "item_id long, doc_id long, score long"), "hits")
        drop_scratch(spark, path)
        found = found.unionByName(hits)
    once = found.groupBy("item_id", "doc_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int"), "doc_id", "score")
