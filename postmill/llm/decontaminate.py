"""Benchmark decontamination by q-gram counts in diagonal bands and banded alignment."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import mix64, text_slices, wide_rows
from postmill.session import materialise

MATCHES = "array<struct<item_id:bigint,start:int,end:int,edits:int>>"
_MATCH = pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())])


#: Bytes that count as blanks (every ASCII character but letters and digits), and lower case for ASCII.
_FLAT = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
_MARKS = re.compile(rb"\xc2[\x80-\xbf]|\xe2[\x80\x81][\x80-\xbf]|\xe3\x80[\x80-\xbf]")


def normalise(text: str) -> bytes:
    """Lower-case UTF-8 with every run of blanks and marks as one blank, and a blank at either end.

    Marks are ASCII punctuation and the Latin-1, general and CJK punctuation blocks.
    """
    data = text.lower().encode()
    if not text.isascii():
        data = _MARKS.sub(b" ", data)
    return b" " + b" ".join(data.translate(_FLAT).split()) + b" "


def source_positions(text: str) -> np.ndarray:
    """The code point of ``text`` behind each byte of ``normalise(text)``."""
    at, blank = [0], True
    for i, c in enumerate(text):
        data = c.lower().encode()
        data = _MARKS.sub(b" ", data).translate(_FLAT)
        if data.strip():
            at += [i] * len(data)
            blank = False
        elif not blank:
            at.append(i)
            blank = True
    if not blank or len(at) == 1:
        at.append(len(text))
    return np.array(at)


@dataclass
class Benchmark:
    """Normalised items and their q-grams, ordered by hash slot; one instance holds a bounded block of items."""

    ids: list[int]
    texts: list[bytes]
    q: int
    rate: float
    bits: int
    grams: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    first: np.ndarray
    budget: np.ndarray
    need: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by length below q: values and their items

    @staticmethod
    def build(items: list[tuple[int, str]], q: int = 8, rate: float = 0.1) -> Benchmark:
        ids, texts, grams, item, pos = [], [], [], [], []
        for i, t in sorted(items):
            norm = normalise(t)
            if not norm.strip():
                continue
            g = qgrams(norm, q)
            grams.append(g)
            item.append(np.full(len(g), len(ids)))
            pos.append(np.arange(len(g)))
            ids.append(i)
            texts.append(norm)
        none = np.zeros(0, np.int64)
        grams_, item_, pos_ = np.concatenate([np.zeros(0, np.uint64), *grams]), np.concatenate([none, *item]), np.concatenate([none, *pos])
        bits = max(16, int(len(grams_)).bit_length() + 4 if len(grams_) < 1 << 17 else int(len(grams_)).bit_length() + 3)
        slot = slots(grams_, bits)
        o = np.lexsort((pos_, item_, slot))
        first = np.concatenate([[0], np.cumsum(np.bincount(slot, minlength=1 << bits))]).astype(np.int32)
        length = np.array([len(t) for t in texts], np.int64)
        # the q-gram lemma: within e edits, n + 1 - q - q e of an item's q-grams survive; e is held so that one does
        # items shorter than two q-grams have no budget, so they are found as they are
        budget = np.maximum(0, np.minimum((length * rate).astype(np.int64), (length - q) // q))
        need = np.maximum(1, length + 1 - q - q * budget)
        short = {}
        for n in np.unique(length[length < q]).tolist():
            own = np.flatnonzero(length == n)
            value = np.array([int(qgrams(texts[i], n)[0]) for i in own.tolist()], np.uint64)
            k = np.argsort(value, kind="stable")
            short[n] = value[k], own[k]
        return Benchmark(ids, texts, q, rate, bits, grams_[o], item_[o], pos_[o], first, budget, need, short)


def qgrams(data: bytes, q: int) -> np.ndarray:
    """Every window of q bytes (8 at most) as one integer."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.ndarray((n,), "<u8", bytes(data) + b"\0" * 8, strides=(1,))
    return g & np.uint64((1 << 8 * q) - 1)


def slots(grams: np.ndarray, bits: int) -> np.ndarray:
    return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


FAR = 1 << 30


def banded_edits(item: bytes, text: np.ndarray, width: int, anchor: int | None, budget: int) -> tuple[int, int] | None:
    """(edits, offset) of the best alignment of the whole item to ``text`` along diagonals 0 to ``width``.

    Without ``anchor`` it may begin on any diagonal for nothing; with one, it begins there and other diagonals cost
    the characters between. It may end anywhere: the stretch ends at ``len(item) + offset``. None above ``budget``.
    """
    d = np.arange(width + 1)
    row = np.zeros(width + 1, np.int64) if anchor is None else np.where(d >= anchor, d - anchor, FAR)
    need = len(item) + width
    if len(text) < need:
        text = np.concatenate([text, np.full(need - len(text), 256, text.dtype)])
    for k, c in enumerate(item):
        new = row + (text[k:k + width + 1] != c)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        row = np.minimum.accumulate(new - d) + d
        if k & 15 == 15 and row.min() > budget:
            return None
    at = int(np.argmin(row))
    return (int(row[at]), at) if row[at] <= budget else None


def find_items(norm: bytes, bench: Benchmark) -> list[tuple[int, int, int, int]]:
    """(item index, start, end, edits) of benchmark items in one normalised text, in byte positions.

    Shared q-grams are counted by item and diagonal band; bands are as wide as twice the edit budget and overlap by
    half, so the matches of any region within the budget share one. Bands that reach the lemma's bound are
    retained and their region is aligned along its diagonals. A copy that follows at once is reported too; matches of
    an item share a blank at most. Items shorter than a q-gram are looked up whole.
    """
    if not bench.ids:
        return []
    out = []
    for n, (value, own) in bench.short.items():
        g = qgrams(norm, n)
        lo, hi = np.searchsorted(value, g, "left"), np.searchsorted(value, g, "right")
        out += [(int(own[k]), int(p), int(p) + n, 0) for p in np.flatnonzero(hi > lo).tolist() for k in range(int(lo[p]), int(hi[p]))]
    return out + _aligned(norm, bench)


def _aligned(norm: bytes, bench: Benchmark) -> list[tuple[int, int, int, int]]:
    g = qgrams(norm, bench.q)
    slot = slots(g, bench.bits)
    lo = bench.first[slot]
    many = bench.first[slot + 1] - lo
    at = np.flatnonzero(many)
    if not len(at):
        return []
    lo, many = lo[at].astype(np.int64), many[at].astype(np.int64)
    flat = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    at = np.repeat(at, many)
    item = bench.item[flat]
    enough = (np.bincount(item, minlength=len(bench.ids)) >= bench.need)[item]  # by the whole text: a bound on every band
    enough &= bench.grams[flat] == g[at]
    if not enough.any():
        return []
    at, flat, item = at[enough], flat[enough], item[enough]
    diagonal = at - bench.pos[flat]
    width = np.maximum(2, 2 * bench.budget[item])
    base = int(diagonal.min())
    stride = int(diagonal.max()) - base + 3
    found = []
    for half in (0, 1):
        band = (diagonal - base + half * (width // 2)) // width
        kinds, first, count = np.unique(item * stride + band, return_index=True, return_counts=True)
        ok = count >= bench.need[item[first]]
        for f, k in zip(first[ok].tolist(), kinds[ok].tolist()):
            i, w = int(item[f]), int(width[f])
            low = (k - i * stride) * w - half * (w // 2) + base
            found.append((i, low, low + w))
    data = np.frombuffer(norm, np.uint8).astype(np.int16)

    def beyond(floor: int, start: int, end: int) -> np.ndarray:
        """A stretch of the text in which nothing before ``floor``, a match's end, can match again."""
        part = data[start:end]
        if start < floor:
            part = part.copy()
            part[:floor - start] = 256
        return part

    out, done = [], {}
    for i, low, high in sorted(found):
        e, own = int(bench.budget[i]), bench.texts[i]
        a, floor = low - e, done.get(i, 0)
        if high + e < floor:
            continue  # the region just reported
        window = beyond(floor, max(0, a), max(0, high + len(own) + e))
        if a < 0:
            window = np.concatenate([np.full(-a, 256, np.int16), window])
        hit = banded_edits(own, window, high - low + 2 * e, None, e)
        if hit:
            end = min(len(norm), a + len(own) + hit[1])
            before = beyond(floor, max(0, end - len(own) - e), end)[::-1]
            back = banded_edits(own[::-1], np.concatenate([np.full(e, 256, np.int16), before]), 2 * e, e, FAR // 2)
            start = max(0, end - (len(own) + back[1] - e)) if back else max(0, end - len(own))
            out.append((i, max(start, floor), end, hit[0]))
            done[i] = end - 1  # the next copy may share the blank at this one's end
    return out


def _order(match: dict) -> tuple:
    return match["item_id"], match["start"], match["end"]


def _finder(bench: Benchmark):
    def find(text: str) -> list[dict]:
        norm = normalise(text)
        hits = find_items(norm, bench)
        if not hits:
            return []
        at = source_positions(text)
        out = []
        for i, s, e, edits in hits:
            while s < e - 1 and norm[s] == 32:
                s += 1
            while e - 1 > s and norm[e - 1] == 32:
                e -= 1
            out.append({"item_id": bench.ids[i], "start": int(at[s]), "end": int(at[e - 1]) + 1, "edits": edits})
        return sorted(out, key=_order)

    return find


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")


def _blocks(benchmark: DataFrame, q: int, rate: float, held_bytes: int, block_bytes: int) -> list[Benchmark] | None:
    """A benchmark of at most ``held_bytes`` of text as blocks of about ``block_bytes``; None for a larger one."""
    items = _items(benchmark)
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > held_bytes:
        return None
    blocks, now, size = [], [], 0
    for item, text in sorted(items.collect()):
        now.append((item, text))
        size += len(text.encode())
        if size >= block_bytes:
            blocks.append(Benchmark.build(now, q, rate))
            now, size = [], 0
    return [*blocks, Benchmark.build(now, q, rate)] if now or not blocks else blocks


def _keys(norm: bytes, q: int, lengths: list[int]) -> np.ndarray:
    """A hash of each q-gram of a text, and of each of its windows of the shorter ``lengths``."""
    return np.concatenate([mix64(qgrams(norm, n) + np.uint64(n) * np.uint64(0x9E3779B97F4A7C15)) for n in [q, *lengths]])


FILTER_BITS = 27


def _by_join(rows: DataFrame, benchmark: DataFrame, q: int, rate: float) -> DataFrame:
    """(row, matches) of the rows (row, text) that hold an item, for benchmarks of any size.

    Items' q-grams are a table. A filter of 2^27 bits of it, 16 MB whatever its size, travels to the texts; their
    q-grams that pass meet the table in a join, and the lemma's bound on the shared q-grams of a text and an item leaves the
    pairs that are searched. The numbers of Python stages and of jobs don't depend on the benchmark.
    """
    items, _ = materialise(_items(benchmark).withColumn("item", F.monotonically_increasing_id()), "items")

    def index_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                one = Benchmark.build([(0, text)], q, rate)
                if one.ids:
                    norm = one.texts[0]
                    key, n = np.unique(_keys(norm, q, []) if len(norm) >= q else _keys(norm, q, [len(norm)]), return_counts=True)
                    k = len(key)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * k, pa.int64()), pa.array(key.view(np.int64)), pa.array(n, pa.int64()), pa.array([int(one.need[0])] * k, pa.int64()), pa.array([min(len(norm), q)] * k, pa.int32())],
                        ["item", "key", "n", "need", "width"],
                    )

    index, _ = materialise(items.mapInArrow(index_of, "item long, key long, n long, need long, width int"), "grams")
    slot = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    parts = index.select(slot.alias("s")).groupBy(F.shiftright("s", 15).alias("w")).agg(F.bitmap_construct_agg(F.col("s") % 32768).alias("bits")).collect()
    table = np.zeros((1 << (FILTER_BITS - 15), 4096), np.uint8)
    for r in parts:  # 4,096 words of 4 KB at most
        table[int(r["w"])] = np.frombuffer(r["bits"], np.uint8)
    lengths = sorted(r["width"] for r in index.select("width").where(F.col("width") < q).distinct().collect())
    held = rows.sparkSession.sparkContext.broadcast(table.ravel())

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for whole in batches:
            for batch in text_slices(whole):
                for row, text in zip(batch.column("row").to_pylist(), pc.fill_null(batch.column("text"), "").to_pylist()):
                    key = _keys(normalise(text), q, lengths)
                    at = key >> np.uint64(64 - FILTER_BITS)
                    key, n = np.unique(key[(bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1], return_counts=True)
                    if len(key):
                        yield pa.RecordBatch.from_arrays([pa.array([row] * len(key), pa.int64()), pa.array(key.view(np.int64)), pa.array(n, pa.int64())], ["row", "key", "m"])

    shared = rows.mapInArrow(hits, "row long, key long, m long").join(index, "key").groupBy("row", "item").agg(F.sum(F.col("n") * F.col("m")).alias("shared"), F.max("need").alias("need"))
    pairs = shared.where("shared >= need").join(items.select("item", "item_id", F.col("text").alias("item_text")), "item")
    asked = rows.join(pairs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("item_id", "item_text"))).alias("items")), "row")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_finder(Benchmark.build([(i["item_id"], i["item_text"]) for i in items], q, rate))(text) for text, items in zip(batch.column("text").to_pylist(), batch.column("items").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.list_(_MATCH))], ["row", "matches"])

    return asked.select("row", "text", "items").mapInArrow(search, f"row long, matches {MATCHES}").where(F.size("matches") > 0)


def contamination(
    docs: DataFrame, benchmark: DataFrame, q: int = 8, rate: float = 0.1, block_bytes: int = 250_000, held_bytes: int = 1_000_000,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, matches) of every document: where it holds a benchmark item within ``rate`` edits a byte.

    A benchmark of up to ``held_bytes`` of text travels to the tasks as q-gram tables, some 50 MB at most, and nothing is
    shuffled. A larger one is joined (``_by_join``); the matches are the same. Whole texts are searched. Case,
    punctuation and white space don't count. Items shorter than two q-grams have no edit budget: they are found where
    they stand whole, between blanks or marks, so a one-word item is found wherever its word is. Items that are null
    or hold no letter or digit are left out; repeated items are all reported. A null or empty document matches nothing;
    repeated rows are answered each; an empty benchmark or table gives empty matches or no rows; other columns are
    ignored. The session's Arrow batches are held to 2,000 rows.
    """
    wide_rows(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = _blocks(benchmark, q, rate, held_bytes, block_bytes)
    if blocks is not None:
        found = rows.mapInArrow(_search(docs.sparkSession.sparkContext.broadcast(blocks)), f"id {rows.schema['id'].dataType.simpleString()}, matches {MATCHES}")
    else:
        rows, _ = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
        found = rows.select("row", "id").join(_by_join(rows.select("row", "text"), benchmark, q, rate), "row", "left")
        found = found.select("id", F.coalesce("matches", F.array().cast(MATCHES)).alias("matches"))
    return found.select(F.col("id").alias(id_col), "matches")


def _search(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [_finder(b) for b in held.value]
        for whole in batches:
            for batch in text_slices(whole):
                found = [sorted((m for f in finders for m in f(t)), key=_order) for t in pc.fill_null(batch.column("text"), "").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(_MATCH))], ["id", "matches"])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = 8, rate: float = 0.1, block_bytes: int = 250_000, held_bytes: int = 1_000_000, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark item (see ``contamination``); null and empty texts stay, and repeated rows."""
    wide_rows(docs)
    blocks = _blocks(benchmark, q, rate, held_bytes, block_bytes)
    if blocks is not None:
        return docs.mapInArrow(_sieve(docs.sparkSession.sparkContext.broadcast(blocks), text_col), docs.schema)
    rows, _ = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = _by_join(rows.select(F.col("__row").alias("row"), F.col(text_col).cast("string").alias("text")), benchmark, q, rate)
    return rows.join(found.select(F.col("row").alias("__row")), "__row", "left_anti").select(*docs.columns)


def _sieve(held, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = held.value
        for whole in batches:
            for batch in text_slices(whole, text_col):
                texts = pc.fill_null(batch.column(batch.schema.get_field_index(text_col)), "").to_pylist()
                norms = [normalise(t) for t in texts]
                yield batch.filter(pa.array([not any(find_items(t, b) for b in blocks) for t in norms], pa.bool_()))

    return run
