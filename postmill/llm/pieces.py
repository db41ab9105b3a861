"""SentencePiece encoding by the unigram algorithm, with a max-plus scan over the chunks of giant documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import mix64, text_slices, wide_rows
from postmill.session import materialise

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NEVER = -(1 << 60)
UNIT = 1024
_BASE = 0x100000001B3
_UNITS = re.compile(r" +[^ ]*|[^ ]+")


class Vocabulary:
    """The pieces of a model file and integer scores, with hash tables for looking up substrings in numpy.

    A unigram file's log-probabilities are taken as they are. A BPE file holds whole numbers for
    its order of merges, so its pieces get those of the Zipf-Mandelbrot law: -log(rank + 2.7) - 2.3. Scores are integers (1/1024 nat), so sums are exact in any order.
    Characters that no piece covers cost the least score less 10 nats and become byte pieces.
    """

    def __init__(self, pieces: list[str], scores: list[float], special: list[bool], byte_ids: list[int]) -> None:
        self.pieces = pieces
        self.byte_ids = np.array(byte_ids, np.int64)
        normal = [i for i, s in enumerate(special) if not s]
        ranked = all(float(scores[i]).is_integer() for i in normal)
        value = {i: -np.log(rank + 2.7) - 2.3 if ranked else scores[i] for rank, i in enumerate(normal)}
        self.table: dict[str, tuple[int, int]] = {}
        for i in normal:
            self.table.setdefault(pieces[i].replace("▁", " "), (i, int(round(value[i] * UNIT))))
        self.longest = max(map(len, self.table))
        self.unknown = min(s for _, s in self.table.values()) - 10 * UNIT
        #: Forced cuts need this of the pieces: a blank stands only at a piece's start or in a run of blanks alone.
        self.cuts = all(" " not in p.lstrip(" ") and (p == " " * len(p) or not p.startswith("  ")) for p in self.table)
        keys = list(self.table)
        self.ids = np.array([self.table[k][0] for k in keys] + [-1])
        self.scores = np.array([self.table[k][1] for k in keys] + [NEVER])
        h = np.array([self._hash(k) for k in keys], np.uint64)
        self.hashes = np.concatenate([h, np.zeros(1, np.uint64)])
        slot = (mix64(h) >> np.uint64(44)).astype(np.int64)
        self.ways = []
        left = np.arange(len(keys))
        while len(left):  # a slot's further pieces go to the next table
            way = np.full(1 << 20, len(keys), np.int32)
            _, first = np.unique(slot[left], return_index=True)
            way[slot[left[first]]] = left[first]
            self.ways.append(way)
            left = np.delete(left, first)
        self.bytes_of = [b""] * len(pieces)
        for i, s in enumerate(special):
            if not s:
                self.bytes_of[i] = pieces[i].replace("▁", " ").encode()
        for b, i in enumerate(byte_ids):
            self.bytes_of[i] = bytes([b])

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * _BASE + ord(c) + 1) & (1 << 64) - 1
        return h

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash; the last index where there is none."""
        slot = (mix64(h) >> np.uint64(44)).astype(np.int64)
        out = np.full(h.shape, len(self.ids) - 1)
        for way in self.ways:
            at = way[slot]
            out = np.where(self.hashes[at] == h, at, out)
        return out

    # -- units: strings between forced cuts --------------------------------------------------------------------

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, offsets, scores) of the best segmentation of each string; the longest last piece wins ties."""
        n = len(units)
        size = np.array([len(u) for u in units], np.int64)
        score = np.zeros(n, np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # unit, token from the end, id or -1 - code point
        low = 0
        for high in (4, 6, 8, 10, 12, 16, 24, 40, 64):
            own = np.flatnonzero((size > low) & (size <= high))
            low = high
            for a in range(0, len(own), 16_384):
                self._block(own[a:a + 16_384], units, size, high, score, parts)
        for i in np.flatnonzero(size > 64).tolist():
            path, score[i] = self.viterbi(units[i])
            parts.append((np.full(len(path), i), np.arange(len(path))[::-1], np.array(path)))
        if not parts:
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64), score
        unit, back, token = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((-back, unit))
        unit, token = unit[order], token[order]
        # characters without a piece become the byte pieces of their UTF-8
        cp = -1 - token
        width = np.where(token >= 0, 1, 1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF))
        ids = np.repeat(token, width)
        if (width != 1).any() or (token < 0).any():
            start = np.cumsum(width) - width
            for k in np.flatnonzero(token < 0).tolist():
                ids[start[k]:start[k] + width[k]] = self.byte_ids[list(chr(int(cp[k])).encode())]
        counts = np.bincount(unit, width, n).astype(np.int64)
        return ids.astype(np.int32), np.concatenate([[0], np.cumsum(counts)]), score

    def _block(self, own: np.ndarray, units: list[str], size: np.ndarray, wide: int, score: np.ndarray, parts: list) -> None:
        flat = np.frombuffer("".join([units[i].ljust(wide, "\0") for i in own.tolist()]).encode("utf-32-le"), np.uint32).reshape(len(own), wide)
        length = size[own]
        pre = np.zeros((wide + 1, len(own)), np.uint64)
        for k in range(wide):
            pre[k + 1] = pre[k] * np.uint64(_BASE) + flat[:, k] + np.uint64(1)
        power = np.array([pow(_BASE, k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        best = np.full((wide + 1, len(own)), NEVER, np.int64)
        best[0] = 0
        step = np.zeros((wide + 1, len(own)), np.int64)
        token = np.zeros((wide + 1, len(own)), np.int64)
        for e in range(1, wide + 1):
            live = length >= e
            if not live.all():
                live = np.flatnonzero(live)
                if not len(live):
                    break
            else:
                live = slice(None)
            top = best[e - 1][live] + self.unknown
            how = np.ones(len(top), np.int64)
            what = -1 - flat[live, e - 1].astype(np.int64)
            for k in range(1, min(e, self.longest) + 1):
                at = self.look_up(pre[e][live] - pre[e - k][live] * power[k])
                s = best[e - k][live] + self.scores[at]
                better = s >= top
                top = np.where(better, s, top)
                how = np.where(better, k, how)
                what = np.where(better, self.ids[at], what)
            best[e][live], step[e][live], token[e][live] = top, how, what
        pos, rows, t = length.copy(), np.arange(len(own)), 0
        score[own] = best[length, rows]
        while len(rows):
            parts.append((own[rows], np.full(len(rows), t), token[pos, rows]))
            pos = pos - step[pos, rows]
            rows, pos, t = rows[pos > 0], pos[pos > 0], t + 1

    def forward(self, s: str, first: np.ndarray | int = 0) -> list:
        """Best score at every position of ``s``, from ``first`` at position 0 (a number, or a vector by entry state)."""
        get = self.table.get
        best: list = [None] * (len(s) + 1)
        best[0] = first
        most = max if isinstance(first, int) else np.maximum
        for p in range(len(s)):
            b = best[p]
            if b is None:
                continue
            for k in range(1, min(self.longest, len(s) - p) + 1):
                hit = get(s[p:p + k])
                if hit is not None or k == 1:
                    v = b + (max(hit[1], self.unknown) if hit else self.unknown)
                    best[p + k] = v if best[p + k] is None else most(best[p + k], v)
        return best

    def viterbi(self, s: str) -> tuple[list[int], int]:
        """Tokens (id, or -1 - code point) and score of one string."""
        best = self.forward(s)
        out, e = [], len(s)
        while e:
            for k in range(min(self.longest, e), 0, -1):
                hit = self.table.get(s[e - k:e])
                if hit and best[e - k] is not None and best[e - k] + hit[1] == best[e]:
                    out.append(hit[0])
                    break
            else:
                k = 1
                out.append(-1 - ord(s[e - 1]))
            e -= k
        return out[::-1], best[len(s)]

    # -- whole texts -------------------------------------------------------------------------------------------

    def units_of(self, texts: pa.Array, prefix: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct units, the unit of each place, and offsets by text. ``prefix``: a blank goes before each non-empty text."""
        n = len(texts)
        lists = pc.split_pattern(texts, " ")
        flat = lists.flatten()
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        coded = flat.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = coded.dictionary.to_pylist()
        blank = np.array([not w for w in words], bool)
        # blanks in a row, or at an end, make units that a plain split doesn't show; so do texts without the prefix
        odd = np.add.reduceat(blank[code], offsets[:-1]) > 0 if n and len(code) else np.zeros(n, bool)
        if not prefix:
            odd[:] = True
        if not self.cuts:
            odd[:] = True
        if not odd.any():
            return [" " + w for w in words], code, offsets
        units = {" " + w: i for i, w in enumerate(words)} if not odd.all() else {}
        out, sizes = [], np.zeros(n, np.int64)
        for i in range(n):
            if odd[i]:
                t = texts[i].as_py()
                t = " " + t if prefix and t else t
                own = np.array([units.setdefault(u, len(units)) for u in (_UNITS.findall(t) if self.cuts else [t] if t else [])], np.int64)
            else:
                own = code[offsets[i]:offsets[i + 1]]
            out.append(own)
            sizes[i] = len(own)
        return list(units), np.concatenate([np.zeros(0, np.int64), *out]), np.concatenate([[0], np.cumsum(sizes)])

    def encode(self, texts: pa.Array, prefix: bool = True) -> tuple[pa.Array, np.ndarray]:
        """A list array of ids, and each text's score."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        units, code, offsets = self.units_of(texts, prefix)
        ids, at, score = self.encode_units(units)
        many = (at[1:] - at[:-1])[code]
        flat = np.repeat(at[:-1][code] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        ends = np.concatenate([[0], np.cumsum(many)])[offsets]
        total = np.concatenate([[0], np.cumsum(score[code])])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids[flat])), total[offsets[1:]] - total[offsets[:-1]]

    def decode(self, ids: pa.Array) -> pa.Array:
        """Texts of lists of ids: pieces joined, byte pieces as bytes, the blank in front dropped."""
        size = np.array([len(b) for b in self.bytes_of], np.int64)
        start = np.cumsum(size) - size
        data = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        many = size[flat]
        out = data[np.repeat(start[flat] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        ends = np.concatenate([[0], np.cumsum(many)])[np.concatenate([[0], np.cumsum(counts)])]
        keep = np.ones(len(out), bool)
        keep[ends[:-1][ends[1:] > ends[:-1]]] = False
        ends = ends - np.concatenate([[0], np.cumsum(ends[1:] > ends[:-1])])
        return pa.Array.from_buffers(pa.large_string(), len(ids), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(out[keep].tobytes())])

    # -- chunks of giant texts ---------------------------------------------------------------------------------

    def transfer(self, body: str, ahead: str) -> np.ndarray:
        """The max-plus transfer matrix of a chunk.

        Entry i: i characters of ``body`` belong to a piece of the chunk before. Exit j: the last piece takes j
        characters of ``ahead``. Cell: the best score of the pieces that start in the chunk.
        """
        m = self.longest
        out = np.full((m, m), NEVER, np.int64)
        first = next((x.start() for x in re.finditer(r"(?<=[^ ]) ", body)), None) if self.cuts else None
        if first is None:
            # no forced cut: all entries go through the whole chunk together
            start = np.full(m, NEVER, np.int64)
            best: list = [None] * (len(body) + m)
            for p in range(len(body)):
                if p < m:
                    v = start.copy()
                    v[p] = 0
                    best[p] = v if best[p] is None else np.maximum(best[p], v)
                self._extend(best, p, body + ahead)
            for j in range(m):
                if best[len(body) + j] is not None:
                    out[:, j] = np.maximum(best[len(body) + j], NEVER)
            for i in range(len(body), m):
                out[i, i - len(body)] = 0
            return out
        last = max(x.start() for x in re.finditer(r"(?<=[^ ]) ", body))
        head = [body[i:first] for i in range(min(m, first + 1))]
        middle = _UNITS.findall(body[first:last])
        distinct: dict[str, int] = {}
        code = np.array([distinct.setdefault(u, len(distinct)) for u in [*head, *middle]], np.int64)
        _, _, score = self.encode_units(list(distinct))
        score = score[code]
        entry = score[: len(head)] + score[len(head):].sum()
        tail = body[last:]
        best = [None] * (len(tail) + m)
        best[0] = 0
        for p in range(len(tail)):
            self._extend(best, p, tail + ahead)
        for j in range(m):
            if best[len(tail) + j] is not None:
                out[: len(head), j] = entry + best[len(tail) + j]
        return out

    def _extend(self, best: list, p: int, s: str) -> None:
        b = best[p]
        if b is None:
            return
        for k in range(1, min(self.longest, len(s) - p) + 1):
            hit = self.table.get(s[p:p + k])
            if (hit or k == 1) and p + k < len(best):
                v = b + (max(hit[1], self.unknown) if hit else self.unknown)
                best[p + k] = v if best[p + k] is None else max(best[p + k], v) if isinstance(v, int) else np.maximum(best[p + k], v)

    def _scores(self, body: str, ahead: str, v: list[int]) -> list:
        """Best score at each position of ``body`` and, for pieces that start in it, of ``ahead``, from entry scores ``v``."""
        best: list = [None] * (len(body) + self.longest)
        for p, x in enumerate(v[:len(best)]):
            if x > NEVER // 2:
                best[p] = x
        for p in range(len(body)):
            self._extend(best, p, body + ahead)
        return best

    def _back(self, s: str, best: list, v: list[int], e: int, body: int) -> tuple[list[int], int]:
        """Tokens of the path that ends at ``e`` and its entry; of equally good last pieces the longest, as in a whole text."""
        out = []
        while not (e < len(v) and v[e] == best[e]):  # a piece that began before is longer than any that begins here
            for k in range(min(self.longest, e), 0, -1):
                hit = self.table.get(s[e - k:e]) if e - k < body else None
                if hit and best[e - k] is not None and best[e - k] + hit[1] == best[e]:
                    out.append(hit[0])
                    break
            else:
                k = 1
                out.append(-1 - ord(s[e - 1]))
            e -= k
        return out[::-1], e

    def _cuts_in(self, body: str) -> tuple[int, int] | None:
        """The first and last forced cut of a chunk."""
        if not self.cuts:
            return None
        at = [x.start() for x in re.finditer(r"(?<=[^ ]) ", body)]
        return (at[0], at[-1]) if at else None

    def entries(self, body: str, ahead: str, v: list[int]) -> list[int]:
        """The entry of the best path to each exit of a chunk, given the best scores ``v`` at its entries; -1 where none leads there."""
        cut, m = self._cuts_in(body), self.longest
        if cut is None:
            best = self._scores(body, ahead, v)
            return [self._back(body + ahead, best, v, len(body) + j, len(body))[1] if best[len(body) + j] is not None else -1 for j in range(m)]
        head = self._scores(body[:cut[0]], "", v)
        entry = self._back(body[:cut[0]], head, v, cut[0], cut[0])[1]
        tail = body[cut[1]:]
        best = self._scores(tail, ahead, [0])
        return [entry if best[len(tail) + j] is not None else -1 for j in range(m)]

    def between(self, body: str, ahead: str, v: list[int], exit_: int) -> np.ndarray:
        """Ids of the pieces that start in a chunk, on the path to ``exit_``."""
        cut = self._cuts_in(body)
        if cut is None:
            return self.to_ids(self._back(body + ahead, self._scores(body, ahead, v), v, len(body) + exit_, len(body))[0])
        head, middle, tail = body[:cut[0]], _UNITS.findall(body[cut[0]:cut[1]]), body[cut[1]:]
        first = self.to_ids(self._back(head, self._scores(head, "", v), v, len(head), len(head))[0])
        distinct: dict[str, int] = {}
        code = [distinct.setdefault(u, len(distinct)) for u in middle]
        ids, at, _ = self.encode_units(list(distinct))
        last = self.to_ids(self._back(tail + ahead, self._scores(tail, ahead, [0]), [0], len(tail) + exit_, len(tail))[0])
        return np.concatenate([first, *[ids[at[c]:at[c + 1]] for c in code], last]).astype(np.int32)

    def to_ids(self, tokens: list[int]) -> np.ndarray:
        """Ids of tokens, a character without a piece (-1 - code point) as the byte pieces of its UTF-8."""
        out: list[int] = []
        for t in tokens:
            out += [t] if t >= 0 else self.byte_ids[list(chr(-1 - t).encode())].tolist()
        return np.array(out, np.int32)


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The associative product of transfer matrices: cell (i, j) is the best a[i, k] + b[k, j]."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(1), NEVER)


def scan_scores(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """The best score at each entry of every chunk: products of all matrices to its left, by doubling."""
    start = np.full(matrices[0].shape[0], NEVER, np.int64)
    start[0] = 0
    return [start, *(p[0] for p in _prefixes(matrices, max_plus)[:-1])]


def scan_exits(entries: list[np.ndarray]) -> list[int]:
    """Each chunk's exit, from the map of exits to entries of the chunks behind it; the last one's is 0."""
    exits, e = [], 0
    for own in reversed(entries):
        exits.append(e)
        e = int(own[e])
    return exits[::-1]


def _prefixes(xs: list, combine) -> list:
    """All prefix combinations by recursive doubling."""
    if len(xs) == 1:
        return xs
    pairs = [combine(xs[i], xs[i + 1]) for i in range(0, len(xs) - 1, 2)]
    inner = _prefixes(pairs, combine)
    out = [xs[0]]
    for i in range(1, len(xs)):
        out.append(inner[i // 2] if i % 2 else combine(inner[i // 2 - 1], xs[i]))
    return out


def load_vocabulary(path: str = MODEL) -> Vocabulary:
    """Read a SentencePiece model file on the driver; tasks get the pieces, not the path."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
    by_byte = {pieces[i]: i for i in range(n) if sp.is_byte(i)}
    return Vocabulary(pieces, [sp.get_score(i) for i in range(n)], special, [by_byte[f"<0x{b:02X}>"] for b in range(256)])


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, chunk_chars: int = 65_536, text_col: str = "text", verify: bool = False) -> DataFrame:
    """All columns of ``docs`` and ``ids``, the SentencePiece ids of the whole text (unigram algorithm, dummy prefix, byte fallback).

    Texts of up to ``chunk_chars`` characters are encoded where they lie. A longer one is cut into chunks that are dealt
    to all tasks: each gives a transfer matrix over its boundary states; one small task by document combines the
    matrices (2 KB a chunk) into each chunk's entry scores; with these every chunk tells on its own which entry leads to
    which exit; and once exits are known, it is segmented between its two states. Of equally good segmentations both
    ways take the one whose last piece is longest, then the one before, and so on: ids don't depend on ``chunk_chars``.

    Null and empty texts have no ids. Repeated rows are encoded each. An empty table gives no rows. A column named
    ``ids`` in the input is replaced. Encoding keeps every character, so decoding gives the text back; with ``verify``
    a column ``round_trip`` says so for each row, from a decoding in the same pass (``decode_documents`` for long texts).
    """
    docs = docs.drop("ids", "round_trip") if verify else docs.drop("ids")
    wide_rows(docs)
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    columns = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "ids array<int>", *["round_trip boolean"] * verify])

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = held.value
        for whole in batches:
            at = whole.schema.get_field_index(text_col)
            for batch in text_slices(whole, text_col, 2 << 20):
                ids, _ = voc.encode(batch.column(at))
                more = [pc.equal(pc.fill_null(batch.column(at).cast(pa.large_string()), ""), voc.decode(ids))] if verify else []
                yield pa.RecordBatch.from_arrays([*batch.columns, ids, *more], [*batch.schema.names, "ids", *["round_trip"] * verify])

    size = F.coalesce(F.char_length(text_col), F.lit(0))
    short = docs.where(size <= chunk_chars).mapInArrow(direct, columns)
    long_, _ = materialise(docs.where(size > chunk_chars).withColumn("__row", F.monotonically_increasing_id()), "giants")
    chunks = giant_chunks(long_.select("__row", F.col(text_col).alias("text")), vocabulary, chunk_chars)
    whole = chunks.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("c")).select("__row", F.flatten("c.ids").alias("ids"))
    joined = long_.join(whole, "__row").drop("__row")
    if verify:
        joined = decode_documents(joined, vocabulary).withColumn("round_trip", F.col(text_col) == F.col("decoded")).drop("decoded")
    return short.unionByName(joined)


def giant_chunks(giants: DataFrame, vocabulary: Vocabulary, chunk_chars: int) -> DataFrame:
    """(__row, chunk, ids) of every chunk of the long texts (__row, text)."""
    held = giants.sparkSession.sparkContext.broadcast(vocabulary)
    m = vocabulary.longest

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("__row"), batch.column("text")):
                s = " " + text.as_py()
                n = -(-len(s) // chunk_chars)
                for a in range(0, n, 64):  # about 64 chunks leave at a time
                    ks = range(a, min(n, a + 64))
                    bodies = [s[k * chunk_chars:(k + 1) * chunk_chars] for k in ks]
                    aheads = [s[(k + 1) * chunk_chars:(k + 1) * chunk_chars + m - 1] for k in ks]
                    yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(ks), pa.int64()), pa.array(list(ks), pa.int32()), pa.array(bodies, pa.string()), pa.array(aheads, pa.string())], ["__row", "chunk", "body", "ahead"])

    pieces, _ = materialise(giants.mapInArrow(cut, "__row long, chunk int, body string, ahead string").repartition(F.xxhash64("__row", "chunk")), "chunks")

    def each(function, out: str, *more: str):
        """A function of a chunk's columns, over batches."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            voc = held.value
            for batch in batches:
                cells = [function(voc, *x) for x in zip(*(batch.column(c).to_pylist() for c in ("body", "ahead", *more)))]
                yield pa.RecordBatch.from_arrays([batch.column("__row"), batch.column("chunk"), pa.array(cells, pa.list_(pa.int32()) if out == "ids" else pa.list_(pa.int64()))], ["__row", "chunk", out])

        return run

    def scores(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        v = scan_scores([np.array(c, np.int64).reshape(m, m) for c in table.column("cells").to_pylist()])
        return pa.table({"__row": table.column("__row"), "chunk": table.column("chunk"), "v": pa.array([x.tolist() for x in v], pa.list_(pa.int64()))})

    def exits(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        return pa.table({"__row": table.column("__row"), "chunk": table.column("chunk"), "exit": pa.array(scan_exits(table.column("entries").to_pylist()), pa.int32())})

    by, key = ["__row", "chunk"], "__row long, chunk int"
    matrices = pieces.mapInArrow(each(lambda voc, body, ahead: voc.transfer(body, ahead).ravel().tolist(), "cells"), f"{key}, cells array<long>")
    entry, _ = materialise(matrices.groupBy("__row").applyInArrow(scores, f"{key}, v array<long>"), "entry-scores")
    maps = pieces.join(entry, by).mapInArrow(each(Vocabulary.entries, "entries", "v"), f"{key}, entries array<long>")
    states, _ = materialise(maps.groupBy("__row").applyInArrow(exits, f"{key}, exit int"), "exits")
    return pieces.join(entry, by).join(states, by).mapInArrow(each(Vocabulary.between, "ids", "v", "exit"), f"{key}, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """All columns and ``decoded``, the text of the ids; null ids give a null text."""
    encoded = encoded.drop("decoded")
    held = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    columns = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema), "decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = held.value
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            # runs of rows of about half a million ids
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
            cuts = np.searchsorted(ends // 500_000, np.arange(0, (ends[-1] if len(ends) else 0) // 500_000 + 1), side="left").tolist() + [batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a).take(pa.array(np.arange(b - a)))
                text = voc.decode(part.column(at)).cast(pa.string())
                text = pc.if_else(pc.is_valid(part.column(at)), text, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, text], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, columns)
