"""Token counts by transducers compiled from a byte-level BPE file.

Two machines follow one another. The first parts a text into words, by nine states over classes of characters; chunks of
the text yield state maps, which compose by a parallel prefix scan. The second reads a word's bytes; its state is the last
token of each prefix within reach of the longest token, and each transition tells how many tokens were emitted.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import sums_by_row, text_slices, wide_rows

MODEL = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the pattern of the byte-level pre-tokenizer that the first machine implements.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# classes of characters; +FIRST marks the first character of a text
STMD, RV, EL, E, LETTER, NUMBER, BLANK, SPACE, QUOTE, OTHER = range(10)
FIRST, SPECIAL, SPECIAL_REST, PADDING, UNKNOWN = 10, 20, 21, 22, 255
# states: what the open word is
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_BLANK, AFTER_SPACE, AFTER_QUOTE, QUOTE_RV, QUOTE_L = range(9)
STATES = 9
# outputs: a word starts here, a word started at the character before
HERE, BEFORE = 1, 2


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, output) of every (class, state)."""
    letters = (STMD, RV, EL, E, LETTER)
    opened = {**dict.fromkeys(letters, IN_LETTERS), NUMBER: IN_NUMBERS, BLANK: AFTER_BLANK, SPACE: AFTER_SPACE, QUOTE: AFTER_QUOTE, OTHER: IN_OTHERS}
    runs = {IN_LETTERS: letters, IN_NUMBERS: (NUMBER,), IN_OTHERS: (OTHER, QUOTE)}
    joins = {**dict.fromkeys(letters, IN_LETTERS), NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE: IN_OTHERS}
    suffix = {STMD: START, RV: QUOTE_RV, EL: QUOTE_L, OTHER: IN_OTHERS, QUOTE: IN_OTHERS}
    to, out = np.zeros((23, STATES), np.uint8), np.zeros((23, STATES), np.uint8)
    for c in range(10):
        for s in range(STATES):
            step = (opened[c], HERE)
            if s in runs and c in runs[s]:
                step = (s, 0)
            elif s in (AFTER_BLANK, AFTER_SPACE):
                if c in (BLANK, SPACE):
                    step = (opened[c], 0)
                elif s == AFTER_BLANK:  # the blank belongs to the word that follows
                    step = (joins[c], BEFORE)
                else:
                    step = (opened[c], HERE | BEFORE)
            elif s == AFTER_QUOTE and c in suffix:
                step = (suffix[c], 0)
            elif s in (QUOTE_RV, QUOTE_L):
                if c == (E if s == QUOTE_RV else EL):
                    step = (START, 0)
                else:  # the quote stood alone and its letter opened a word
                    step = (IN_LETTERS, BEFORE) if c in letters else (opened[c], HERE | BEFORE)
            to[c, s], out[c, s] = step
    for s in range(STATES):
        left = BEFORE if s in (QUOTE_RV, QUOTE_L) else 0
        for c in range(10):
            to[c + FIRST, s], out[c + FIRST, s] = opened[c], HERE | left
        to[SPECIAL, s], out[SPECIAL, s] = START, HERE | left
        to[SPECIAL_REST, s], to[PADDING, s] = START, s
    return to, out


def class_runs() -> tuple[np.ndarray, np.ndarray]:
    """Classes of all code points as (class, length) runs; code points that this Python's Unicode doesn't know are UNKNOWN."""
    table = np.full(0x110000, OTHER, np.uint8)
    major = np.array([unicodedata.category(chr(c)) for c in range(0x110000)])
    table[np.char.startswith(major, "L")] = LETTER
    table[np.char.startswith(major, "N")] = NUMBER
    table[major == "Cn"] = UNKNOWN
    spaces = [9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[spaces], table[32], table[39] = SPACE, BLANK, QUOTE
    for c, chars in ((STMD, "stmd"), (RV, "rv"), (EL, "l"), (E, "e")):
        table[[ord(x) for x in chars]] = c
    cuts = np.flatnonzero(np.diff(table)) + 1
    return table[np.concatenate([[0], cuts])], np.diff(np.concatenate([[0], cuts, [len(table)]]))


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (one row each), doubling the reach until every row has forgotten its entry."""
    maps, reach = maps.copy(), 1
    while reach < len(maps) and (maps[reach:] != maps[reach:, :1]).any():
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], 1)
        reach *= 2
    return maps


class WordMachine:
    """Marks where words start in the concatenated characters of many texts."""

    def __init__(self) -> None:
        self.runs = class_runs()
        self.to, self.out = _machine()
        self.table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "table": None}  # tasks unfold the runs anew

    def classes(self, points: np.ndarray) -> np.ndarray:
        if self.table is None:
            self.table = np.repeat(*self.runs)
        found = self.table[points]
        if (found == UNKNOWN).any():  # newer than this Python: the tokenizer's own library tells
            from tokenizers.pre_tokenizers import ByteLevel

            words = ByteLevel(add_prefix_space=False)
            for c in np.unique(points[found == UNKNOWN]).tolist():
                alone = [k for k, p in ((LETTER, "x"), (NUMBER, "1"), (OTHER, "!")) if len(words.pre_tokenize_str(p + chr(c))) == 1]
                self.table[c] = alone[0] if alone else SPACE
            found = self.table[points]
        return found

    def starts(self, cls: np.ndarray, width: int = 64, probe: int = 8) -> np.ndarray:
        """Whether a word starts at each character. Rows of ``width`` characters are the chunks of the scan."""
        n = len(cls)
        if not n:
            return np.zeros(0, bool)
        rows = -(-n // width)
        grid = np.full(rows * width, PADDING, np.intp)
        grid[:n] = cls
        grid = np.ascontiguousarray(grid.reshape(rows, width).T) * STATES
        to, out = self.to.ravel(), self.out.ravel()
        maps = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))
        for j in range(min(probe, width)):
            maps = to[grid[j][:, None] + maps]
        same = (maps == maps[:, :1]).all(1)
        one, many, rest = maps[same, 0], maps[~same], grid[:, ~same]
        sure = grid[:, same]
        for j in range(min(probe, width), width):
            one = to[sure[j] + one]
            if len(many):
                many = to[rest[j][:, None] + many]
        maps[same], maps[~same] = one[:, None], many
        state = np.concatenate([[START], compose(maps)[:-1, START]]).astype(np.uint8)
        marks = np.empty((width, rows), np.uint8)
        for j in range(width):
            at = grid[j] + state
            marks[j], state = out[at], to[at]
        marks = marks.T.ravel()
        begins = (marks[:n] & HERE) > 0
        begins[:-1] |= (marks[1:n] & BEFORE) > 0
        if state[-1] in (QUOTE_RV, QUOTE_L):  # the last text ends after a quote and a letter, which is a word of its own
            begins[-1] = True
        return begins


class ByteMachine:
    """Counts the tokens of words by the merges of a BPE file.

    A token may follow another where merging their bytes from scratch gives just these two; it ends a prefix where it
    may follow the last token of what is before it, and just one does. So the last token of every prefix of a word, and the count up to there,
    come from those of the prefixes that one token shorter leaves.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and model.get("type") == "BPE"
        if not plain or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("only byte-level BPE files with the plain pattern can be compiled")
        added = spec.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens with conditions can't be compiled")
        self.special = [t["content"].encode() for t in sorted(added, key=lambda t: -len(t["content"])) if t["content"]]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file; the others follow from 256 on
        char = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        index = {c: b for c, b in char.items()}
        for k, (x, y) in enumerate(merges):
            if index.setdefault(x + y, 256 + k) != 256 + k:
                raise ValueError("a token that two merges make")
        size = 256 + len(merges)
        self.left, self.right = np.arange(size), np.arange(size)
        self.left[256:] = [index[x] for x, _ in merges]
        self.right[256:] = [index[y] for _, y in merges]
        key = self.left[256:] * size + self.right[256:]
        order = np.argsort(key)
        self.pairs, self.made, self.size = key[order], order + 256, size
        self.tokens = [bytes(char[c] for c in t) for t in sorted(index, key=index.get)]
        self.reach = max(map(len, self.tokens))
        self._plant(self._sound())

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that two tokens merge to, or ``size``."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.made[at], self.size)

    def follows(self, a: np.ndarray, b: np.ndarray, inside: bool = False) -> np.ndarray:
        """Whether merging the bytes of a and b from scratch leaves a beside b (``inside``: until these two merge themselves).

        From the last merge backwards: the tokens at the border stood side by side until one of them was merged into a
        larger one; had they a merge of their own before that, it would have come first. Of equal merges the left one is first.
        """
        a, b = a.copy(), b.copy()
        ok, until, live = np.ones(len(a), bool), np.full(len(a), 0 if inside else self.size), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            clash = self.merged(x, y) < until[live]
            ok[live[clash]] = False
            live = live[~clash & ((x >= 256) | (y >= 256))]
            x, y = a[live], b[live]
            newer = x > y
            until[live] = np.where(newer, x, y + 1)
            a[live], b[live] = np.where(newer, self.right[x], x), np.where(newer, y, self.left[y])
        return ok

    def _sound(self) -> np.ndarray:
        """Tokens whose own bytes merge to just them."""
        ok = np.ones(self.size, bool)
        ok[256:] = self.follows(self.left[256:], self.right[256:], inside=True)
        for t in range(256, self.size):
            ok[t] &= ok[self.left[t]] and ok[self.right[t]]
        return ok

    def _plant(self, sound: np.ndarray) -> None:
        """A trie over the sound tokens: children by (node, byte), and the token that ends at each node."""
        child: dict[int, int] = {}
        ends = [-1]
        for t in np.flatnonzero(sound).tolist():
            node = 0
            for byte in self.tokens[t]:
                node_key = node << 8 | byte
                node = child.get(node_key, -1)
                if node < 0:
                    node = child[node_key] = len(ends)
                    ends.append(-1)
            ends[node] = t
        keys = np.array(sorted(child), np.int64)
        self.keys, self.nodes, self.ends = keys, np.array([child[k] for k in keys.tolist()]), np.array(ends)
        self.tokens = []

    def child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = node << 8 | byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.nodes[at], -1)

    def spans(self, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every token in the words: (start, end, token); ``stop`` is where each byte's word ends."""
        at = np.arange(len(data))
        node, length, found = np.zeros(len(data), np.int64), 0, []
        while len(at):
            node = self.child(node, data[at + length].astype(np.int64))
            length += 1
            live = node >= 0
            at, node = at[live], node[live]
            token = self.ends[node]
            hit = token >= 0
            found.append((at[hit], at[hit] + length, token[hit]))
            more = at + length < stop[at]
            at, node = at[more], node[more]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3

    def count(self, data: np.ndarray, offsets: np.ndarray, chunk: int = 4096) -> np.ndarray:
        """Number of tokens of each word ``data[offsets[i]:offsets[i + 1]]``; words are not empty.

        All words step together, byte by byte. Longer words than ``chunk`` are read in chunks as if each began a word; then
        each chunk's true entry state is carried through it until its run meets the one that was read, from where only the count differs.
        """
        size = np.diff(offsets)
        stop = np.repeat(offsets[1:], size)
        begin, end, token = self.spans(data, stop)
        word = np.repeat(offsets[:-1], size)[begin]
        base = word + (begin - word) // chunk * chunk  # where the chunk of a span's first byte begins
        step = end - base
        inner = step <= chunk  # spans that leave their chunk are for the fix-up alone
        order = np.argsort(step[inner], kind="stable")
        b, e, t, s0, step = begin[inner][order], end[inner][order], token[inner][order], base[inner][order], step[inner][order]
        last, total = np.full(len(data), -1), np.zeros(len(data), np.int64)
        cuts = np.searchsorted(step, np.arange(1, (int(step[-1]) if len(step) else 0) + 2))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            x, y, k = b[lo:hi], e[lo:hi], t[lo:hi]
            whole = x == s0[lo:hi]
            ok = whole.copy()
            ok[~whole] = self.follows(last[x[~whole] - 1], k[~whole])
            x, y, k, whole = x[ok], y[ok], k[ok], whole[ok]
            last[y - 1] = k
            total[y - 1] = np.where(whole, 0, total[x - 1]) + 1
        for w in np.flatnonzero(size > chunk).tolist():
            self._carry(int(offsets[w]), int(offsets[w + 1]), chunk, begin, end, token, last, total)
        return total[offsets[1:] - 1]

    def _carry(self, a: int, z: int, chunk: int, begin: np.ndarray, end: np.ndarray, token: np.ndarray, last: np.ndarray, total: np.ndarray) -> None:
        """Carry the true state of a long word through its chunks, in place."""
        own = (begin >= a) & (end <= z)
        order = np.argsort(end[own], kind="stable")
        begin, end, token = begin[own][order], end[own][order], token[own][order]
        known: dict[tuple[int, int], bool] = {}
        for s in range(a + chunk, z, chunk):
            stop, met, gap = min(s + chunk, z), 0, 0
            lo = int(np.searchsorted(end, s + 1))
            for p in range(s, stop):  # the prefix that ends with byte p
                hi = lo
                new = None
                while hi < len(end) and end[hi] == p + 1:
                    x, k = int(begin[hi]), int(token[hi])
                    before = int(last[x - 1]) if x > a else -1
                    pair = (before, k)
                    if x == a or known.get(pair) or pair not in known and known.setdefault(pair, bool(self.follows(np.array([before]), np.array([k]))[0])):
                        new = (k, (int(total[x - 1]) if x > a else 0) + 1)
                    hi += 1
                lo = hi
                apart = new[1] - int(total[p])
                met = 0 if new[0] != last[p] else met + 1 if apart == gap else 1
                gap = apart
                last[p], total[p] = new
                if met >= self.reach:
                    total[p + 1:stop] += gap
                    break


def _counter(words: WordMachine, machine: ByteMachine, giant: int, known_bytes: int = 32 << 20):
    special = {s: 1 for s in machine.special}
    pattern = re.compile(b"|".join(map(re.escape, machine.special))) if machine.special else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = dict(special), 0

        def count_distinct(distinct: pa.Array) -> np.ndarray:
            nonlocal known, held
            values = distinct.to_pylist()
            counts = np.array([known.get(v, -1) for v in values], np.int64)
            new = np.flatnonzero(counts < 0)
            if len(new):
                fresh = [values[i] for i in new.tolist()]
                ends = np.concatenate([[0], np.cumsum([len(v) for v in fresh])])
                counts[new] = machine.count(np.frombuffer(b"".join(fresh), np.uint8), ends)
                if held > known_bytes:
                    known, held = dict(special), 0
                for v, c in zip(fresh, counts[new].tolist()):
                    if len(v) <= 64:
                        known[v] = c
                        held += len(v) + 120
            return counts

        def count_texts(texts: list[bytes]) -> np.ndarray:
            """Tokens of each of some texts that are well-formed UTF-8."""
            data = b"".join(texts)
            ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            raw = np.frombuffer(data, np.uint8)
            leads = np.flatnonzero((raw & 0xC0) != 0x80)
            points = raw if len(leads) == len(raw) else np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
            cls = words.classes(points)
            first = np.searchsorted(leads, ends[:-1][np.diff(ends) > 0])
            cls[first] += FIRST
            if pattern and any(s in data for s in machine.special):
                for t, a in zip(texts, ends[:-1].tolist()):
                    for m in pattern.finditer(t):
                        lo, hi = np.searchsorted(leads, [a + m.start(), a + m.end()])
                        cls[lo], cls[lo + 1:hi] = SPECIAL, SPECIAL_REST
            begins = leads[words.starts(cls)]
            cuts = pa.py_buffer(np.append(begins, len(raw)).astype(np.int64).tobytes())
            coded = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, cuts, pa.py_buffer(data)]).dictionary_encode()
            counts = count_distinct(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)] if len(begins) else np.zeros(0, np.int64)
            return sums_by_row(counts, np.searchsorted(begins, ends))

        for whole in batches:
            for batch in text_slices(whole):
                texts = [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
                size = np.array([len(t) for t in texts], np.int64)
                texts = [t if well_formed(t) else t.decode("utf-8", "replace").encode() for t in texts]
                if len(texts) == 1:
                    counts = sum(count_texts([part]) for part in pieces_of(texts[0], giant))
                else:
                    counts = count_texts(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])

    return run


def well_formed(text: bytes) -> bool:
    try:
        text.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def pieces_of(text: bytes, giant: int) -> list[bytes]:
    """A text in pieces of about ``giant`` bytes, cut before an ASCII blank or line end that follows another visible ASCII character.

    A word always ends there, whatever is around, so the pieces' counts add up. A stretch without such a place stays whole.
    """
    out, a = [], 0
    cut = re.compile(rb"[!-~](?=[ \n\t\r])")
    while len(text) - a > giant:
        m = cut.search(text, a + giant)
        if not m:
            break
        out.append(text[a:m.end()])
        a = m.end()
    return [*out, text[a:]]


def count_tokens(docs: DataFrame, path: str = MODEL, limit: int = 1024, doc_col: str = "doc_id", text_col: str = "text", giant: int = 4 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every text, as the library of the tokenizer file counts them: no tokens added, none cut.

    The strings of special tokens inside a text are one token each, the library's default. Null texts count as empty: no
    bytes, no tokens. Bytes that aren't UTF-8 count as U+FFFD (``n_bytes`` tells the text's own). Repeated rows and rows
    without an id are each counted; an empty table gives no rows. ``limit`` tells which texts have more tokens.

    One pass, no shuffle. A text longer than ``giant`` bytes is read in pieces cut at forced word ends, one after the
    other, so memory is bounded but for a stretch without any such place. ValueError for files that are no plain byte-level BPE.
    """
    wide_rows(docs)
    task = _counter(WordMachine(), ByteMachine(path), giant)
    texts = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(task, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
