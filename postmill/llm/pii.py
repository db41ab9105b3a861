"""Personal data in plain and in disguised form, with offsets into the source text."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import text_slices, wide_rows

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A start inside a run of digits can match only where the run's first digit can, so those starts are left out.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_SPELLED = re.compile(r"(?<![0-9])[0-9]{8,15}(?![0-9])")

#: Letters of other scripts that look like Latin ones, and their Latin twins.
LOOKALIKE = str.maketrans(
    "абвеікмнорстухјѕԁԛԝһАВЕІКМНОРСТУХЈЅ" "αεικνορτυχΑΒΕΗΙΚΜΝΟΡΤΥΧΖ" "․。﹒＠﹫",
    "a6beikmhopctyxjsdqwhABEIKMHOPCTYXJS" "aeikvoptuxABEHIKMNOPTYXZ" "...@@",
)
LOOKALIKE |= {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}  # full-width forms
LOOKALIKE |= {z + d: 48 + d for z in (0x0660, 0x06F0, 0x0966, 0x09E6) for d in range(10)}  # digits of other scripts
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_NUMBER = "(?:" + "|".join(SPELLED) + ")"
_DOTS = "(?:dot|punto|punkt|point)"
_BRACKETED = rf"[\[({{<]\s*%s\s*[\])}}>]"
_DOT = rf"(?:\s+dot\s+|\s*{_BRACKETED % _DOTS}\s*)"
#: After a bare at, words that end no host (none is a top-level domain), and the prose in which an article's own dot meets one that could.
_NO_ENDING = r"(?:the|and|or|of|on|off|up|if|an|we|he|she|they|that|which|who|with|from|for|was|were|has|had|have|will|would|can|could|then|than|when|where|into|onto|over|under|above|below|between|near)\b"
_PROSE = r"(?:the|an?|this|that|each|every)\s+dot\s+(?:in|is|to|so|no|me|be|by|my|do|am|as)\b"
_HOST = rf"[A-Za-z0-9-]+(?:(?:\.|{_DOT})[A-Za-z0-9-]+)*(?:\.|{_DOT})(?!{_NO_ENDING})[A-Za-z]{{2}}"
#: Before a bare at and a host with plain dots, words that make it prose: 'see it at mail.com' gives a place, not an address.
_PLACE = frozenset(
    "a an the is are was were be been it its he she we they you me us him her them this that these those here there now not or and but only also just even more most all any "
    "look looks looking see seen find found live lives hosted available visit online published posted read reads written works working worked staff team people site sites "
    "website page pages blog news home shop store product products service services details information info example version documentation docs code files file error "
    "line arrive arrives arrived meet aimed start starts started stay stays stop stops buy sold try stand stands point points register registered order orders registration".split()
)
# No alternative begins with an open run of blanks: the blanks before a token are walked once, when it is found.
_TOKEN = re.compile(
    rf"(?P<gone>[​-‍⁠﻿­]+)"
    rf"|(?P<num>(?<![A-Za-z])(?:plus[ -]+)?{_NUMBER}(?:[ ,-]{{1,2}}{_NUMBER}){{6,}}(?![A-Za-z]))"
    rf"|(?P<at>{_BRACKETED % 'at'}\s*)"
    rf"|(?P<dot>{_BRACKETED % _DOTS}\s*)"
    rf"|(?P<pair>(?<=\s)at\s+(?!{_PROSE})(?={_HOST}))"
    rf"|(?P<word>(?<=\s)dot\s+(?=[A-Za-z0-9_-]))",
    re.IGNORECASE,
)
_PLAIN_HOST = re.compile(r"(?!www\.)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", re.IGNORECASE)
_NUMBER_WORD = re.compile(_NUMBER, re.IGNORECASE)
#: What any find needs somewhere in the text; RE2 reads it in one pass over the batch. Each lets more through than the scanner behind it takes.
_PLAIN = r"@|\+[0-9]|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9](?:[ -]?[0-9]){15}"
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"  # what Python's \s takes
_DISGUISED = (
    r"[\x{00ad}\x{200b}-\x{200d}\x{2060}\x{feff}\x{0370}-\x{052f}\x{0660}-\x{0669}\x{06f0}-\x{06f9}\x{0966}-\x{096f}\x{09e6}-\x{09ef}\x{ff01}-\x{ff5e}\x{2024}\x{3002}\x{fe52}\x{fe6b}]"
    + rf"|(?i:[\[({{<]{_BLANK}*at{_BLANK}*[\])}}>]|(?:{_BLANK}|[\[({{<]){_DOTS}(?:{_BLANK}|[\])}}>])|{_BLANK}at{_BLANK}+[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{{2}}|"
    + _NUMBER + r"(?:[ ,-]{1,2}" + _NUMBER + r"){6})"
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """Every kind's leftmost non-overlapping matches that pass its check, by kind, then start."""
    out = []
    last, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > last and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            last = m.end()
            out.append(("email", s, last))
        at = text.find("@", last if m else at + 1)
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


def normalise(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The plain form of a disguised text, and each of its characters' source start and end.

    Homoglyphs map one to one; invisible characters vanish; spelled numbers of seven or more digits become
    digits; at/dot disguises become their sign and swallow the blanks around them. A bare at counts before a host
    with spelled or plain dots; where all its dots are plain, not after a word of ``_PLACE`` nor before ``www.``.
    """
    flat = text.translate(LOOKALIKE)
    parts, starts, ends, pos = [], [], [], 0

    def keep(a: int, b: int) -> None:
        if b > a:
            parts.append(flat[a:b])
            starts.append(np.arange(a, b))
            ends.append(np.arange(a + 1, b + 1))

    for m in _TOKEN.finditer(flat):
        kind, start = m.lastgroup, m.start()
        if kind in ("at", "dot", "pair", "word"):
            while start > pos and flat[start - 1].isspace():
                start -= 1
            if kind in ("pair", "word"):
                before = flat[start - 1] if start > pos else ""
                if not (before.isascii() and (before.isalnum() or before == "_" or (before == "-" and kind == "word"))):
                    continue
            if kind == "pair" and _is_place(flat, pos, start, m.end()):
                continue
        keep(pos, start)
        pos = m.end()
        if kind == "num":
            if m[0][:4].lower() == "plus":
                parts.append("+")
                starts.append(np.array([start]))
                ends.append(np.array([start + 4]))
            for w in _NUMBER_WORD.finditer(m[0]):
                parts.append(SPELLED[w[0].lower()])
                starts.append(np.array([start + w.start()]))
                ends.append(np.array([start + w.end()]))
        elif kind != "gone":
            parts.append("@" if kind in ("at", "pair") else ".")
            starts.append(np.array([start]))
            ends.append(np.array([m.end()]))
    keep(pos, len(flat))
    none = np.zeros(0, int)
    return "".join(parts), np.concatenate([none, *starts]), np.concatenate([none, *ends])


def _is_place(text: str, floor: int, end: int, host: int) -> bool:
    """Whether a bare at that follows the word before ``end`` names a place: its host has plain dots alone, and the word is prose."""
    m = _PLAIN_HOST.match(text, host)
    if text[host:host + 4].lower() == "www.":
        return True
    if m is None:
        return False
    tail = text[m.end():m.end() + 1]
    last = m[0].rsplit(".", 1)[1]
    if not last.isalpha() or (tail.isspace() and re.match(r"\s+dot\s", text[m.end():m.end() + 16], re.IGNORECASE)):
        return False  # a spelled dot goes on from here
    start = end
    while start > floor and text[start - 1] in _LOCAL and end - start < 32:
        start -= 1
    return text[start:end].lower() in _PLACE


def _covered(spans: tuple[list[int], list[int]], a: int, b: int) -> bool:
    """Whether one of some disjoint spans (starts, ends) holds a to b."""
    k = bisect_right(spans[0], a) - 1
    return k >= 0 and spans[1][k] >= b


def disguised_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """What only the normalised text shows, as source spans that no plain span of their kind covers wholly.

    A spelled number without a plus counts as a phone number if it has 8 to 15 digits and is no card.
    """
    norm, starts, ends = normalise(text)
    if norm == text:
        return []
    held: dict[str, tuple[list[int], list[int]]] = {k: ([], []) for k in KINDS}
    for k, s, e in base:
        held[k][0].append(s)
        held[k][1].append(e)
    out: list[tuple[str, int, int]] = []
    for kind, s, e in plain_spans(norm):
        a, b = int(starts[s]), int(ends[e - 1])
        if text[a:b] != norm[s:e] and not _covered(held[kind], a, b):
            out.append((kind, a, b))
    phones = [(s, e) for k, s, e in out if k == "phone"]
    own = [s for s, _ in phones], [e for _, e in phones]
    for m in _SPELLED.finditer(norm):
        a, b = int(starts[m.start()]), int(ends[m.end() - 1])
        # each digit was a word
        if b - a >= 3 * (m.end() - m.start()) and not _covered(held["phone"], a, b) and not _covered(own, a, b):
            out.append(("phone", a, b))
    return out


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every document; spans are in code points, end exclusive, by kind as listed, then start.

    ``base`` marks what the plain patterns find; the others come from the normalised text. A null text counts as
    empty, an empty one has no spans; repeated rows are answered each; an empty table gives no rows; other columns
    are ignored. Texts are read whole, in time linear in their length; no row depends on another, so nothing is
    shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = {k: i for i, k in enumerate(KINDS)}
        kind_type = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
        for whole in batches:
            for batch in text_slices(whole):
                texts = pc.fill_null(batch.column("text"), "")
                plain = pc.match_substring_regex(texts, _PLAIN).to_numpy(zero_copy_only=False)
                odd = pc.match_substring_regex(texts, _DISGUISED).to_numpy(zero_copy_only=False)
                spans: list[list[dict]] = [[]] * batch.num_rows
                for i in np.flatnonzero(plain | odd).tolist():
                    t = texts[i].as_py()
                    base = plain_spans(t) if plain[i] else []
                    more = disguised_spans(t, base) if odd[i] else []
                    every = sorted([(rank[k], s, e, True) for k, s, e in base] + [(rank[k], s, e, False) for k, s, e in more])
                    spans[i] = [{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in every]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, pa.list_(kind_type))], ["id", "spans"])

    wide_rows(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, spans {SPANS}").withColumnRenamed("id", id_col)


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda x: x == F.lit(kind)


def span_digest(found: DataFrame, kinds: tuple[str, ...], id_col: str = "doc_id") -> DataFrame:
    """Counts of the base spans by kind, a digest of them, and the list of all spans."""
    base = F.filter("spans", lambda s: s["base"])
    kind_of = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(kind_of, _is(k))).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select(
        id_col, *counts, F.sha2(span_list(base).cast("binary"), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans")
    )
