"""Rule files' patterns, which are Python's: what they need of a text, what they mean to Java, and which are unsafe.

``re`` parses a pattern; the functions here read its tree.
"""

from __future__ import annotations

import re
from re import _constants as K
from re import _parser as P

_WORD = r"\p{L}\p{N}_"
_CATEGORIES = {
    K.CATEGORY_DIGIT: r"\p{Nd}", K.CATEGORY_NOT_DIGIT: r"\P{Nd}", K.CATEGORY_SPACE: r"\x09-\x0D\x1C-\x20\x85\p{Z}", K.CATEGORY_NOT_SPACE: r"\S",
    K.CATEGORY_WORD: _WORD, K.CATEGORY_NOT_WORD: rf"[^{_WORD}]",
}
_SPACE = r"\x09-\x0D\x1C-\x20\x85\p{Z}"
_REPEATS = {K.MAX_REPEAT: "", K.MIN_REPEAT: "?", K.POSSESSIVE_REPEAT: "+"}


class Untranslatable(ValueError):
    """A construct of Python's patterns that Java lacks."""


def parsed(pattern: str) -> P.SubPattern:
    return P.parse(pattern, re.IGNORECASE)


# -- what every match holds -------------------------------------------------------------------------------------------


def required(pattern: str) -> frozenset[str] | None:
    """Lower-case ASCII strings of which every match of a pattern holds one, or null where no such set is told by its form.

    Of the sets that the parts of a sequence give, the one with the longest shortest string is taken.
    """
    found = _required(parsed(pattern))
    return found if found and all(found) else None


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    if not a or not b:
        return a or b
    worth = lambda s: (min(map(len, s)), -len(s))
    return a if worth(a) >= worth(b) else b


def _required(tree) -> frozenset[str] | None:
    best, run = None, ""
    for op, arg in [*tree, (None, None)]:
        char = None
        if op is K.LITERAL:
            char = chr(arg)
        elif op is K.IN and len(arg) == 1 and arg[0][0] is K.LITERAL:
            char = chr(arg[0][1])
        if char is not None and char.isascii():
            run += char.lower()
            continue
        if op in (K.AT, K.ASSERT_NOT):  # nothing is read: the run goes on
            continue
        if run:
            best, run = _better(best, frozenset([run])), ""
        if op is K.SUBPATTERN:
            best = _better(best, _required(arg[-1]))
        elif op is K.ATOMIC_GROUP:
            best = _better(best, _required(arg))
        elif op is K.BRANCH:
            parts = [_required(b) for b in arg[1]]
            if all(parts):
                best = _better(best, frozenset().union(*parts))
        elif op in _REPEATS and arg[0] >= 1:
            best = _better(best, _required(arg[2]))
    return best


_WHOLE = re.compile(r"\(\?<!(\[[^\[\]\\^]+\])\)([A-Za-z0-9_]+)\(\?!\1\)|\\b([A-Za-z0-9_]+)\\b")


def whole_run(pattern: str) -> tuple[str, str] | None:
    r"""(class, word) of a pattern that takes one word where no character of a class stands beside it, or null for other forms.

    These are ``\bword\b`` and ``(?<![class])word(?![class])`` with a word of ASCII characters of that class: it matches just where the
    word is a run of the class that can't be made longer. The word is in lower case.
    """
    m = _WHOLE.fullmatch(pattern)
    if not m:
        return None
    kind, word = (m[1], m[2]) if m[1] else (r"\w", m[3])
    return (kind, word.lower()) if re.fullmatch(f"{kind}+", word, re.IGNORECASE) else None


def folded(text: str) -> str:
    """Lower case as ignoring case has it: all that it takes for an ASCII letter becomes that letter, one character for each."""
    for a, b in () if text.isascii() else (("İ", "i"), ("ı", "i"), ("ſ", "s")):
        text = text.replace(a, b)
    return text.lower()


# -- what a pattern means to Java -----------------------------------------------------------------------------------------


def java(pattern: str) -> str:
    """A pattern that Java matches where Python does, whatever the case: classes and borders by Unicode, ends of lines as Python has them."""
    return "(?iu)" + _java(parsed(pattern))


def _literal(code: int) -> str:
    c = chr(code)
    return c if c.isalnum() or code > 127 else f"\\x{{{code:x}}}"


def _set(items) -> str:
    """The inside of a character class, negated or not."""
    out, negated = [], False
    for op, arg in items:
        if op is K.NEGATE:
            negated = True
        elif op is K.LITERAL:
            out.append(_literal(arg))
        elif op is K.RANGE:
            out.append(f"{_literal(arg[0])}-{_literal(arg[1])}")
        elif op is K.CATEGORY:
            out.append(f"[^{_SPACE}]" if arg is K.CATEGORY_NOT_SPACE else _CATEGORIES[arg])
        else:
            raise Untranslatable(str(op))
    return f"[{'^' if negated else ''}{''.join(out)}]"


def _java(tree) -> str:
    out = []
    for op, arg in tree:
        if op is K.LITERAL:
            out.append(_literal(arg))
        elif op is K.NOT_LITERAL:
            out.append(f"[^{_literal(arg)}]")
        elif op is K.ANY:
            out.append(r"[^\n]")
        elif op is K.IN:
            out.append(_set(arg))
        elif op is K.BRANCH:
            out.append(f"(?:{'|'.join(_java(b) for b in arg[1])})")
        elif op is K.SUBPATTERN:
            group, add, drop, body = arg
            if (add | drop) & ~(re.IGNORECASE | re.UNICODE):
                raise Untranslatable("flags inside a pattern")
            out.append(f"({'' if group else '?:'}{_java(body)})")
        elif op is K.ATOMIC_GROUP:
            out.append(f"(?>{_java(arg)})")
        elif op in _REPEATS:
            least, most, body = arg
            count = f"{{{least},{'' if most is K.MAXREPEAT else most}}}"
            out.append(f"(?:{_java(body)}){count}{_REPEATS[op]}")
        elif op is K.AT:
            border = rf"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
            places = {K.AT_BEGINNING: r"\A", K.AT_BEGINNING_STRING: r"\A", K.AT_END: r"(?=\n?\z)", K.AT_END_STRING: r"\z", K.AT_BOUNDARY: border, K.AT_NON_BOUNDARY: f"(?!{border})"}
            out.append(places[arg])
        elif op in (K.ASSERT, K.ASSERT_NOT):
            way, body = arg
            out.append(f"(?{'<' if way < 0 else ''}{'=' if op is K.ASSERT else '!'}{_java(body)})")
        elif op is K.GROUPREF:
            out.append(f"(?:\\{arg})")
        else:
            raise Untranslatable(str(op))
    return "".join(out)


# -- what is unsafe -------------------------------------------------------------------------------------------------------

#: ASCII, and a letter, a digit, a space and a sign that stand for all others of their kind.
_SAMPLE = frozenset([*range(128), 0xE9, 0x663, 0xA0, 0x2014])


def _chars(op, arg) -> frozenset | None:
    """The characters of the sample that a single-character element takes; null for other elements."""
    if op is K.LITERAL:
        return frozenset(ord(c) for c in {chr(arg).lower(), chr(arg).upper()} if len(c) == 1)
    if op is K.ANY:
        return _SAMPLE - {10}
    if op in (K.IN, K.NOT_LITERAL):
        compiled = re._compiler.compile(_with_flags(P.SubPattern(P.State(), [(op, arg)])), re.IGNORECASE)
        return frozenset(c for c in _SAMPLE if compiled.fullmatch(chr(c)))
    return None


def _with_flags(tree: P.SubPattern) -> P.SubPattern:
    tree.state.flags = re.IGNORECASE | re.UNICODE
    tree.state.str = ""
    return tree


def _first(tree) -> frozenset:
    """Characters that a match may begin with."""
    out: frozenset = frozenset()
    for op, arg in tree:
        own = _chars(op, arg)
        if own is not None:
            return out | own
        if op is K.SUBPATTERN:
            out |= _first(arg[-1])
            if arg[-1].getwidth()[0]:
                return out
        elif op is K.BRANCH:
            out = out.union(*(_first(b) for b in arg[1]))
            if all(b.getwidth()[0] for b in arg[1]):
                return out
        elif op in _REPEATS:
            out |= _first(arg[2])
            if arg[0] and arg[2].getwidth()[0]:
                return out
    return out


def ambiguous(pattern: str) -> str | None:
    """Why matching may take far longer than the text is long, or null.

    A repeat without a bound inside another one, where one pass of the outer can be read as two; or two such repeats in a row
    that take the same characters.
    """
    return _ambiguous(parsed(pattern))


def _ambiguous(tree) -> str | None:
    loose: frozenset = frozenset()  # characters of an unbounded repeat before which nothing certain was read
    for op, arg in tree:
        if op in _REPEATS and op is not K.POSSESSIVE_REPEAT:
            least, most, body = arg
            inner = _ambiguous(body)
            if inner:
                return inner
            starts = _first(body)
            if most is K.MAXREPEAT:
                if _repeats_alone(body):
                    return "a repeat without a bound inside another"
                if starts & loose:
                    return "two repeats in a row that take the same characters"
                loose = loose | starts
                continue
            if body.getwidth()[0] and least:
                loose = frozenset()
            continue
        if op is K.SUBPATTERN:
            inner = _ambiguous(arg[-1])
        elif op is K.BRANCH:
            inner = next((x for x in map(_ambiguous, arg[1]) if x), None)
        else:
            inner = None
        if inner:
            return inner
        if op not in (K.AT, K.ASSERT, K.ASSERT_NOT):
            own = _chars(op, arg)
            if own is None and (op is K.SUBPATTERN and not arg[-1].getwidth()[0] or op is K.BRANCH and not all(b.getwidth()[0] for b in arg[1])):
                continue
            if own is None or not own <= loose:
                loose = frozenset()
    return None


def _repeats_alone(body) -> bool:
    """Whether a body may be nothing but an unbounded repeat."""
    parts = [(op, arg) for op, arg in body if op not in (K.AT, K.ASSERT, K.ASSERT_NOT)]
    loops = 0
    for op, arg in parts:
        if op in _REPEATS and op is not K.POSSESSIVE_REPEAT:
            if arg[1] is K.MAXREPEAT:
                loops += 1
            elif arg[0] and arg[2].getwidth()[0]:
                return False
        elif op is K.SUBPATTERN:
            if _repeats_alone(arg[-1]):
                loops += 1
            elif arg[-1].getwidth()[0]:
                return False
        elif op is K.BRANCH:
            if any(_repeats_alone(b) for b in arg[1]):
                loops += 1
            elif all(b.getwidth()[0] for b in arg[1]):
                return False
        else:
            return False
    return loops > 0


def problems(pattern: str) -> list[str]:
    """What is wrong with one pattern: it doesn't compile, matches everything, has no counterpart in Java, or may take too long."""
    try:
        if re.search(pattern, "", re.IGNORECASE):
            return ["matches everything"]
        java(pattern)
    except re.error as e:
        return [f"does not compile ({e})"]
    except Untranslatable as e:
        return [f"has no counterpart in Java ({e})"]
    why = ambiguous(pattern)
    return [f"may take very long: {why}"] if why else []
