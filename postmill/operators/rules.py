"""Many rules over texts in one pass: an automaton over the strings that their patterns require, then the few patterns that can match."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from postmill.functions.patterns import folded, required, whole_run
from postmill.session import narrow_batches


class Walk:
    """What tasks do with patterns and the strings that each requires (null: none is known); it builds what it needs there."""

    def __init__(self, patterns: Sequence[str], needs: Sequence[frozenset[str] | None]) -> None:
        self.patterns, self.needs = list(patterns), list(needs)
        self._ready = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_ready": None}

    def _machine(self):
        if self._ready is None:
            import ahocorasick

            machine, rules, always, words = ahocorasick.Automaton(), {}, [], {}
            for i, need in enumerate(self.needs):
                whole = whole_run(self.patterns[i])
                if whole:
                    words.setdefault(whole[0], {}).setdefault(whole[1], []).append(i)
                    continue
                if not need:
                    always.append(i)
                for s in need or ():
                    rules.setdefault(s, []).append(i)
            for s, of in rules.items():
                machine.add_word(s, tuple(of))
            if rules:
                machine.make_automaton()
            self._ready = machine if rules else None, always, [(re.compile(f"{kind}+", re.IGNORECASE), of) for kind, of in words.items()], {}
        return self._ready

    def words(self, text: str) -> set[int]:
        """Rules that are one whole word: the text's words are looked up among them, and nothing is searched for."""
        kinds, out = self._machine()[2], set()
        low = folded(text) if kinds else ""
        for runs, of in kinds:
            # a list of words is fastest, a very long text's takes too much room
            found = set(runs.findall(low)) if len(low) < 1 << 20 else {m[0] for m in runs.finditer(low)}
            for w in of.keys() & found:
                out.update(of[w])
        return out

    def candidates(self, text: str) -> set[int]:
        """Other rules that can match: those of which a required string occurs, and those that require none."""
        machine, always = self._machine()[:2]
        found = set(always)
        if machine is not None:
            for of in {v for _, v in machine.iter(folded(text))}:
                found.update(of)
        return found

    def hits(self, text: str | None) -> list[int]:
        """Indexes of the patterns that match, ascending; a null text is empty."""
        text = text or ""
        out = self.words(text)
        for i in self.candidates(text):
            compiled = self._machine()[3]
            rule = compiled.get(i) or compiled.setdefault(i, re.compile(self.patterns[i], re.IGNORECASE))
            if rule.search(text):
                out.add(i)
        return sorted(out)


class RuleMatcher(Walk):
    """Which of many patterns a text matches, whatever the case.

    Every match of a pattern holds one of the strings that its form requires (``patterns.required``). One automaton finds all of
    these in a single walk over the text, however many rules there are; a regular expression runs only for rules of which such a string
    was found. Patterns that require none always run. Patterns of one whole word (``patterns.whole_run``) take neither: a text's words
    are looked up among theirs.
    """

    def __init__(self, patterns: Sequence[str]) -> None:
        for p in patterns:
            re.compile(p, re.IGNORECASE)
        super().__init__(patterns, [required(p) for p in patterns])

    def column(self, text: Column | str) -> Column:
        """``hits`` of a text column, as an array of indexes: one Arrow-batched function however many rules."""
        own = Walk(self.patterns, self.needs)

        @F.pandas_udf(ArrayType(IntegerType()))
        def matched(s: pd.Series) -> pd.Series:
            return s.map(own.hits)

        return matched(text)


def rule_join(rows: DataFrame, key: str, text: str, rules: Sequence[tuple[str, str, int]]) -> DataFrame:
    """(key, label, points) of every row and rule (label, pattern, points) whose pattern its text matches.

    A theta join without its pairs: rows find their rules in one pass, and only found pairs become rows. The rules are the
    driver's own list; labels and points come to the pairs from it by index.
    """
    if not rules:
        return rows.select(key, F.lit("").alias("label"), F.lit(0).alias("points")).limit(0)
    narrow_batches(rows.sparkSession)
    hits = rows.select(key, F.explode(RuleMatcher([p for _, p, _ in rules]).column(text)).alias("rule"))
    named = rows.sparkSession.createDataFrame([(i, label, points) for i, (label, _, points) in enumerate(rules)], "rule int, label string, points int")
    return hits.join(F.broadcast(named), "rule").select(key, "label", "points")
