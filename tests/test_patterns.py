"""Rule files' patterns: what they require, what they mean to Java, which are unsafe; and the automaton over them."""

import random
import re
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from postmill.functions import fixed, patterns
from postmill.operators import score
from postmill.operators.rules import RuleMatcher, rule_join
from postmill.sources import settings

RULES = [
    r"\bjunior\b", r"entry.?level", r"(?:power|gas)\s+(?:trader|analyst)", r"analyst i\b", r"head of\b(?! desk)", r"ph\.?\s?d", r"[a-z]{14}", r"c\+\+", r"^trad", r"desk$", r"\d+\s*years?", r"quant\w*", r"(?<!non-)graduate",
    r"(a|b)\1c", r"[^\W\d_]{3}x", r"größe", r"so?ftware", r"k", "[0-9]{4}", r"x|yy|zzz", r"(?i:Lead)", fixed.YEARS, fixed.PHD, fixed.PHD_SOFT, *fixed.JUNIOR_MARKERS, *fixed.JUNIOR_TITLES, *fixed.RANK_WORDS,
]
BITS = ["junior", "Entry-Level", "power  trader", "GAS\tANALYST", "analyst i", "analyst ii", "head of", "head of desk", "Ph. D", "PhD", "C++", "tradé", "desk", "desk\n", "\ndesk", "10+ years", "٣ years", "quantität", "non-graduate", "graduate", "aac", "abc",
        "Größe", "GRÖSSE", "ſoftware", "Kelvin", "1234", "yy", "lead", "_lead_", "5 plus years of experience", "a plus", "ideally", "staff", "é", " ", " ", ".", "-", "abcdefghijklmnop"]


def texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(BITS) + rnd.choice(["", " ", "\n"]) for _ in range(rnd.randint(0, 6))) for _ in range(n)]


def test_java_means_what_python_does(spark):
    rows = texts(400)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = df.select("i", *[F.rlike("t", F.lit(patterns.java(p))).alias(f"r{k}") for k, p in enumerate(RULES)]).orderBy("i").collect()
    for k, p in enumerate(RULES):
        assert [r[f"r{k}"] for r in got] == [bool(re.search(p, t, re.I)) for t in rows], p


def test_required_strings():
    assert patterns.required(r"\bjunior\b") == {"junior"}
    assert patterns.required(r"(?:power|gas)\s+trader") == {"trader"}
    assert patterns.required(r"power|gas") == {"power", "gas"}
    assert patterns.required(r"(?:very )?old") == {"old"}
    assert patterns.required(r"[0-9]{4}") is None and patterns.required(r"x?") is None and patterns.required(r"a|[0-9]") is None
    assert patterns.required(r"(?:ab){2}c") in ({"ab"}, {"abc"})
    for p in RULES:  # no match without one of them
        need = patterns.required(p)
        for t in texts(300, 2):
            if need and re.search(p, t, re.I):
                assert any(s in t.lower().replace("ſ", "s") for s in need), (p, t)


def test_unsafe_patterns_are_named():
    for p in (r"(a+)+b", r"(\w*\s*)*x", r"(?:\w+)*y", r"\w+\d+x", r"\s+\s*x", r"a.*.*b"):
        assert patterns.ambiguous(p), p
    for p in (r"a+b", r"\w+\s+\d", r"(?:x[a-z]{2})+", r"(?:power|gas)\s+trader", *fixed.JUNIOR_MARKERS, fixed.PHD):
        assert patterns.ambiguous(p) is None, p
    assert patterns.problems("(") and patterns.problems("x?") == ["matches everything"] and patterns.problems(r"(?P<a>x)(?(a)y|z)")[0].startswith("has no counterpart")
    assert settings.pattern_problems({"include": ["fine", "("], "tiers": {"core": {"points": 3, "patterns": [r"(a+)+b"]}}}) == [
        f"include: '(' {patterns.problems('(')[0]}", f"tiers.core.patterns: '(a+)+b' {patterns.problems('(a+)+b')[0]}"]


def test_matcher_equals_plain_search(spark):
    rows = texts(500, 3) + [None, ""]
    matcher = RuleMatcher(RULES)
    want = [[i for i, p in enumerate(RULES) if re.search(p, t or "", re.I)] for t in rows]
    assert [matcher.hits(t) for t in rows] == want
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    got = {(r.i, r.label, r.points) for r in rule_join(df, "i", "t", [(f"rule {k}", p, k) for k, p in enumerate(RULES)]).collect()}
    assert got == {(i, f"rule {k}", k) for i, hits in enumerate(want) for k in hits}
    assert rule_join(df, "i", "t", []).count() == 0 and rule_join(df.limit(0), "i", "t", [("a", "x", 1)]).count() == 0
    with pytest.raises(re.error):
        RuleMatcher(["("])


def test_time_hardly_grows_with_the_rules():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(7))
    text = [" ".join(word() for _ in range(300)) for _ in range(60)]
    few, many = (RuleMatcher([rf"\b{word()}\b" for _ in range(n)]) for n in (20, 4000))

    def taken(m):
        m.hits("")
        began = time.perf_counter()
        for t in text:
            m.hits(t)
        return time.perf_counter() - began

    assert taken(many) < 20 * taken(few)  # two hundred times the rules


WHOLE = [r"\bgas\b", r"\bK\b", r"\bsi_k9\b", "(?<![a-z])gas(?![a-z])", "(?<![a-z])kiss(?![a-z])", "(?<![A-Z])Si(?![A-Z])", "(?<![a-z0-9])si9(?![a-z0-9])", "(?<![a-zß-ÿ])gas(?![a-zß-ÿ])", "(?<![t-z])zu(?![t-z])"]
NOT_WHOLE = ["gas", r"\bgas", r"\bgroße\b", "(?<![a-z])si9(?![a-z])", "(?<![a-z])gas(?![a-y])", "(?<![^a-z])gas(?![^a-z])", r"\bgas.\b", r"(?<![\d])1(?![\d])", r"\bgas\B", "(?<![t-z])gas(?![t-z])"]


def test_whole_words_are_looked_up(spark):
    assert all(patterns.whole_run(p) for p in WHOLE) and not any(patterns.whole_run(p) for p in NOT_WHOLE)
    for c in map(chr, [*range(0x3000), *range(0xFB00, 0x10000)]):  # one character stays one, of the same classes
        low = patterns.folded(c)
        assert len(low) == 1 and all(bool(re.match(k, c, re.I)) == bool(re.match(k, low, re.I)) for k in ("[a-z]", r"\w", "[t-z]", "[a-zß-ÿ]")), c
    rnd, bits = random.Random(6), ["gas", "GAS", "K", "\u212a", "kiss", "Kİſs", "kıss", "si", "Sİ", "_k9", "9", "zu", "é", "ÿ", "Σ", "_", "-", " ", " ", "\n", "٣"]
    rows = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 9))) for _ in range(3000)] + [None, "", "gas " * 300_000]
    matcher = RuleMatcher(WHOLE + NOT_WHOLE)
    for t in rows:
        assert matcher.hits(t) == [i for i, p in enumerate(matcher.patterns) if re.search(p, t or "", re.I)], (t or "")[:50]


def test_words_inside_others_cost_no_search():
    words = sorted({a + b + c for a in ("th", "in", "er", "an") for b in ("th", "in", "er", "an", "on", "re") for c in ("", "th", "in", "er", "an", "on", "re", "es", "ed")})
    text = " ".join(a + b for a in words for b in words)
    matcher = RuleMatcher([f"(?<![a-z]){w}(?![a-z])" for w in words])
    assert matcher.hits("") == [] and matcher.hits("x INTH,thin") == [words.index("inth"), words.index("thin")]
    began = time.perf_counter()
    found = matcher.hits(text)
    taken, began = time.perf_counter() - began, time.perf_counter()
    whole = set(re.findall("[a-z]+", text))
    assert found == [i for i, w in enumerate(words) if w in whole] and taken < 5 * (time.perf_counter() - began) + 0.05


def test_scores_of_python_and_java_rubrics_agree(spark):
    rubric = score.Rubric(
        tiers=[("top", 50, ["gas trader", "power"]), ("fair", 10, ["analyst"])], junior=(["junior"], 12, 1), category_roles={"fund": (8, ["desk"])}, signals=[("bad", -40, ["idiot", "a{3}b"]), ("good", 10, ["experience"])],
        categories={"fund": 5}, least_text=10, home=(["london"], 6), away=(["paris"], -6), no_location=-2,
    )
    rows = [("Junior Gas Trader", "much experience needed", "London", "fund"), ("Analyst, desk", "aaab experience", "Paris", "fund"), ("x", "short", "", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "title string, description string, location string, category string")
    a, b = (score.scored(df, r, F.lit("2024-01-31")).select("why", "score").collect() for r in (rubric, replace(rubric, python=True)))
    assert a == b and a[0].score != a[1].score
