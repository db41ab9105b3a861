import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from postmill.functions import dates, udfs, web
from postmill.functions import text as T


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(("given", "want"), [("  Ab-C  d!", "ab c d"), (None, ""), ("éa", "a"), ("", "")])
def test_norm(spark, given, want):
    assert one(spark, T.norm(F.lit(given).cast("string"))) == want


def test_key_ignores_word_order_and_legal_forms(spark):
    a = one(spark, T.canonical_key(F.lit("Acme Ltd"), F.lit("Broker - FX Options")))
    b = one(spark, T.canonical_key(F.lit("The ACME Group"), F.lit("FX Options Broker")))
    c = one(spark, T.canonical_key(F.lit("Acme"), F.lit("FX Rates Broker")))
    assert a == b != c and len(a) == 16


def test_salary(spark):
    r = one(spark, T.salary_band(F.lit("£45,000 to £60,000, ref 1234")))
    assert (r.lo, r.hi, r.currency) == (45000.0, 60000.0, "GBP")
    assert one(spark, T.salary_band(F.lit("good money"))).lo is None


def test_graded_requirement_reads_sentences(spark):
    long = " filler text goes here." * 30
    grade = lambda s: one(spark, T.graded_requirement(F.lit(s + long), r"(?i)\bphd\b", r"(?i)preferred|a plus"))
    assert grade("A PhD is preferred. Experience is needed.") == "preferred"
    assert grade("PhD preferred. A PhD in maths is required.") == "required"
    assert grade("No degree.") is None
    assert one(spark, T.graded_requirement(F.lit("PhD needed."), r"(?i)\bphd\b", "plus")) is None


def test_fingerprint_needs_text(spark):
    body = "Some words, repeated often enough. " * 20
    assert one(spark, T.fingerprint(F.lit(body))) == one(spark, T.fingerprint(F.lit(body.upper().replace(",", " ;"))))
    assert one(spark, T.fingerprint(F.lit("short"))) is None


def test_excerpts(spark):
    text = "Home Menu. About the role: You run the desk. You report daily. Requirements: numerate, calm. Benefits: lunch."
    s = one(spark, T.summary(F.lit(text + " " * 5), r"(?i)about the role\b[: -]*", r"(?i)requirements?\s*:\s*", r"(?i)\bbenefits\b"))
    assert s.startswith("You run the desk.")
    r = one(spark, T.stated_requirements(F.lit(text), r"(?i)requirements?\s*:\s*", r"(?i)\bprivacy\b", "x"))
    assert r.startswith("numerate, calm.")


def test_clean_title(spark):
    got = one(spark, T.clean_title(F.lit("Power Trader - Acme Energy London Apply now"), F.lit("Acme Energy"), "apply now|read more"))
    assert got == "Power Trader"


def test_udfs(spark):
    rows = spark.createDataFrame([("we have 30 years of experience",), ("3-5 years of experience; 7+ years experience",), (None,)], "t string")
    assert [r.y for r in rows.select(udfs.years_required("t").alias("y")).collect()] == [None, 3, None]
    c = spark.createDataFrame([("<b>Caf&eacute;</b>​ ﬁne  x",), (None,)], "t string").select(udfs.clean_text("t").alias("c"), udfs.deaccent("t").alias("d")).collect()
    assert c[0].c == "Café fine x" and c[1].c == ""


def test_python_reads_few_texts_in_narrow_batches(spark):
    bits = ["5 years", "3-4 YEARS' ", "1 yeaR ", "2 yrs ", "we have 30 years ", "of experience", " track record", ". ", "year", "٣ years ", "exp", "\n"]
    rnd = random.Random(5)
    rows = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 7))) for _ in range(400)] + [None, ""]
    found = spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", udfs.years_required("t").alias("y"))
    assert {r.i: r.y for r in found.collect()} == {i: udfs.years_of(t) for i, t in enumerate(rows)}
    assert "CASE WHEN RLIKE(t" in found._jdf.queryExecution().optimizedPlan().toString()  # other texts stay in the JVM
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    for name in ("years_required", "clean_text_nfkc", "deaccented_titles"):
        spark.conf.set(key, "10000")
        __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(key)) <= 2000, name
    spark.conf.set(key, before)


def test_mostly_latin(spark):
    assert one(spark, T.mostly_latin(F.lit("abc где"))) is True
    assert one(spark, T.mostly_latin(F.lit("a где это"))) is False
    assert one(spark, T.mostly_latin(F.lit("123"))) is True


def test_days(spark):
    now = F.lit("2024-01-31 12:00:00")
    since = lambda s: one(spark, dates.days_since(F.lit(s).cast("string"), now))
    assert since("2024-01-30") == 1 and since("30/01/2024") == 1 and since("2024-01-31T11:00:00Z") == 0
    assert since("2024-02-01") == -1 and since("1700000000000") is None and since("2024") is None and since(None) is None


def test_web(spark):
    page = '<a class=x href="/jobs">All <b>jobs</b></a><a href="https://e.example/c">C</a>'
    got = one(spark, web.anchors(F.lit(page)))
    assert [(a.href, a.label) for a in got] == [("/jobs", "All jobs"), ("https://e.example/c", "C")]
    assert one(spark, web.absolute(F.lit("/a"), F.lit("https://h.example/b/c"))) == "https://h.example/a"
    assert one(spark, web.absolute(F.lit("join our team today"), F.lit("https://h.example"))) == ""
    assert one(spark, web.host(F.lit("https://H.example:8/x"))) == "h.example:8"
    assert "https://careers.e.example" in one(spark, web.candidate_urls(F.lit("www.e.example")))
    assert one(spark, web.json_body(F.lit(200), F.lit("text/html"), F.lit("<p>"))) is None


def test_retry_delay(spark):
    d = lambda *a: one(spark, dates.retry_delay(*[F.lit(x) for x in a]))
    assert d(20, 500, None) == 30.0 and d(1, 429, "500") == 120.0 and round(d(1, 429, None), 3) == 3.6


def test_stated_salary(spark):
    rows = [(None, None, "", "£40,000 - £50,000"), (30000.0, None, "", "£90,000"), (30000.0, 60000.0, "EUR", ""), (0.0, 0.0, "", "£70,000"), (None, None, "USD", "from 80000"), (None, None, None, None), (None, None, "USD", "£45,000")]
    df = spark.createDataFrame(rows, "lo double, hi double, cur string, said string").select(T.stated_salary("lo", "hi", "cur", "said").alias("b"))
    assert [tuple(r.b) for r in df.collect()] == [(40000, 50000, "GBP"), (30000, None, "GBP"), (30000, 60000, "EUR"), (None, None, ""), (80000, 80000, "USD"), (None, None, ""), (45000, 45000, "GBP")]
