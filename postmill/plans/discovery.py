"""Queries of the discovery operators: tokens over the parts' names, the rest over literal answers that no table holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import fixed
from postmill.operators import discovery, health
from postmill.plans.registry import query
from postmill.sources.tables import table

_GENERIC = str(list(fixed.GENERIC_FIRST))
_BOARDS = ", ".join(f"({i}, '{p}', '{u}')" for i, (p, u) in enumerate(fixed.BOARD_ENDPOINTS.items()))
_TRIALS = f"""WITH f AS (SELECT DISTINCT p_name AS name, p_name || '.' || lower(replace(p_brand, '#', '')) AS domain FROM part UNION ALL SELECT 'Northgate Power', 'ngp-uk.example'),
    w AS (SELECT *, string_split(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' ') AS ws FROM f),
    s AS (SELECT ws[1] AS first FROM w GROUP BY ws[1] HAVING count(*) > 1),
    g AS (SELECT name, domain, list_filter([split_part(domain, '.', 1), array_to_string(ws, ''), array_to_string(ws, '-'), CASE WHEN NOT list_contains({_GENERIC}, ws[1]) AND ws[1] NOT IN (SELECT first FROM s) THEN ws[1] END], lambda x: len(x) > 2) AS l FROM w),
    u AS (SELECT name, domain, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM g),
    t AS (SELECT name, domain, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS t FROM u),
    b AS (SELECT * FROM (VALUES {_BOARDS}) AS v(p, provider, template))
    SELECT name, domain, t * {len(fixed.BOARD_ENDPOINTS)} + p AS ord, provider, token, replace(template, '{{t}}', token) AS url FROM t, b"""


@query(_TRIALS)
def board_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every guess at a board for every name among the parts, and one name of its own."""
    parts = table(spark, sf_dir, "part")
    firms = parts.select(F.col("p_name").alias("name"), F.concat("p_name", F.lit("."), F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))).alias("domain")).distinct()
    firms = firms.unionByName(spark.createDataFrame([("Northgate Power", "ngp-uk.example")], "name string, domain string"))
    return discovery.board_trials(firms.withColumn("category", F.col("domain"))).select("name", F.col("category").alias("domain"), "ord", "provider", "token", "url")


@query("""SELECT * FROM (VALUES ('Acme Gas', 'major', 'lever', 'acme', 'https://api.lever.co/v0/postings/acme?mode=json', 2), ('Borealis', 'fund', 'personio', 'borealis', 'https://borealis.jobs.personio.com/xml', 1),
    ('Global Ore', 'bank', 'rippling', 'global-ore', 'https://api.rippling.com/platform/api/ats/v1/board/global-ore/jobs', 1), ('Cobalt Rock', 'fund', 'smartrecruiters', 'cobaltrock', 'https://api.smartrecruiters.com/v1/companies/cobaltrock/postings?limit=100', 7)) AS v(name, category, ats, token, url, n_jobs)""")
def boards_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first board that answers each firm with vacancies: empty boards, errors and other shapes are passed over."""
    firms = [("Acme Gas", "major", "acme.example"), ("Borealis", "fund", ""), ("Global Ore", "bank", "go.example"), ("Cobalt Rock", "fund", "x.example"), ("Cobalt Sky", "fund", ""), ("Nobody", "fund", "")]
    answers = [
        ("https://boards-api.greenhouse.io/v1/boards/acme/jobs?content=false", 200, '{"jobs": []}'), ("https://api.lever.co/v0/postings/acme?mode=json", 200, '[{"text": "a"}, {"text": "b"}]'),
        ("https://api.ashbyhq.com/posting-api/job-board/acme", 200, '{"jobs": [1, 2, 3]}'), ("https://borealis.recruitee.com/api/offers/", 404, '{"offers": [1]}'), ("https://borealis.teamtailor.com/jobs.rss", 200, "<rss></rss>"),
        ("https://borealis.jobs.personio.com/xml", 200, "<x><position><id>1</id></position></x>"), ("https://borealis.breezy.hr/json", 200, "[1]"), ("https://api.lever.co/v0/postings/global?mode=json", 200, "[1]"),
        ("https://api.lever.co/v0/postings/globalore?mode=json", 200, "<html>"), ("https://api.rippling.com/platform/api/ats/v1/board/global-ore/jobs", 200, '{"count": 1, "results": [{"name": "x"}]}'),
        ("https://api.lever.co/v0/postings/cobalt?mode=json", 200, "[1]"), ("https://api.smartrecruiters.com/v1/companies/cobaltrock/postings?limit=100", 200, '{"totalFound": 7, "content": []}'),
    ]
    trials = discovery.board_trials(spark.createDataFrame(firms, "name string, category string, domain string"))
    return discovery.boards_found(trials, spark.createDataFrame(answers, "url string, status int, body string"))


@query("""SELECT * FROM (VALUES ('A', 'lever', 'acme', 'https://api.lever.co/v0/postings/acme?mode=json'), ('C', 'oracle', '', 'https://c.example/api'), ('E', 'eightfold', 'e', 'https://e.eightfold.ai/api/apply/v2/jobs?start=0&num=100'),
    ('H', 'ashby', 'h', 'https://h.example/own')) AS v(name, ats, token, url)""")
def boards_to_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards of both discoveries: what a page said wins over a guess; unknown boards and missing parts are left out."""
    sniffed = [(1, "A", "lever", "acme", ""), (2, "B", "workday", "b", "https://b.example"), (3, "C", "oracle", "", "https://c.example/api"), (4, "D", "oracle", "d", ""), (5, "E", " eightfold", "e ", None), (6, "F", "lever", "", "")]
    guessed = [(1, "G", "lever", "ACME", "https://guess.example"), (2, "H", "ashby", "h", "https://h.example/own"), (3, "I", "ashby", "H", "https://i.example")]
    return discovery.boards_to_read(spark.createDataFrame(sniffed, "seq int, name string, ats string, token string, board_url string"), spark.createDataFrame(guessed, "seq int, name string, ats string, token string, url string"))


@query("""SELECT * FROM (VALUES ('a', 1, 'https://a.example/', 'guessed'), ('a', 3, 'https://a.example/jobs', 'guessed'), ('a', 5, 'https://careers.a.example/', 'guessed'), ('a', 1000001, 'https://a.example/join', 'followed'),
    ('a', 2000002, 'https://a.example/deep/grads', 'followed'), ('b', 1, 'https://b.example/', 'guessed')) AS v(firm, ord, url, kind)""")
def pages_walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk with its careers links: refused and silent hosts end, links off the site and those that failed are left out."""
    home = '<a href="/about">About</a><a href="/join#top">Join us</a> <a href="/join/">Careers</a><a href="https://other.example/jobs">Jobs</a><a href="/life"><b>Life at</b> A</a>'
    rows = [
        ("a", 1, "https://a.example/", 200, home, True), ("a", 2, "https://a.example/careers", 404, "", True), ("a", 3, "https://a.example/jobs", 200, '<a href="/join">Join our team</a><a href="deep/grads">Graduate scheme</a>', True),
        ("a", 4, "https://www.a.example/", None, "", True), ("a", 5, "https://careers.a.example/", 200, '<a href="/third">jobs</a>', True), ("a", 6, "https://www.a.example/jobs", 200, "", True),
        ("a", 0, "https://a.example/join", 200, "", False), ("a", 0, "https://a.example/life", 500, "", False), ("a", 0, "https://a.example/deep/grads", 200, "", False), ("a", 0, "https://careers.a.example/third", 200, "", False),
        ("b", 1, "https://b.example/", 200, None, True), ("b", 2, "https://b.example/careers", 429, "", True), ("b", 3, "https://b.example/jobs", 200, "", True), ("c", 1, "https://c.example/", None, None, True),
    ]
    log = spark.createDataFrame(rows, "firm string, ord int, url string, status int, html string, guessed boolean")
    return discovery.pages_walked(log.withColumn("final_url", F.col("url")))


@query("""SELECT * FROM (VALUES ('Northgate Power', 'power_gas', '35110', '2010', 'EC2A 1AA'), ('O''Neil Fund Management', 'fund', '66300', '2005', 'n1 9gu'), ('Harbour', 'trading_house', '46120', '', 'M1 1AA'),
    ('Twin', 'major', '06200', '2011', 'SW1A 1AA')) AS v(name, category, sic, incorporated, postcode)""")
def register_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies of a literal register: by place, name, year and codes, each name once, without those of the registry."""
    rows = [
        (1, "NORTHGATE POWER LIMITED", ["99999", "35140", "35110"], "Leeds", "EC2A 1AA", "2010-03-01"), (2, "O'NEIL FUND MANAGEMENT LLP", ["66300"], "", " n1 9gu", "2005-01-01"), (3, "HARBOUR GROUP", ["46120"], "Greater London", "M1 1AA", None),
        (4, "OLD OIL PLC", ["06100"], "London", "", "1999-01-01"), (5, "SILK BIDCO LIMITED", ["64205"], "London", "", "2015-01-01"), (6, "EXETER GAS LTD", ["06200"], "Exeter", "EX1 1AA", "2015-01-01"), (7, "TWIN LIMITED", ["64191"], "London", "E1 1AA", "2010-01-01"),
        (8, "TWIN UK", ["06200"], None, "SW1A 1AA", "2011-01-01"), (9, "KNOWN LIMITED", ["64191"], "London", "", "2015-01-01"), (10, "CAKE SHOP LTD", ["56101"], "London", "", "2015-01-01"), (11, "RIDGE VII LIMITED", ["64191"], "London", "", "2015-01-01"),
    ]
    companies = spark.createDataFrame(rows, "seq int, name string, sic_codes array<string>, locality string, postcode string, incorporated string")
    return discovery.register_screen(companies, spark.createDataFrame([("Known plc",)], "name string"))


@query("""SELECT * FROM (VALUES (1, 'ok', 'no domain claimed'), (2, 'unreachable', 'no response'), (3, 'blocked', 'http 409 — bot protection, domain probably fine'), (4, 'unreachable', 'http 404'), (5, 'ok', 'page names northgate'),
    (6, 'ok', 'page names redwheel'), (7, 'moved', 'redirects to buyer.example'), (8, 'blocked', 'bot challenge at geo.perfdrive.com'), (9, 'mismatch', 'parked or for-sale page'), (10, 'thin', 'reachable, page says little'),
    (11, 'mismatch', 'page does not name the firm: quiet harbour bakery, fresh bread and cakes every day in pen'), (12, 'thin', 'page is not in Latin script — cannot match the name: ' || repeat('中国工商银行', 6) || '中国工商'), (13, 'ok', 'page names cez')) AS v(seq, verdict, detail)""")
def firm_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every verdict on a firm's page, by literal pages."""
    titled = lambda t: f"<html><title>{t}</title></html>"
    rows = [
        (1, "Northgate", " ", None, None, None), (2, "Northgate", "n1.example", None, None, None), (3, "Northgate", "n2.example", 409, "https://n2.example/", ""), (4, "Northgate", "n3.example", 404, "https://n3.example/", ""),
        (5, "Northgate Trading Ltd", "n.example", 200, "https://www.n.example/", titled("Northgate &amp; Sons")), (6, "Redwheel", "rw.example", 200, "https://rw.example/", titled("Red Wheel asset managers")),
        (7, "Oldco Mining", "om.example", 200, "https://www.buyer.example/", titled("Buyer plc, a large and diverse producer of things")), (8, "Oldco Mining", "om.example", 200, "https://geo.perfdrive.com/x", titled("One moment")),
        (9, "Oldco Mining", "om.example", 200, "https://om.example/", titled("This domain is for sale")), (10, "Oldco Mining", "om.example", 200, "https://om.example/", titled("Welcome")),
        (11, "Oldco Mining", "om.example", 200, "https://om.example/", titled("Quiet Harbour Bakery, fresh bread and cakes every day in Penzance")), (12, "Oldco Mining", "om.example", 200, "https://om.example/", titled("中国工商银行" * 9)),
        (13, "Čez", "skupina.example", 200, "https://skupina.example/", titled("ČEZ, a.s.")),
    ]
    firms = spark.createDataFrame(rows, "seq int, name string, domain string, status int, final_url string, html string")
    return discovery.firm_checked(firms).select("seq", "verdict", "detail")


@query("""WITH l AS (SELECT page_id % 11 <> 0 AS fetched, CASE WHEN contains(html, '<table') THEN ['table'] ELSE [] END AS labels FROM pages),
    f AS (SELECT unnest(CASE WHEN len(labels) > 0 THEN labels WHEN fetched THEN ['no fingerprint'] ELSE ['never fetched'] END) AS label FROM l)
    SELECT label, count(*) AS n, round(100 * count(*) / greatest((SELECT count(*) FROM pages), 1), 4) AS share FROM f GROUP BY label""")
def tally_of_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of pages, with those read without a finding told from those never read (every eleventh)."""
    labels = F.filter(F.array(F.when(F.contains("html", F.lit("<table")), "table")), lambda x: x.isNotNull())
    return health.label_tally(table(spark, sf_dir, "pages").withColumn("labels", labels), "labels", F.col("page_id") % 11 != 0)


@query("""SELECT site AS target, CASE WHEN own > 0 THEN 'works' WHEN total - own = 0 THEN 'inconclusive' ELSE 'blocked' END AS verdict FROM (
    SELECT 'click' AS site, count(*) FILTER (WHERE event_type = 'click') AS own, count(*) AS total FROM events UNION ALL SELECT 'carrier pigeon', 0, count(*) FROM events)""")
def block_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one source is blocked here, told from the others' counts."""
    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("site")).agg(F.count("*").alias("n"))
    of = lambda t: discovery.block_diagnosis(counts, t).select(F.lit(t).alias("target"), "verdict")
    return of("click").unionByName(of("carrier pigeon"))
