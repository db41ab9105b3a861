"""Queries over pages, and over literal payloads for shapes that no table holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.functions import text as T
from postmill.functions import fixed, web
from postmill.operators import dedupe, extract, fold, health
from postmill.plans.registry import query
from postmill.sources import payloads
from postmill.sources.tables import table

_ANCHOR_RE = "(?is)<a\\b[^>]*?href=[\"'']([^\"'']+)[\"''][^>]*>(.*?)</a>"
_ANCHORS = f"""SELECT page_id, url, unnest(regexp_extract_all(html, '{_ANCHOR_RE}', 1)) AS href, unnest(regexp_extract_all(html, '{_ANCHOR_RE}', 2)) AS raw,
    generate_subscripts(regexp_extract_all(html, '{_ANCHOR_RE}', 1), 1) AS pos FROM pages"""
_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1))"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS body FROM pages""")
def strip_html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", T.strip_html("html").alias("body"))


@query(f"SELECT page_id, {_HOST} AS host, lower(regexp_replace(trim(url), '/+$', '')) AS key FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", web.host(F.col("url")).alias("host"), web.url_key(F.col("url")).alias("key"))


@query("""WITH u AS (SELECT page_id, len(html) AS score, CASE WHEN page_id % 10 = 0 THEN '' ELSE regexp_replace(lower(trim(url)), '[0-9]+', '', 'g') END AS k FROM pages),
    r AS (SELECT *, row_number() OVER (PARTITION BY regexp_replace(k, '/+$', '') ORDER BY score DESC, page_id) AS n FROM u)
    SELECT page_id, score FROM r WHERE n = 1 OR k = ''""")
def url_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("page_id") % 10 == 0, "").otherwise(F.regexp_replace(F.lower(F.trim("url")), "[0-9]+", ""))
    rows = pages(spark, sf_dir).select("page_id", F.length("html").alias("score"), url.alias("url"))
    return dedupe.url_collapse(rows, seq="page_id").select("page_id", "score")


@query(f"""WITH a AS ({_ANCHORS}), l AS (SELECT *, trim(regexp_replace(regexp_replace(raw, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS label FROM a),
    k AS (SELECT page_id, href, min(pos) AS pos FROM l WHERE starts_with(href, '/') AND (regexp_matches(href, '(?i)ra|th') OR regexp_matches(label, '(?i)ra|th')) GROUP BY page_id, href),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM k) SELECT page_id, href, n FROM r WHERE n <= 4""")
def careers_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a page that the words pick, in page order, each once, four at most: done inside the row, without a shuffle."""
    keep = lambda a: F.startswith(a["href"], F.lit("/")) & (F.rlike(a["href"], F.lit("(?i)ra|th")) | F.rlike(a["label"], F.lit("(?i)ra|th")))
    picked = F.slice(F.array_distinct(F.transform(F.filter(web.anchors(F.col("html")), keep), lambda a: a["href"])), 1, 4)
    return pages(spark, sf_dir).select("page_id", F.posexplode(picked).alias("n", "href")).select("page_id", "href", (F.col("n") + 1).alias("n"))


_Q = lambda p: p.replace("'", "''")
_LINKED_SQL = _Q(extract.LINKED)
_STRIP = " –—|,·-"
_TAIL_SQL = _Q(rf"(?i)(?:{fixed.TITLE_TAIL}\s*[ –—\-|,·]*)+$")


def _has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '(?i){_Q(pattern)}')"


_LISTING = f"""WITH s AS (SELECT page_id, url, html FROM pages UNION ALL SELECT * FROM (VALUES {extract.LINK_PAGES_SQL}) AS v(page_id, url, html)),
    a AS (SELECT page_id, url AS page, unnest(regexp_extract_all(html, '{_LINKED_SQL}', 1)) AS href, unnest(regexp_extract_all(html, '{_LINKED_SQL}', 2)) AS raw, unnest(regexp_extract_all(html, '{_LINKED_SQL}', 3)) AS after,
        generate_subscripts(regexp_extract_all(html, '{_LINKED_SQL}', 1), 1) AS pos FROM s),
    t AS (SELECT *, trim(regexp_replace(rtrim(trim(regexp_replace(regexp_replace(raw, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '{_STRIP}'), '{_TAIL_SQL}', ''), '{_STRIP}') AS title FROM a),
    k AS (SELECT * FROM t WHERE len(title) BETWEEN 3 AND 140 AND NOT {_has('title', fixed.NOT_A_JOB)} AND NOT {_has('title', fixed.PATH_TITLE)} AND NOT {_has('title', fixed.CLOSED_TITLE)}
        AND (NOT {_has('title', fixed.SCHEME_PAGE)} OR {_has('title', fixed.CONCRETE_ROLE)}) AND NOT {_has('href', fixed.ASSET_HREF)} AND NOT {_has('href', fixed.NOT_A_VACANCY_PATH)}
        AND ({_has('href', fixed.JOB_HREF)} OR ({_has('href', fixed.CAREERS_SLUG)} AND {_has('title', fixed.ROLE_NOUN)}))),
    u AS (SELECT *, CASE WHEN starts_with(href, 'http') THEN href WHEN starts_with(href, '/') THEN regexp_extract(page, '^([a-z]+://[^/?#]+)', 1) || href WHEN NOT contains(href, ' ') AND NOT contains(href, '/') THEN rtrim(page, '/') || '/' || href
        WHEN contains(href, ' ') THEN '' ELSE rtrim(page, '/') || '/' || href END AS url FROM k)
    SELECT page_id, arg_min(title, pos) AS title, url, arg_min(trim(regexp_extract(after, '{_Q(fixed.TRAILING)}', 1)), pos) AS location FROM u WHERE url <> '' GROUP BY page_id, url"""


@query(_LISTING)
def anchor_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vacancies among the links of every page, beside literal pages that hold each kind (ids below zero)."""
    return extract.jobs_from_links(pages(spark, sf_dir).select("page_id", "url", "html").unionByName(extract.link_pages(spark)), "page_id", url="url")


@query(f"""WITH l AS (SELECT page_id, list_filter([CASE WHEN regexp_matches({_HOST}, '[a-h]') THEN 'early' END, CASE WHEN regexp_matches({_HOST}, 'th') THEN 'th' END, CASE WHEN contains(html, '<table') THEN 'table' END], lambda x: x IS NOT NULL) AS labels FROM pages),
    f AS (SELECT unnest(CASE WHEN len(labels) > 0 THEN labels ELSE ['none'] END) AS label FROM l)
    SELECT label, count(*) AS n, round(100 * count(*) / greatest((SELECT count(*) FROM pages), 1), 4) AS share FROM f GROUP BY label""")
def ats_multilabel_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).select("page_id", F.lower(web.host(F.col("url"))).alias("h"), F.contains("html", F.lit("<table")).alias("t"))
    labels = F.filter(F.array(F.when(F.rlike("h", F.lit("[a-h]")), "early"), F.when(F.rlike("h", F.lit("th")), "th"), F.when(F.col("t"), "table")), lambda x: x.isNotNull())
    return health.label_tally(p.withColumn("labels", labels), "labels")


@query("""SELECT page_id, lower(trim(regexp_replace(regexp_replace(concat_ws(' ', regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS title FROM pages""")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return pages(spark, sf_dir).select("page_id", F.lower(T.squeeze(F.regexp_replace(title, "<[^>]+>", " "))).alias("title"))


_IDENTITY = [
    "(?is)<title[^>]*>(.*?)</title>", """(?is)<meta[^>]+property=["\']og:site_name["\'][^>]+content=["\']([^"\']+)""", """(?is)<meta[^>]+name=["\']application-name["\'][^>]+content=["\']([^"\']+)""",
    """(?is)<meta[^>]+name=["\']description["\'][^>]+content=["\']([^"\']+)""", "(?is)<h1[^>]*>(.*?)</h1>", "(?i)((?:©|&copy;|copyright)[^<]{0,80})",
]


@query("SELECT page_id, lower(trim(regexp_replace(regexp_replace(array_to_string(" + " || ".join(f"list_slice(regexp_extract_all(coalesce(html, ''), '{_Q(p)}', 1), 1, 3)" for p in _IDENTITY) + ", ' '), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS identity FROM pages")
def page_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", T.page_identity("html").alias("identity"))


@query(f"""WITH h AS (SELECT DISTINCT {_HOST} AS host FROM pages), u AS (SELECT host, unnest({list(fixed.CAREERS_PATHS)}) AS p FROM h),
    s AS (SELECT host, unnest({list(fixed.CAREERS_HOSTS)}) AS sub FROM h)
    SELECT host, 'https://' || host || p AS candidate FROM u UNION ALL SELECT host, 'https://' || regexp_replace(host, '^www\\.', '') FROM h WHERE starts_with(host, 'www.')
    UNION ALL SELECT host, 'https://' || sub || '.' || regexp_replace(host, '^www\\.', '') FROM s WHERE NOT starts_with(host, sub || '.')""")
def candidate_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = pages(spark, sf_dir).select(web.host(F.col("url")).alias("host")).distinct()
    return hosts.select("host", F.explode(web.candidate_urls(F.col("host"))).alias("candidate"))


_LOG = """SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, page_id % 7 = 0 AS wall FROM pages"""


@query(f"""WITH l AS ({_LOG}), w AS (SELECT *, count(*) FILTER (WHERE wall) OVER (PARTITION BY host ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS walls FROM l) SELECT page_id FROM w WHERE walls = 0""")
def page_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a walker still asks for: those of a host up to and including its first wall."""
    log = pages(spark, sf_dir).select("page_id", web.host(F.col("url")).alias("host"), (F.col("page_id") % 7 == 0).alias("wall"))
    w = Window.partitionBy("host").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("walls", F.coalesce(F.count_if("wall").over(w), F.lit(0))).where("walls = 0").select("page_id")


@query("""SELECT * FROM (VALUES (1, '', 'Grid Analyst', 'https://a.example/1', 'Leeds', '2024-01-02', ''), (2, '', 'Risk Clerk', 'https://b.example/2', '', '', '')) AS v(page_id, company, title, url, location, posted, valid_through)""")
def jsonld_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of the literal pages of every JSON-LD shape: a graph, a list, several types, one without a title, a broken block."""
    return extract.jobs_from_json_ld(extract.sample_pages(spark), "page_id")


@query("""SELECT * FROM (VALUES (1, '', 'Grid Analyst', 'Leeds', 'https://e.example/p1', '2024-01-02'), (2, '', '', '', 'https://e.example/p2', '')) AS v(page_id, company, title, location, url, posted)""")
def posting_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job pages read by their first plain JobPosting; of the second page only the item without a title is one."""
    return extract.posting_of_page(extract.sample_pages(spark), "page_id")


@query("""SELECT * FROM (VALUES (3, 'Data Engineer', 'https://e.example/p3/data-engineer', 'Bath', ''), (3, 'Trader', 'https://e.example/t', '', ''), (4, 'Scheduler', 'https://e.example/p4', 'Hull', ''),
    (8, 'Grid Planner', 'https://e.example/p8/grid-planner', '', '')) AS v(page_id, title, url, location, posted)""")
def state_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings in next data, an assignment and streamed strings; menus are none."""
    return extract.jobs_from_state(extract.sample_pages(spark), "page_id", url="url")


@query("""SELECT * FROM (VALUES (1, 'Grid Analyst', 'https://a.example/1', 1), (2, 'Risk Clerk', 'https://b.example/2', 1), (3, 'Data Engineer', 'https://e.example/p3/data-engineer', 2), (3, 'Trader', 'https://e.example/t', 2),
    (4, 'Scheduler', 'https://e.example/p4', 2), (5, 'Power Scheduler', 'https://e.example/jobs/77', 3), (5, 'Gas Analyst', 'https://e.example/careers/gas-analyst', 3), (5, 'Graduate Trader Programme', 'https://e.example/jobs/10', 3),
    (8, 'Grid Planner', 'https://e.example/p8/grid-planner', 2)) AS v(page_id, title, url, stage)""")
def extraction_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.cascade(extract.sample_pages(spark), "page_id", url="url")


@query("""SELECT company, title, location, url, source, posted, CAST(salary_min AS DOUBLE) AS salary_min, CAST(salary_max AS DOUBLE) AS salary_max, currency, salary_text, ord FROM (VALUES
    ('Acme', 'Analyst', 'Leeds', 'https://g.example/1', 'greenhouse', '2024-01-02', NULL, NULL, '', '', 0), ('Beta', 'Trader', 'Hull', 'https://l.example/2', 'lever', '1700000000000', NULL, NULL, '', '', 0),
    ('Core', 'Quant', 'Bath', 'https://a.example/3', 'ashby', '2024-01-05', NULL, NULL, '', '£50,000', 0), ('Delta', 'Clerk', 'York', 'https://jobs.smartrecruiters.com/delta/9', 'smartrecruiters', '2024-01-01', NULL, NULL, '', '', 0),
    ('Echo', 'Dev', 'Ely, UK', 'https://w.example/5', 'workable', '', NULL, NULL, '', '', 0), ('Fox', 'Ops', 'Rye', 'https://fox.example/hcmUI/CandidateExperience/en/sites/CX_1/job/7', 'oracle', '2024-01-03', NULL, NULL, '', '', 0),
    ('Fox', 'Plant', 'Rye', 'https://fox.example/hcmUI/CandidateExperience/en/sites/CX_1/job/8', 'oracle', '2024-01-04', NULL, NULL, '', '', 1), ('Gulf', 'Risk', 'Ayr', 'https://gulf.wd3.example.com/Ext/job/8', 'workday', 'Posted Today', NULL, NULL, '', '', 0),
    ('Hope', 'Buyer', 'Deal', 'https://z.example/9', 'adzuna', '2024-01-04', 30000, NULL, 'GBP', '', 0), ('Iris', 'Cook', 'Bude', 'https://p.example/10', 'pinpoint', '', NULL, NULL, '', '', 0),
    ('Jade', 'Driver', 'Wick', 'https://c.example/11', 'comeet', '', NULL, NULL, '', '', 0)) AS v(company, title, location, url, source, posted, salary_min, salary_max, currency, salary_text, ord)""")
def board_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.normalised(payloads.sample_payloads(spark))


_BOARD_ROWS = (
    "greenhouse/acme lever/beta workday/gamma/External - - bullhorn/AB12 jobadder/acme vincere/acme idibu/ loxo/ jobvite/ oracle/ab.fa.em2.oraclecloud.com/CX_1001 greenhouse/acme ashby/Acme smartrecruiters/Acme workable/acme recruitee/acme "
    "teamtailor/acme personio/acme breezy/acme bamboohr/acme rippling/acme pinpoint/acme comeet/acme jobvite/acme eightfold/acme icims/ taleo/ successfactors/ avature/ eploy/ oleeo/ tribepad/ applied/ brassring/ phenom/"
).split()


@query("WITH b(page_id, label, token) AS (VALUES " + ", ".join(f"({-i}, NULL, NULL)" if "/" not in x else f"({-i}, '{x.split('/', 1)[0]}', '{x.split('/', 1)[1]}')" for i, x in enumerate(_BOARD_ROWS, 1)) + """)
    SELECT page_id, label, token FROM b UNION ALL SELECT page_id, NULL, NULL FROM pages""")
def board_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board of every page, beside a literal page for each board (ids below zero); the table's pages have none."""
    return extract.fingerprints(pages(spark, sf_dir).select("page_id", "html").unionByName(extract.sample_boards(spark)), "page_id")


_TITLE_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[a-z]{{3,}}'))"
_BARE = "trim(regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
_MARKER = "CASE " + " ".join(f"WHEN contains(low, '{_Q(m)}') THEN '{_Q(m)}'" for m in fixed.CLOSED_MARKERS) + " END"
_LISTS = " OR ".join(f"contains(substr(low, 1, 4000), '{m}')" for m in fixed.LISTING_MARKERS)
_VERIFY = f"""WITH s AS (
        SELECT page_id AS id, url, CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 9 = 0 THEN 403 WHEN page_id % 13 = 0 THEN 404 ELSE 200 END AS status, html, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS title, '' AS company FROM pages
        UNION ALL SELECT * FROM (VALUES {extract.CHECK_PAGES_SQL}) AS v(id, url, status, html, title, company)),
    b AS (SELECT *, lower(coalesce(html, '')) AS low, regexp_extract(coalesce(html, ''), '(?s)<script[^>]+application/ld\\+json[^>]*>(.*?)</script>', 1) AS ld FROM s),
    j AS (SELECT *, CASE WHEN ld <> '' THEN json_extract_string(ld, '$.title') END AS ld_title, coalesce(json_extract_string(nullif(ld, ''), '$.hiringOrganization.name'), '') AS org, coalesce(json_extract_string(nullif(ld, ''), '$.datePosted'), '') AS ld_posted,
        coalesce(json_extract_string(nullif(ld, ''), '$.validThrough'), '') AS through, coalesce(json_extract_string(nullif(ld, ''), '$.description'), '') AS ld_text FROM b),
    t AS (SELECT *, coalesce(nullif(ld_title, ''), {_BARE.format("regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)")}) AS page_title, substr(CASE WHEN {_BARE.format('ld_text')} <> '' THEN {_BARE.format('ld_text')} ELSE {_BARE.format("coalesce(html, '')")} END, 1, 20000) AS body,
        CASE WHEN org <> '' THEN org ELSE company END AS firm, {_MARKER} AS marker FROM j),
    m AS (SELECT *, {_TITLE_WORDS.format("coalesce(title, '')")} AS x, {_TITLE_WORDS.format('page_title')} AS y FROM t),
    k AS (SELECT *, CASE WHEN len(x) > 0 AND len(y) > 0 THEN round(len(list_intersect(x, y)) / len(x), 3) ELSE 0 END AS match,
        CASE WHEN trim(coalesce(url, '')) = '' THEN 'no url' WHEN status IS NULL THEN 'unreachable (retries exhausted or host circuit open)' WHEN status IN {fixed.REFUSALS} THEN 'http ' || status || ' — site blocks automated checks, job not verified'
            WHEN status >= 400 THEN 'http ' || status WHEN marker IS NOT NULL THEN 'closed marker: ' || marker END AS stop FROM m),
    r AS (SELECT *, coalesce(stop, CASE WHEN match < 0.34 AND ({_LISTS}) THEN 'redirected to listings page' WHEN try_cast(nullif(through, '') AS TIMESTAMP) < TIMESTAMP '2024-01-31' THEN 'validThrough in the past' ELSE 'ok' END) AS reason FROM k)
    SELECT id, reason, CASE WHEN trim(coalesce(url, '')) <> '' AND (status IS NULL OR status IN {fixed.REFUSALS}) THEN NULL WHEN reason = 'ok' THEN 1 ELSE 0 END AS live, CASE WHEN stop IS NULL THEN match ELSE 0 END AS title_match,
        CASE WHEN stop IS NULL THEN firm ELSE company END AS employer, CASE WHEN stop IS NULL THEN ld_posted ELSE '' END AS ld_posted, CASE WHEN stop IS NULL THEN through ELSE '' END AS valid_through,
        CAST({_has('company', fixed.ANONYMOUS_EMPLOYER)} OR (stop IS NULL AND {_has('firm', fixed.ANONYMOUS_EMPLOYER)}) AS INTEGER) AS anonymous, CASE WHEN stop IS NULL AND {_has('body', fixed.AGENCY)} THEN 1 ELSE 0 END AS agency,
        CASE WHEN stop IS NULL THEN len(body) ELSE 0 END AS desc_len, CASE WHEN stop IS NULL THEN try_cast(nullif(regexp_extract(body, '([0-9]{{1,2}})\\+ years of experience', 1), '') AS INTEGER) END AS years_required FROM r"""


@query(_VERIFY)
def verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision list of a page check: pages as fetched (every ninth refused, every eleventh without answer), and literal job pages for every decision."""
    p = pages(spark, sf_dir)
    status = F.when(F.col("page_id") % 11 == 0, F.lit(None).cast("int")).when(F.col("page_id") % 9 == 0, 403).when(F.col("page_id") % 13 == 0, 404).otherwise(200)
    fetched = p.select(F.col("page_id").alias("id"), "url", F.col("url").alias("final_url"), status.alias("status"), "html", F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1).alias("title"), F.lit("").alias("company"))
    checked = extract.checked_pages(fetched.unionByName(extract.check_pages(spark)), "2024-01-31 00:00:00")
    return checked.select("id", "live", "reason", "title_match", "employer", "ld_posted", "valid_through", "anonymous", "agency", "desc_len", "years_required")


@query("""WITH l AS (SELECT page_id % 12 AS board, page_id AS page, len(html) % 120 AS n FROM pages),
    s AS (SELECT *, count(*) FILTER (WHERE n < 40) OVER (PARTITION BY board ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended, row_number() OVER (PARTITION BY board ORDER BY page) AS k FROM l)
    SELECT board, page, n FROM s WHERE ended = 0 AND k <= 12 AND n > 0""")
def paged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = pages(spark, sf_dir).select((F.col("page_id") % 12).alias("board"), F.col("page_id").alias("page"), (F.length("html") % 120).alias("n"))
    return payloads.pages_kept(landed, "board", "page", "n", full=40, most=12)


@query("""WITH l AS (SELECT unnest(regexp_extract_all('<urlset><url><loc>https://x.example/job/1</loc></url><url><loc>https://x.example/about</loc></url><url><loc>https://x.example/job/2</loc></url><url><loc>https://x.example/job/1</loc></url></urlset>', '<loc>([^<]+)</loc>', 1)) AS u)
    SELECT DISTINCT u AS url FROM l WHERE regexp_matches(u, '/job/')""")
def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = "<urlset><url><loc>https://x.example/job/1</loc></url><url><loc>https://x.example/about</loc></url><url><loc>https://x.example/job/2</loc></url><url><loc>https://x.example/job/1</loc></url></urlset>"
    return payloads.sitemap_urls(spark.createDataFrame([(1, xml)], "ord int, body string"), "/job/").select("url")


@query("""SELECT * FROM (VALUES ('https://x.example/jobs-1.xml', 1, 0), ('https://x.example/JOBS-2.xml', 1, 1), ('https://y.example/sitemap.xml', 2, 0)) AS v(url, ord, pos)""")
def sitemap_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemaps behind an index, a plain one, and one that did not answer."""
    index = "<sitemapindex><sitemap><loc> https://x.example/jobs-1.xml </loc></sitemap><loc>https://x.example/news.xml</loc><loc>https://x.example/JOBS-2.xml</loc></sitemapindex>"
    roots = [(1, "https://x.example/sitemap.xml", index), (2, "https://y.example/sitemap.xml", "<urlset><loc>https://y.example/job/1</loc></urlset>"), (3, "https://z.example/sitemap.xml", None)]
    return payloads.expanded_sitemaps(spark.createDataFrame(roots, "ord int, url string, body string"))
