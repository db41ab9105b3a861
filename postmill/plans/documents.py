"""Queries over documents (as descriptions), labels (as checks) and benchmark (as query texts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import text as T
from postmill.functions import fixed, udfs
from postmill.functions.text import NOISE_WORDS
from postmill.operators import dedupe, filters, match
from postmill.operators import score as S
from postmill.operators.index import text_index
from postmill.operators.rules import rule_join
from postmill.plans.registry import query
from postmill.session import narrow_batches
from postmill.sources.tables import spread, table

AS_OF = "2024-01-31 00:00:00"
_NOISE_SQL = "[" + ", ".join(f"'{w}'" for w in NOISE_WORDS) + "]"
_NORM = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'))"
_TOKENS = f"list_sort(list_filter(regexp_extract_all(lower(coalesce({{0}}, '')), '[a-z0-9]+'), lambda w: len(w) > 1 AND NOT list_contains({_NOISE_SQL}, w)))"
_TITLE = "split_part(text, chr(10), 1)"


def whole(words: str) -> str:
    """A pattern for whole words that means the same to every regular-expression engine: letters of any script delimit."""
    return "(?:^|[^\\p{L}])(?:" + words + ")(?:[^\\p{L}]|$)"


RUBRIC = S.Rubric(
    tiers=[("top", 50, [whole("the the"), whole("station")]), ("good", 30, [whole("the")]), ("fair", 15, [whole("de|la|der|und")]), ("weak", -20, [r"[#$%&*]{3}"])],
    junior=([whole("th"), whole("les")], 12, 0),
    phd={"required": -45, "preferred": -12},
    categories={"src0": 15, "src1": 10, "src2": 5, "unknown": 0},
    category_roles={"src0": (8, [whole("of")])},
    signals=[("insult", -40, ["idiot", "pathetic", "worthless"]), ("licence", -10, [r"licensed under", r"all rights reserved"]), ("long words", 10, ["[a-z]{14}"]), ("question", 5, [r"\?"])],
    home=([whole("of")], 6), away=([whole("des")], -6), no_location=-2,
    sources={"src0": 3, "src1": 2, "src3": 1}, freshness=[(3, 20), (7, 12), (14, 5), (30, 0), (60, -10)],
)


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings: the first line is the title; the source is the firm."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.col("source").alias("company"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("description"), "source", "lang")


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with their checks: a document without a label was never checked; quality is liveness, toxic anonymity.

    The other facts that a score reads come from the id: dates, years, a doctorate, the match of titles and reposts; the
    site of every seventeenth checked one refused the check.
    """
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("live"), F.col("toxic").alias("anonymous"))
    rows = spread(titled(spark, sf_dir)).join(labels, "id", "left").withColumn("category", F.col("company"))
    every = lambda n, k=0: F.pmod(F.col("id"), F.lit(n)) == k
    past = lambda n: F.date_format(F.date_sub(F.lit("2024-01-31").cast("date"), F.pmod(F.col("id"), F.lit(n)).cast("int")), "yyyy-MM-dd")
    return rows.withColumn("checked_at", F.when(F.col("live").isNotNull(), F.lit(AS_OF))).withColumns({
        "live": F.when(~every(17), F.col("live")), "years_required": F.when(every(3), F.pmod(F.col("id"), F.lit(11)).cast("int")), "phd": F.when(every(7), "required").when(every(7, 1), "preferred"),
        "posted": F.when(~every(4), past(90)), "first_seen": past(40), "title_match": F.pmod(F.col("id"), F.lit(10)) / 10.0, "valid_through": F.when(every(5), "2024-06-01").otherwise(""), "ghost": every(13),
    })


_SCORED = f"""
    WITH d AS (
        SELECT doc_id AS id, source, source AS company, {_TITLE} AS title, text, lower(text) AS body, quality IS NOT NULL AS was_checked, CASE WHEN doc_id % 17 <> 0 THEN quality END AS live, toxic,
            CASE WHEN doc_id % 3 = 0 THEN doc_id % 11 END AS years, CASE WHEN doc_id % 7 = 0 THEN 'required' WHEN doc_id % 7 = 1 THEN 'preferred' END AS phd, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 90 END AS posted_ago,
            coalesce(CASE WHEN doc_id % 4 <> 0 THEN doc_id % 90 END, doc_id % 40) AS age
        FROM documents LEFT JOIN labels USING (doc_id)),
    """
SCORED_TERMS = f"""t AS (
        SELECT *, len(body) AS n, translate(concat_ws(' ', '', title, ''), '-_/', '   ') AS place, title || chr(10) || body AS title_body,
            list_filter([
                CASE WHEN regexp_matches(title, '(?i)(?:^|[^\\p{{L}}])(?:the the|station)(?:[^\\p{{L}}]|$)') THEN {{'label': 'title:top', 'points': 50}}
                     WHEN regexp_matches(title, '(?i)(?:^|[^\\p{{L}}])(?:the)(?:[^\\p{{L}}]|$)') THEN {{'label': 'title:good', 'points': 30}}
                     WHEN regexp_matches(title, '(?i)(?:^|[^\\p{{L}}])(?:de|la|der|und)(?:[^\\p{{L}}]|$)') THEN {{'label': 'title:fair', 'points': 15}}
                     WHEN regexp_matches(title, '[#$%&*]{{3}}') THEN {{'label': 'title:weak', 'points': -20}} END,
                CASE WHEN regexp_matches(title, '(?i)(?:^|[^\\p{{L}}])(?:th|les)(?:[^\\p{{L}}]|$)') THEN {{'label': 'junior title', 'points': 12}} ELSE {{'label': 'no seniority marker', 'points': 0}} END,
                CASE WHEN years > 4 THEN {{'label': 'wants ' || years || 'y experience', 'points': -20 - 5 * (years - 5)}} END,
                CASE WHEN regexp_matches(title, '(?i){fixed.PHD}') THEN {{'label': 'title asks for a PhD', 'points': -60}} WHEN phd = 'required' THEN {{'label': 'description requires a PhD', 'points': -45}} WHEN phd = 'preferred' THEN {{'label': 'PhD preferred', 'points': -12}} END,
                {{'label': 'firm:' || coalesce(company, 'unknown'), 'points': CASE company WHEN 'src0' THEN 15 WHEN 'src1' THEN 10 WHEN 'src2' THEN 5 ELSE 0 END}},
                CASE WHEN company = 'src0' AND regexp_matches(title, '(?i)(?:^|[^\\p{{L}}])(?:of)(?:[^\\p{{L}}]|$)') THEN {{'label': 'src0 + this role type', 'points': 8}} END,
                CASE WHEN regexp_matches(title_body, '(?i)idiot|pathetic|worthless') THEN {{'label': 'jd:insult', 'points': -40}} END,
                CASE WHEN regexp_matches(title_body, '(?i)licensed under|all rights reserved') THEN {{'label': 'jd:licence', 'points': -10}} END,
                CASE WHEN n > 0 AND n < 400 THEN {{'label': 'jd too short to read (' || n || 'c)', 'points': 0}} END,
                CASE WHEN n >= 400 AND regexp_matches(body, '[a-z]{{14}}') THEN {{'label': 'jd:long words', 'points': 10}} END,
                CASE WHEN n >= 400 AND regexp_matches(body, '\\?') THEN {{'label': 'jd:question', 'points': 5}} END,
                CASE WHEN regexp_matches(place, '(?i)(?:^|[^\\p{{L}}])(?:of)(?:[^\\p{{L}}]|$)') THEN {{'label': 'UK confirmed', 'points': 6}}
                     WHEN regexp_matches(place, '(?i)(?:^|[^\\p{{L}}])(?:des)(?:[^\\p{{L}}]|$)') THEN {{'label': 'outside the UK', 'points': -6}} ELSE {{'label': 'location not stated', 'points': -2}} END,
                {{'label': 'via ' || coalesce(source, ''), 'points': CASE source WHEN 'src0' THEN 3 WHEN 'src1' THEN 2 WHEN 'src3' THEN 1 ELSE 0 END}},
                CASE WHEN age <= 3 THEN {{'label': age || 'd old', 'points': 20}} WHEN age <= 7 THEN {{'label': age || 'd old', 'points': 12}} WHEN age <= 14 THEN {{'label': age || 'd old', 'points': 5}} WHEN age > 30 AND age <= 60 THEN {{'label': age || 'd old', 'points': -10}} END,
                CASE WHEN NOT was_checked THEN {{'label': 'not verified', 'points': -5}} WHEN live IS NULL THEN {{'label': 'site blocked the check', 'points': -5}} WHEN live = 0 THEN {{'label': 'dead: ', 'points': -100}} ELSE {{'label': 'verified live', 'points': 10}} END,
                CASE WHEN live <> 0 AND id % 10 < 4 THEN {{'label': 'page title mismatch', 'points': -15}} END,
                CASE WHEN live <> 0 AND toxic <> 0 THEN {{'label': 'employer anonymous', 'points': -10}} END,
                CASE WHEN live <> 0 AND posted_ago > 60 AND id % 5 <> 0 THEN {{'label': 'open ' || posted_ago || 'd, no close date', 'points': -10}} END,
                CASE WHEN id % 13 = 0 THEN {{'label': 'reposted repeatedly', 'points': -25}} END
            ], lambda x: x IS NOT NULL) AS why
        FROM d),
    s AS (SELECT *, CAST(list_sum(list_transform(why, lambda x: x.points)) AS INTEGER) AS score FROM t)"""
_SCORED += SCORED_TERMS + "\n"


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scored(checked(spark, sf_dir), RUBRIC, F.lit(AS_OF))


@query(_SCORED + """SELECT id, score, list_aggregate(list_transform(why, lambda t: t.label || CASE WHEN t.points >= 0 THEN '+' ELSE '' END || t.points), 'string_agg', '; ') AS why FROM s""")
def score_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).select("id", "score", S.explained(F.col("why")).alias("why"))


@query(_SCORED + """, c AS (
    SELECT id, company, title, score, row_number() OVER (PARTITION BY trim(regexp_replace(lower(coalesce(company, '')), '[^a-z0-9]+', ' ', 'g')) ORDER BY score DESC, id) AS n
    FROM s WHERE live IS DISTINCT FROM 0)
    SELECT id, company, title, score FROM c WHERE n <= 3 ORDER BY score DESC, id LIMIT 60""")
def score_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: scored, proven-dead rows dropped, three of a firm at most, best 60."""
    rows = ranked(spark, sf_dir).where(~F.col("live").eqNullSafe(F.lit(0)))
    best = dedupe.cap_per_group(rows, [T.norm("company")], 3, [F.desc("score"), "id"])
    return best.orderBy(F.desc("score"), "id").limit(60).select("id", "company", "title", "score")


@query(_SCORED + """, c AS (SELECT id, score, row_number() OVER (PARTITION BY company ORDER BY score DESC, id) AS n FROM s WHERE score >= 60),
    short AS (SELECT id, score, 'shortlist' AS section FROM c WHERE n <= 5 ORDER BY score DESC, id LIMIT 40),
    rest AS (SELECT id, score, 'rest' AS section FROM s WHERE score >= 20 AND id NOT IN (SELECT id FROM short) ORDER BY score DESC, id LIMIT 40)
    SELECT * FROM short UNION ALL SELECT * FROM rest""")
def two_section_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.two_sections(ranked(spark, sf_dir).select("id", "company", "score"), "company", 60, 20, 5, 40, seq="id").select("id", "score", "section")


@query(_SCORED + "SELECT id, CASE WHEN score >= 110 THEN 'A' WHEN score >= 90 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 45 THEN 'D' ELSE 'E' END AS band FROM s")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).select("id", S.score_bands(F.col("score")).alias("band"))


@query(_SCORED + """, w AS (SELECT id, score, company, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS nt,
        trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS flat FROM s),
    f AS (SELECT *, CASE WHEN len(flat) >= 400 THEN substr(sha1(substr(flat, 1, 1500)), 1, 16) END AS fp FROM w),
    k AS (SELECT *, row_number() OVER (PARTITION BY company, fp ORDER BY score DESC, id) AS n,
        first_value(list_distinct(string_split(nt, ' '))) OVER (PARTITION BY company, fp ORDER BY score DESC, id) AS keep FROM f)
    SELECT id, score FROM k WHERE fp IS NULL OR n = 1 OR NOT (list_has_all(keep, list_distinct(string_split(nt, ' '))) OR list_has_all(list_distinct(string_split(nt, ' ')), keep))""")
def near_title_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.description_collapse(ranked(spark, sf_dir), "company", "title", "description", seq="id").select("id", "score")


@query("SELECT doc_id, " + _NORM.format("text") + " AS norm FROM documents")
def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.norm("text").alias("norm"))


@query(f"""SELECT doc_id, substr(sha1(array_to_string({_TOKENS.format('source')}, '') || '|' || array_to_string({_TOKENS.format(_TITLE)}, ' ')), 1, 16) AS key FROM documents""")
def canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = spread(titled(spark, sf_dir).select("id", "company", "title"))
    return short.select(F.col("id").alias("doc_id"), T.canonical_key("company", "title").alias("key"))


@query("""WITH f AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents),
    k AS (SELECT doc_id, substr(sha1(substr(t, 1, 1500)), 1, 16) AS fp FROM f WHERE len(t) >= 400)
    SELECT fp, count(*) AS n, min(doc_id) AS first_id FROM k GROUP BY fp HAVING count(*) > 1""")
def jd_fingerprint_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.fingerprint("text").alias("fp")).where("fp is not null")
    return rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query(f"""WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower({_TITLE}), '[a-z]{{3,}}')) AS a, list_distinct(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS b FROM documents)
    SELECT doc_id, CASE WHEN len(a) > 0 AND len(b) > 0 THEN round_even(len(list_intersect(a, b)) / len(a), 3) ELSE 0 END AS similarity FROM w""")
def title_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titled(spark, sf_dir).select(F.col("id").alias("doc_id"), T.title_similarity("title", "description").alias("similarity"))


@query("""WITH s AS (SELECT doc_id, string_split(trim(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '([.!?]) ', '\\1' || chr(1), 'g')), chr(1)) AS parts, len(text) AS n FROM documents)
    SELECT doc_id, len(parts) AS n_sentences, CASE WHEN n >= 400 THEN CASE
        WHEN len(list_filter(parts, lambda x: regexp_matches(x, '\\bthe\\b') AND NOT regexp_matches(x, '\\b(?:of|and)\\b'))) > 0 THEN 'required'
        WHEN len(list_filter(parts, lambda x: regexp_matches(x, '\\bthe\\b'))) > 0 THEN 'preferred' END END AS verdict FROM s""")
def sentence_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(T.sentences("text")).alias("n_sentences"), T.graded_requirement("text", r"\bthe\b", r"\b(?:of|and)\b").alias("verdict"))


@query("""WITH n AS (SELECT doc_id, text, list_filter(list_transform(regexp_extract_all(text, '[\\d,]{4,9}'), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)), lambda x: x BETWEEN 10000 AND 1000000) AS k FROM documents)
    SELECT doc_id, list_min(k) AS lo, list_max(k) AS hi, CASE WHEN len(k) > 0 AND contains(text, '£') THEN 'GBP' ELSE '' END AS currency FROM n""")
def salary_band_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.salary_band("text").alias("b")).select("doc_id", "b.*")


@query(f"""WITH r AS (SELECT CASE WHEN trim({_TITLE}) = '' THEN 'empty title' WHEN len(trim({_TITLE})) > 300 THEN 'title absurdly long'
        WHEN regexp_matches(trim({_TITLE}), '(?i)<[a-z/!]') THEN 'title contains markup' WHEN NOT regexp_matches(trim({_TITLE}), '[a-zA-Z]{{3}}') THEN 'title has no words'
        WHEN trim(coalesce(source, '')) = '' THEN 'no company' ELSE 'valid' END AS reason FROM documents)
    SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def row_validity_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = titled(spark, sf_dir).withColumn("url", F.lit(""))
    return rows.groupBy(F.coalesce(filters.invalid_reason(), F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def lifecycle_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""SELECT d.doc_id, coalesce(d.source, 'unknown') AS source, CASE WHEN l.quality IS NULL THEN 'unverified' WHEN l.quality = 0 THEN 'dead' ELSE 'live' END AS state
    FROM documents d LEFT JOIN labels l USING (doc_id)""")
def left_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    state = F.when(F.col("quality").isNull(), "unverified").when(F.col("quality") == 0, "dead").otherwise("live")
    return rows.select("doc_id", F.coalesce("source", F.lit("unknown")).alias("source"), state.alias("state"))


@query("""SELECT source, count(*) AS n, count(*) FILTER (WHERE l.quality = 1) AS live, count(*) FILTER (WHERE l.quality = 0) AS dead, count(*) FILTER (WHERE l.doc_id IS NULL) AS unverified
    FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source""")
def liveness_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("live"), F.count_if(F.col("quality") == 0).alias("dead"), F.count_if(F.col("quality").isNull()).alias("unverified"))


@query("""WITH r AS (SELECT * FROM (VALUES ('insult', 'idiot|pathetic', -40), ('licence', 'licensed under', -10), ('number', '[0-9]{4}', 3), ('question', '\\?', 5)) AS v(label, pattern, points))
    SELECT doc_id, label, points FROM documents JOIN r ON regexp_matches(lower(text), pattern)""")
def rule_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by rules as generated columns and an unnest: one scan of the text, no join."""
    rules = [("insult", "idiot|pathetic", -40), ("licence", "licensed under", -10), ("number", "[0-9]{4}", 3), ("question", r"\?", 5)]
    low = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t"))
    hits = F.filter(F.array(*[F.when(F.rlike("t", F.lit(p)), F.struct(F.lit(k).alias("label"), F.lit(n).alias("points"))) for k, p, n in rules]), lambda x: x.isNotNull())
    return low.select("doc_id", F.inline(hits))


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM benchmark),
    d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)
    SELECT doc_id, word AS label, len(word) AS points FROM d JOIN w USING (word)""")
def rules_of_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the benchmark as a rule (hundreds to thousands) over every document: one pass, no pairs but those found."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(T.words("text", "[a-z]{4,}")).alias("w")).distinct().orderBy("w").toLocalIterator()
    rules = [(r["w"], f"(?<![a-z]){r['w']}(?![a-z])", len(r["w"])) for r in words]
    return rule_join(spread(table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))), "doc_id", "text", rules)


@query("""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM documents)
    WHERE word NOT IN ('that', 'with', 'this', 'from') GROUP BY word ORDER BY n DESC, word LIMIT 14""")
def word_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spread(table(spark, sf_dir, "documents").select("text")).select(F.explode(T.words("text", "[a-z]{4,}")).alias("word"))
    return found.where(~F.col("word").isin("that", "with", "this", "from")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(14)


_TERMS = "list_transform(regexp_extract_all(lower(coalesce({0}, '')), '[a-z][a-z+#.]{{2,}}'), lambda w: rtrim(w, '.'))"
_TFIDF = f"""
    WITH d AS (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS n FROM d GROUP BY ALL),
    b AS (SELECT unnest({_TERMS.format('text')}) AS term FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)),
    q AS (SELECT term, count(*) AS n FROM b GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM (SELECT doc_id, term FROM tf UNION ALL SELECT -1, term FROM q) GROUP BY term),
    idf AS (SELECT term, ln(1 + ((SELECT count(*) FROM documents) + 1) / (1 + df)) AS w FROM df),
    dn AS (SELECT doc_id, sqrt(sum(n * w * n * w)) AS norm FROM tf JOIN idf USING (term) GROUP BY doc_id),
    qn AS (SELECT sqrt(sum(n * w * n * w)) AS norm FROM q JOIN idf USING (term)),
    c AS (SELECT tf.doc_id, sum(tf.n * w * q.n * w) AS dot FROM tf JOIN q USING (term) JOIN idf USING (term) GROUP BY tf.doc_id)
"""


@query(_TFIDF + """SELECT doc_id, round(dot / (dn.norm * qn.norm), 6) AS cosine, CAST(round_even(100 * (dot / (dn.norm * qn.norm)) / max(dot / (dn.norm * qn.norm)) OVER (), 0) AS INTEGER) AS relative
    FROM c JOIN dn USING (doc_id), qn""")
def tfidf_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    bench = table(spark, sf_dir, "benchmark")
    first = bench.agg(F.min_by("text", "item_id").alias("text"))
    return match.relative_scores(match.tfidf_cosine(docs, "doc_id", first)).select("doc_id", F.round("cosine", 6).alias("cosine"), "relative")


_BEST = f"""
    WITH d AS (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS n FROM d GROUP BY ALL),
    t AS (SELECT (SELECT count(*) FROM documents) + 1 AS total),
    df AS (SELECT term, count(*) AS df, ln(1 + total / (1 + count(*))) AS w, ln(1 + total / (2 + count(*))) AS wq FROM tf, t GROUP BY term, total),
    b AS (SELECT item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark),
    q AS (SELECT item_id, term, count(*) AS n, any_value(coalesce(wq, ln(1 + total / 2))) AS wq, any_value(w) AS w FROM b LEFT JOIN df USING (term), t GROUP BY item_id, term),
    qn AS (SELECT item_id, sqrt(sum(n * wq * n * wq)) AS norm FROM q GROUP BY item_id),
    dn AS (SELECT doc_id, sum(n * w * n * w) AS norm2 FROM tf JOIN df USING (term) GROUP BY doc_id),
    c AS (SELECT item_id, doc_id, sum(tf.n * q.n * q.wq * q.wq) AS dot, sum(tf.n * tf.n * (q.wq * q.wq - q.w * q.w)) AS moved FROM tf JOIN q USING (term) GROUP BY ALL),
    r AS (SELECT item_id, doc_id, dot / (sqrt(norm2 + moved) * norm) AS cosine FROM c JOIN dn USING (doc_id) JOIN qn USING (item_id)),
    k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(cosine, 9) DESC, doc_id) AS place FROM r)
"""


@query(_BEST + "SELECT item_id, CAST(place AS INTEGER) AS place, round(cosine, 6) AS cosine FROM k WHERE place <= 5")
def tfidf_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most alike documents of every benchmark text, all in one plan: the cosines of each place (which of equal copies holds it is left open)."""
    index = text_index(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id")
    found, _ = index.top(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text"), 5)
    return found.select(F.col("qid").alias("item_id"), "place", F.round("cosine", 6).alias("cosine"))


@query(f"""WITH d AS (SELECT doc_id, {_TERMS.format('text')} AS ts FROM documents),
    u AS (SELECT doc_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM d),
    tf AS (SELECT doc_id, term, count(*) AS n, min(pos) AS pos FROM u GROUP BY ALL),
    top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS k FROM tf),
    q AS (SELECT DISTINCT unnest({_TERMS.format('text')}) AS term FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)),
    miss AS (SELECT doc_id, term, k, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS m FROM top WHERE k <= 60 AND term NOT IN (SELECT term FROM q))
    SELECT doc_id, string_agg(term, ' ' ORDER BY m) AS gaps FROM miss WHERE m <= 8 GROUP BY doc_id""")
def match_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    first = table(spark, sf_dir, "benchmark").agg(F.min_by("text", "item_id").alias("text"))
    return match.gaps(docs, "doc_id", first)


@query()
def clean_text_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow_batches(spark)
    return table(spark, sf_dir, "documents").select("doc_id", udfs.clean_text("text").alias("clean"))


_WANTS = [
    (-1, "You bring 3-5 years of relevant experience.", 3), (-2, "At least 5+ years' experience; 2 years of track record in gas.", 5), (-3, "We have 30 years of experience in the market.", None), (-4, "Our team has 20 years of experience. You have 4 years of experience.", 4),
    (-5, "Our ideal candidate has 7 plus years of trading experience.", 7), (-6, "26 years of experience", None), (-7, "10 to 12 years in an office. Experience helps.", None), (-8, "", None), (-9, None, None),
]


@query("""WITH y AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '(?i)""" + fixed.YEARS + """', 1), lambda x: CAST(x AS INTEGER)), lambda x: x <= 25) AS ys FROM documents)
    SELECT doc_id, list_min(ys) AS years FROM y UNION ALL SELECT * FROM (VALUES """ + ", ".join(f"({i}, {'NULL' if n is None else n})" for i, _, n in _WANTS) + ") AS v(doc_id, years)")
def years_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of experience of every document, beside literal demands and boasts (ids below zero); no document of the tables boasts."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(i, t) for i, t, _ in _WANTS], "doc_id long, text string"))
    narrow_batches(spark)
    return texts.select("doc_id", udfs.years_required("text").alias("years"))


@query(_SCORED + """, r AS (SELECT id, CASE WHEN regexp_matches(title, '(?i)licensed') THEN 'title' WHEN years > 6 THEN '>6y experience' WHEN posted_ago > 45 AND id % 5 <> 0 THEN 'open >45d with no close date' ELSE 'kept' END AS cut FROM s)
    SELECT cut, count(*) AS n FROM r GROUP BY cut""")
def refilter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows by the rule that no longer lets them through: reasons are disjoint."""
    rows = filters.retroactive(checked(spark, sf_dir), F.lit(AS_OF), title="(?i)licensed", max_years=6, max_open=45)
    return rows.groupBy(F.coalesce("cut", F.lit("kept")).alias("cut")).agg(F.count("*").alias("n"))


@query(_SCORED + """, w AS (SELECT *, list_aggregate(list_transform(why, lambda t: t.label || CASE WHEN t.points >= 0 THEN '+' ELSE '' END || t.points), 'string_agg', '; ') AS note,
        CASE WHEN id % 19 = 0 THEN '' ELSE 'https://x.example/' || (id % 700) END AS url FROM s),
    f AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN url = '' THEN '#' || id ELSE url END ORDER BY id) AS k, try_cast(nullif(regexp_extract(note, 'open (\\d+)d, no close date', 1), '') AS INTEGER) AS open_for FROM w)
    SELECT id, CASE WHEN url = '' THEN 'nolink' WHEN k > 1 THEN 'duplicate' WHEN regexp_matches(title, '(?i)""" + fixed.BROKING + """') THEN 'broker' WHEN open_for > 45 THEN 'stale' END AS cut,
        CASE WHEN score >= 110 THEN 'Prime' WHEN score >= 90 THEN 'Strong' WHEN score >= 70 THEN 'Worth a look' WHEN score >= 45 THEN 'Marginal' ELSE 'Long tail' END AS band,
        contains(note, 'site blocked the check') AS unverified, try_cast(nullif(regexp_extract(note, '\\b(\\d+)d old', 1), '') AS INTEGER) AS age FROM f""")
def apply_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the apply list keeps and why not, with bands and marks."""
    url = F.when(F.col("id") % 19 == 0, "").otherwise(F.concat(F.lit("https://x.example/"), (F.col("id") % 700).cast("string")))
    rows = ranked(spark, sf_dir).withColumns({"why": S.explained(F.col("why")), "url": url})
    return filters.apply_list(rows, seq="id").select("id", "cut", "band", "unverified", "age")


@query("""SELECT doc_id, lang, round(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(regexp_replace(text, '[^\\p{L}]', '', 'g')), 6) >= 0.9 AS latin
    FROM documents WHERE length(regexp_replace(text, '[^\\p{L}]', '', 'g')) > 0""")
def latin_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where(F.length(F.regexp_replace("text", r"[^\p{L}]", "")) > 0)
    return rows.select("doc_id", "lang", T.mostly_latin("text", 0.9).alias("latin"))


@query("""SELECT doc_id, repeat('█', CAST(greatest(1, round_even(24 * n_chars / greatest(max(n_chars) OVER (PARTITION BY source), 1), 0)) AS INTEGER)) AS bar FROM documents""")
def text_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    most = docs.groupBy("source").agg(F.max("n_chars").alias("most"))
    return docs.join(most, docs["source"].eqNullSafe(most["source"])).select("doc_id", T.bar(F.col("n_chars"), F.col("most")).alias("bar"))


@query()
def description_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lead, wants, stop, asks = r"(?i)\babout the role\b[: -]*", r"(?i)\brequirements?\s*[:-]\s*", r"(?i)\b(?:benefits|how to apply|privacy)\b", r"(?i)experience|degree|ability to|\bthe\b"
    return docs.select("doc_id", T.summary("text", lead, wants, stop).alias("summary"), T.stated_requirements("text", wants, stop, asks).alias("requirements"))
