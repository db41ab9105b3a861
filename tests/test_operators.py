import pytest
import random

from pyspark.sql import functions as F

from postmill.operators import dedupe, filters, fold, health, score
from postmill.operators import extract
from postmill.sources import payloads, registry_tables, settings


def replayed(rows, rank):
    state = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        s = state.get(r["id"])
        if s is None:
            state[r["id"]] = dict(r, seen=1, best=rank.get(r["source"], 0))
            continue
        s["seen"] += 1
        if rank.get(r["source"], 0) > s["best"]:
            s["best"], s["source"] = rank.get(r["source"], 0), r["source"]
            s["url"] = r["url"] or s["url"]
        if s["lo"] is None and r["lo"] is not None:
            s["lo"], s["hi"] = r["lo"], r["hi"]
    return state


def test_fold_equals_a_sequential_replay(spark):
    rng = random.Random(5)
    rank = {"a": 3, "b": 2, "c": 2}
    rows = [{"id": f"k{rng.randrange(80)}", "seq": i, "source": rng.choice("abcx"), "url": rng.choice(["", f"u{i}"]), "title": f"t{i}", "lo": rng.choice([None, 1.0 * i]), "hi": 2.0 * i} for i in range(1200)]
    df = spark.createDataFrame(rows, "id string, seq long, source string, url string, title string, lo double, hi double")
    got = {r.id: r for r in fold.upsert_fold(df, ["id"], "seq", F.coalesce(*[F.when(F.col("source") == k, F.lit(v)) for k, v in rank.items()]), ["title"], salary=["lo", "hi"]).collect()}
    want = replayed(rows, rank)
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert (got[k].source, got[k].url, got[k].title, got[k].lo, got[k].hi, got[k].seen_count) == (w["source"], w["url"], w["title"], w["lo"], w["hi"], w["seen"])


def test_breaker(spark):
    log = spark.createDataFrame([("h", float(i), i > 9) for i in range(12)] + [("g", 0.0, True)], "host string, at double, ok boolean")
    got = {(r.host, r["at"]): r.state for r in fold.circuit_breaker(log, failures=3, cool_down=5.0).collect()}
    assert [got["h", float(i)] for i in range(4)] == ["failed"] * 3 + ["skipped"]
    assert got["h", 7.0] == "failed" and got["g", 0.0] == "ok"


def test_registry_additions(spark):
    have = spark.createDataFrame([("Acme", "acme.example")], "name string, domain string")
    new = spark.createDataFrame([(1, "ACME", "x", "z.example"), (2, "Beta", "x", "acme.example"), (3, "Beta", "x", ""), (4, "Core", "x", ""), (5, "beta", "x", "b.example"), (6, " ", "x", "")], "seq long, name string, category string, domain string")
    got = {r.seq: r.verdict for r in fold.accept_new(have, new).collect()}
    assert got == {1: "name taken", 2: "domain taken", 3: "accepted", 4: "accepted", 5: "name taken", 6: "no name"}


def test_miss_streaks_and_prune(spark):
    v = spark.createDataFrame([("a", i, x) for i, x in enumerate("uuouuu")], "name string, run long, v string")
    assert [r.misses for r in fold.miss_streaks(v, "name", "run", F.col("v") == "u").orderBy("run").collect()] == [1, 2, 0, 1, 2, 3]
    p = spark.createDataFrame([("a", "unreachable", "", 3), ("b", "unreachable", "HTTP 410", 1), ("c", "blocked", "", 9), ("d", "unreachable", None, 2)], "name string, verdict string, detail string, misses int")
    assert {r.name for r in fold.prune_missing(p).collect()} == {"a", "b"}


def test_collapse_and_cap(spark):
    body = "The same long description of one desk and what it does all day. " * 10
    rows = spark.createDataFrame(
        [(1, "F", "Energy Analyst", body, 9, "https://x/1"), (2, "F", "Energy Analyst Renewables", body, 8, "https://x/2"), (3, "F", "Gas Trader", body, 7, "https://x/3"), (4, "F", "Energy Analyst", "short", 6, ""), (5, "G", "Energy Analyst", body, 5, "HTTPS://x/1/"), (6, "G", "Blank", "", 4, "")],
        "id long, company string, title string, description string, score int, url string",
    )
    assert {r.id for r in dedupe.url_collapse(rows, seq="id").collect()} == {1, 2, 3, 4, 6}
    assert {r.id for r in dedupe.description_collapse(rows, "company", "title", "description", seq="id").collect()} == {1, 3, 4, 5, 6}
    assert {r.id for r in dedupe.cap_per_group(rows, ["company"], 2, [F.desc("score"), "id"]).collect()} == {1, 2, 5, 6}
    assert dedupe.cap_per_group(rows, ["company"], None, ["id"]).count() == 6


def test_ghosts(spark):
    rows = spark.createDataFrame([(i, "f", d) for i, d in enumerate(["2024-01-01", "2024-02-01", "2024-06-01"])] + [(9, "g", "2024-01-01")], "id long, firm string, d string").withColumn("at", F.to_timestamp("d"))
    assert {r.id for r in dedupe.reposted(rows, [F.col("firm")], "at").collect()} == {0, 1, 2}


RULES = filters.CollectionRules(include=["power trader"], roles=["analyst", "trader"], domains=["power", "gas", "analyst"], exclude=["senior", "head of"], rank_words=["senior"], junior=["graduate"], home=["uk"], away=["paris", "texas"], locations=["london", "leeds"])


def test_filter(spark):
    cases = [
        ("Power Trader", "", None), ("Gas Analyst", "Leeds", None), ("Analyst", "London", "no match"), ("Senior Gas Analyst", "", "excluded word"), ("Graduate Senior Gas Analyst", "", None),
        ("Graduate Head of Gas Trader", "", "excluded word"), ("Gas Trader Paris", "London", "location"), ("Gas Trader", "Texas", "location"), ("Gas Trader", "Texas or UK", None), ("Gas Trader", "Rome", "location"), (None, None, "no match"),
    ]
    df = spark.createDataFrame([(i, t, w) for i, (t, w, _) in enumerate(cases)], "seq long, title string, location string")
    got = {r.seq: r.why for r in df.select("seq", RULES.verdict(F.col("title"), F.col("location")).alias("why")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]
    kept, counts = filters.audited(df, RULES.verdict(F.col("title"), F.col("location")))
    assert kept.count() == 4 and {r.reason: r.n for r in counts.collect()}["location"] == 3


def test_rules_are_checked():
    assert RULES.problems(["Power Trader"], ["Senior Gas Analyst"]) == []
    assert filters.CollectionRules(include=["("]).problems() and filters.CollectionRules(include=["x*"]).problems()
    assert RULES.problems(must_keep=["Chef"]) == ["would drop 'Chef'"]


def test_validity(spark):
    rows = [("", "", "c"), ("x" * 301, "", "c"), ("<b>Job</b>", "", "c"), ("12 34", "", "c"), ("Analyst", "ftp://x", "c"), ("Analyst", "", " "), ("Analyst", "https://x", "c")]
    df = spark.createDataFrame(rows, "title string, url string, company string")
    assert [r.w for r in df.select(filters.invalid_reason().alias("w")).collect()] == ["empty title", "title absurdly long", "title contains markup", "title has no words", "bad url", "no company", None]


def test_score_orders_and_explains(spark):
    rubric = score.Rubric(tiers=[("core", 40, ["trader"])], junior=(["junior"], 10, 0), signals=[("no experience", 25, ["entry level"]), ("language", -30, ["german"])], freshness=[(7, 8), (30, 0)], sources={"a": 5})
    body = "entry level role. " + "words " * 100
    rows = [
        (1, "Junior Trader", body, "a", "2024-01-30", 1, "x"), (2, "Trader", "entry level", "a", "2024-01-30", 1, "x"), (3, "German Trader", "", "b", None, None, "x"), (4, "Trader", body, "b", None, 0, "x"), (5, "Trader", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id long, title string, description string, source string, posted string, live int, checked_at string")
    got = {r.id: r for r in score.scored(df, rubric, F.lit("2024-01-31")).collect()}
    labels = {i: [w.label for w in r.why] for i, r in got.items()}
    assert got[1].score > got[2].score > got[3].score > got[4].score
    assert "jd:no experience" in labels[1] and "jd:no experience" not in labels[2]
    assert "jd:language" in labels[3] and "site blocked the check" in labels[3] and "not verified" in labels[5] and "1d old" in labels[1]
    assert all(r.score == sum(w.points for w in r.why) for r in got.values())


def test_percentiles_by_index(spark):
    vals = [5.0, 1.0, 3.0, 3.0, 9.0, 7.0]
    r = health.index_percentiles(spark.createDataFrame([(v,) for v in vals], "v double"), "v", (0.25, 0.5, 0.99)).first()
    s = sorted(vals)
    assert (r.p25, r.p50, r.p99, r.lo, r.hi, r.n) == (s[1], s[3], s[5], 1.0, 9.0, 6)


def test_extraction(spark):
    pages = extract.sample_pages(spark)
    assert {(r.page_id, r.stage, r.title) for r in extract.cascade(pages, "page_id", url="url").collect()} == {
        (1, 1, "Grid Analyst"), (2, 1, "Risk Clerk"), (3, 2, "Data Engineer"), (3, 2, "Trader"), (4, 2, "Scheduler"), (5, 3, "Power Scheduler"), (5, 3, "Gas Analyst"), (5, 3, "Graduate Trader Programme"), (8, 2, "Grid Planner"),
    }
    firms = pages.withColumns({"firm": F.col("page_id") % 2, "at": 10 - F.col("page_id")})
    assert {(r.page_id, r.stage) for r in extract.cascade(firms, "page_id", "url", "firm", "at").collect()} == {(5, 3), (8, 2)}


def test_payloads(spark):
    rows = {r.source: r for r in payloads.normalised(payloads.sample_payloads(spark)).collect()}
    assert len(rows) == 10 and rows["smartrecruiters"].url == "https://jobs.smartrecruiters.com/delta/9"
    assert rows["workday"].url == "https://gulf.wd3.example.com/gulf/Ext/job/8" or rows["workday"].url.endswith("/Ext/job/8")
    assert rows["adzuna"].company == "Hope" and rows["adzuna"].salary_min == 30000.0 and rows["adzuna"].salary_max is None
    assert rows["pinpoint"].location == "Bude" and rows["comeet"].location == "Wick" and rows["workable"].location == "Ely, UK"
    xml = spark.createDataFrame([("C", "feed", "<rss><item><title>T1</title><link>u1</link><city>L</city><d>x</d></item><item><title>T2</title><link>u2</link><city>M</city><d>y</d></item></rss>")], "company string, source string, body string")
    assert [(r.title, r.url) for r in payloads.normalised_xml(xml, "item", "title", "link", "city", "d").orderBy("ord").collect()] == [("T1", "u1"), ("T2", "u2")]


def test_page_checks(spark):
    rows = [
        (1, "https://x/1", 200, "https://x/1", "<title>Gas Trader</title>ok"), (2, "https://x/2", 403, "", ""), (3, "https://x/3", None, "", None), (4, "https://x/4", 404, "", ""), (5, "", 200, "", ""),
        (6, "https://x/6", 200, "https://x/6", "this role has been filled"), (7, "https://x/7", 200, "https://x/jobs/", "current openings"), (8, "https://x/8", 200, "https://x/8", '<script type="application/ld+json">{"@type":"JobPosting","title":"Gas Trader","validThrough":"2020-01-01"}</script>'),
    ]
    df = spark.createDataFrame([(*r, "Gas Trader") for r in rows], "id long, url string, status int, final_url string, html string, title string")
    got = {r.id: r.live for r in extract.checked_pages(df, "2024-01-31 00:00:00").collect()}
    assert got == {1: 1, 2: None, 3: None, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0}


def test_board_fingerprints(spark, tmp_path):
    from postmill.plans import registry

    labels = (
        "greenhouse lever workday - - bullhorn jobadder vincere idibu loxo jobvite oracle greenhouse ashby smartrecruiters workable recruitee teamtailor personio breezy bamboohr rippling pinpoint comeet "
        "jobvite eightfold icims taleo successfactors avature eploy oleeo tribepad applied brassring phenom"
    ).split()
    got = {r.page_id: (r.label, r.token) for r in extract.fingerprints(extract.sample_boards(spark), "page_id").collect()}
    assert [got[-i][0] or "-" for i in range(1, len(got) + 1)] == labels
    assert {got[-i][1].lower() for i in (1, 7, 8, 13, *range(14, 27))} == {"acme"} and got[-3][1] == "gamma/External" and got[-6][1] == "AB12" and got[-12][1] == "ab.fa.em2.oraclecloud.com/CX_1001"
    cases = [
        ('<script src="https://boards.greenhouse.io/embed/job_board/js?for=acme">', "greenhouse", "acme"), ("boards.greenhouse.io/embed/job_app?token=5&amp;for=acme", "greenhouse", "acme"), ("boards.greenhouse.io/embed/job_app?token=5", "greenhouse", ""),
        ("www.bamboohr.com acme.breezy.hr www.breezy.hr", "breezy", "acme"), ("www.bamboohr.com acme.icims.com", "icims", ""), ("https://gamma.wd3.myworkdayjobs.com/wday/cxs/gamma jobs.lever.co/beta.", "lever", "beta"),
        ("at gamma.wd3.myworkdayjobs.com", "workday", "gamma"), ("rippling.com/platform/api/ats/v1/board/acme", "rippling", "acme"), ("comeet.co/careers-api/2.0/company/A1.B2", "comeet", "A1.B2"), ("acme.recruitee.com https://g.wd1.myworkdayjobs.com/Site", "workday", "g/Site"),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "page_id long, html string")
    got = {r.page_id: (r.label, r.token) for r in extract.fingerprints(rows, "page_id").collect()}
    assert [got[i] for i in range(len(cases))] == [c[1:] for c in cases]
    rows.write.parquet(str(tmp_path / "pages.parquet"))
    assert {r.page_id for r in registry.QUERIES["board_fingerprints"](spark, str(tmp_path)).collect()} == {*range(len(cases)), *range(-len(labels), 0)}


def test_payloads_of_several_items_and_of_other_fields(spark):
    page = "https://fox.example/x?finder=siteNumber=CX_1,limit=5"
    items = '{"items":[{"requisitionList":[{"Id":7,"Title":"Ops","PrimaryLocation":"Rye"},{"Id":"8","title":"Plant","Location":"Ely"}]},{"requisitionList":null},{"x":1},{"requisitionList":[{"id":"9","Title":"Desk","PostingStartDate":"2024-01-03"},{"Title":"No id"}]}]}'
    eight = '{"positions":[{"name":"A","location":"Bath","locations":["Rye"],"canonicalPositionUrl":"https://e/1","job_url":"https://e/x"},{"name":"B","location":null,"locations":["Hull","York"],"job_url":"https://e/2"},{"name":"C"}]}'
    landed = spark.createDataFrame([("oracle", "Fox", page, items), ("oracle", "None", page, '{"items":[]}'), ("oracle", "Odd", "", '{"items":{"requisitionList":[]}}'), ("eightfold", "Ate", "", eight)], "ats string, company string, url string, body string")
    rows = payloads.normalised(landed).orderBy("source", "ord").collect()
    site = "https://fox.example/hcmUI/CandidateExperience/en/sites/CX_1/job/"
    assert [(r.title, r.location, r.url, r.posted) for r in rows] == [
        ("A", "Bath", "https://e/1", ""), ("B", "Hull, York", "https://e/2", ""), ("C", "", "", ""),
        ("Ops", "Rye", site + "7", ""), ("Plant", "Ely", site + "8", ""), ("Desk", "", site + "9", "2024-01-03"), ("No id", "", "", ""),
    ]
    assert [(r.ats, r.n) for r in payloads.job_counts(landed).orderBy("ats").collect()] == [("eightfold", 3), ("oracle", 4)]
    assert {r.title for r in payloads.normalised(payloads.sample_payloads(spark)).where("source = 'oracle'").collect()} == {"Ops", "Plant"}


def test_closed_notices_anywhere_in_the_page(spark):
    far = "<title>Gas Trader</title><p>" + "plain words " * 900 + "</p>"
    notices = ["Applications are closed", "Job not found", "This posting is closed", "Closed for applications", "This job is no longer on our site", "We couldn't find that job", "This role has been filled", "The vacancy has closed"]
    pages = [far + n for n in notices] + [far + "<script>var m = 'page not found'</script>", far, far + "search results", "<title>Jobs</title>Search results", "<title>Gas Trader</title>Search results", "<title>Jobs</title>" + far + "search results"]
    rows = [(i, f"https://x/{i}", 200, f"https://x/{i}", h, "Gas Trader") for i, h in enumerate(pages)]
    df = spark.createDataFrame(rows, "id long, url string, status int, final_url string, html string, title string")
    got = {r.id: r.live for r in extract.checked_pages(df, "2024-01-31 00:00:00").collect()}
    assert [got[i] for i in range(len(pages))] == [0] * 9 + [1, 1, 0, 1, 1]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("company,title,url\n A , T ,https://x\nB,U,\n")
    assert [(r.company, r.title, r.location) for r in registry_tables.inbox(spark, str(tmp_path / "a.csv")).collect()] == [("A", "T", "")]
    (tmp_path / "b.csv").write_text("Name,category\nAcme,x\n")
    (tmp_path / "c.csv").write_text("Acme,x\n")
    for f in ("b.csv", "c.csv"):
        assert [r.name for r in registry_tables.read_csv_maybe_header(spark, str(tmp_path / f), ["name", "category"]).collect()] == ["Acme"]
    assert settings.load_settings(["# c", "A='1'", "B=2"], {"B": "3"}) == {"A": "1", "B": "3"}
    assert settings.scoring_problems({"sources": {"a": "x"}, "freshness": [[7, 1], [3, 2]]})


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace as N

    from postmill import session

    bare = lambda master: N(conf=N(get=lambda k, d=None: d), sparkContext=N(master=master, applicationId="a", getConf=lambda: N(get=lambda k: None)))
    assert session.scratch_root(bare("local[2]")) == session.scratch_root(bare("local[2]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_root(bare("spark://somewhere:7077"))
    assert session.scratch_root(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir").rstrip("/")


def test_link_rules(spark):
    got = {(r.page_id, r.title, r.url, r.location) for r in extract.jobs_from_links(extract.link_pages(spark), "page_id", url="url").collect()}
    assert got == {
        (-1, "Power Scheduler", "https://e.example/jobs/77", "Hull, UK"), (-1, "Gas Analyst", "https://e.example/vacancies/gas-9", "London"), (-2, "Gas Analyst", "https://e.example/careers/gas-analyst", ""),
        (-2, "Graduate Trader Programme", "https://e.example/jobs/10", ""), (-3, "Quant Researcher", "https://other.example/role/quant-2", ""),
    }


def test_checks_of_job_pages(spark):
    rows = {r.id: r for r in extract.checked_pages(extract.check_pages(spark), "2024-01-31 00:00:00").collect()}
    assert {i: r.live for i, r in rows.items()} == {-1: 1, -2: 0, -3: 1, -4: 0, -5: None, -6: 0, -7: 0, -8: 0, -9: 1, -10: 1, -11: None}
    assert (rows[-1].employer, rows[-1].years_required, rows[-1].agency, rows[-1].anonymous, rows[-1].description) == ("Acme", 5, 1, 0, "Our client wants 5+ years of experience.")
    assert rows[-2].reason == "validThrough in the past" and rows[-2].anonymous == 1 and rows[-3].anonymous == 1 and rows[-6].reason == "http 409" and rows[-11].anonymous == 1


def test_source_states(spark):
    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    seen = [("quiet", day(10))] * 8 + [("thin", day(10))] * 7 + [("drop", day(10))] * 20 + [("drop", day(30))] + [("dip", day(10))] * 20 + [("dip", day(30))] * 2 + [("new", day(30))]
    rows = spark.createDataFrame(seen, "source string, at string").selectExpr("source", "to_timestamp(at) as first_seen")
    known = spark.createDataFrame([("quiet", None), ("keyless", "no key"), ("lost", None)], "source string, known string")
    got = {r.source: r.health for r in health.source_health(rows, known, "2024-01-31 00:00:00").collect()}
    assert got == {"quiet": "silent", "thin": "ok", "drop": "falling", "dip": "ok", "new": "ok", "keyless": "no key", "lost": "never seen"}
    assert health.never_seen_group(rows, ("x", "y")).count() == 1 and health.never_seen_group(rows, ("x", "new")).count() == 0


def test_rule_files_become_rules(spark):
    scoring = {
        "title_tiers": {"core": {"points": 30, "patterns": ["trader"]}}, "seniority": {"junior_markers": 35, "no_marker": 3, "years_cap": 2, "over_cap_penalty": -40, "phd_required": -50}, "firm_categories": {"bank": 5},
        "firm_role_bonus": {"bank": {"points": 22, "patterns": ["risk"]}}, "description_signals": {"sql": {"points": 6, "patterns": ["sql"]}}, "source_weights": {"html": 7}, "geography": {"uk_confirmed": 10, "outside_uk": -50, "not_stated": -8},
        "freshness": [[7, 8], [21, 4]], "verification": {"live": 15, "ghost_repost": -15}, "min_jd_chars": 10,
    }
    places = {"uk_markers": ["london"], "location_exclude_cities": ["paris"], "location_exclude_regions": ["texas"], "include": ["trader"], "exclude": ["senior"], "role_words": ["analyst"], "domain_words": ["gas"], "locations": ["london"]}
    r = settings.rubric_of(settings.load_rules(str(scoring).replace("'", '"')), places, junior=("junior",))
    assert (r.years_cap, r.over_cap, r.per_year_over, r.phd, r.live, r.ghost, r.dead) == (2, -40, -5, {"required": -50, "preferred": -12}, 15, -15, -100)
    df = spark.createDataFrame([("Junior Trader, Risk", "much sql here", "London", "html", "bank", None)], "title string, description string, location string, source string, category string, checked_at string")
    assert score.scored(df, r, F.lit("2024-01-31")).first().score == 30 + 35 + 5 + 22 + 6 + 10 + 7 - 5
    rules = settings.collection_of(places)
    got = df.select(rules.verdict(F.lit("Gas Analyst"), F.lit("London")), rules.verdict(F.lit("Senior Trader"), F.lit("")), rules.verdict(F.lit("Trader"), F.lit("Paris"))).first()
    assert tuple(got) == (None, "excluded word", "location")
    assert settings.scoring_problems({"source_weights": {"a": "x"}})


def test_malformed_bytes_are_replaced(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes(b"name,category,domain\nSoci\xe9t\xe9,fund,s.example\nGr\xc3\xb6\xc3\x9fe,fund,\n")
    got = [(r["name"], r.domain) for r in registry_tables.read_csv(spark, str(tmp_path / "f.csv"), ["name", "category", "domain"]).collect()]
    assert got == [("Soci\ufffdt\ufffd", "s.example"), ("Gr\u00f6\u00dfe", "")]
