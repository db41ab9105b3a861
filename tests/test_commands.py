import json

from postmill.__main__ import main
from postmill.operators.score import Rubric
from postmill.plans import ranking

POSTING = "id string, company string, title string, location string, url string, source string, posted string, first_seen string, status string"


def test_ranking_from_end_to_end(spark):
    seen = lambda i, title, first="2024-01-30", status="new", company="Acme": (i, company, title, "Leeds", f"https://x.example/{i}", "html", "", first, status)
    rows = [seen("a", "Gas Trader"), seen("b", "Gas Trader II"), seen("c", "Clerk", company="Beta"), seen("d", "Trader", status="applied"), seen("e", "Dead Trader"), seen("f", "Old Trader", "2023-06-01"), seen("g", "Years Trader")]
    rows += [seen(f"r{k}", "Ghost Trader", f"2023-{m}-01", company="Haunt") for k, m in enumerate(("08", "10", "12"))]
    text = "we trade gas in great detail " * 20
    checks = [("a", "2024-01-30", 1, text, None), ("b", "2024-01-30", 1, text, None), ("e", "2024-01-30", 0, "x", None), ("g", "2024-01-30", 1, "y", 9)]
    rubric = Rubric(tiers=[("core", 30, ["trader"])], sources={"html": 5}, unverified=0, ghost=-25)
    args = (spark.createDataFrame(rows, POSTING), spark.createDataFrame(checks, "id string, checked_at string, live int, description string, years_required int"), spark.createDataFrame([("acme", "fund")], "firm string, category string"), rubric, "2024-01-31")
    digest, kept, cuts = ranking.rank_postings(*args, ranking.Digest(top=3, threshold=40, per_firm=1, max_years=6))
    assert {r.cut: r.n for r in cuts.collect()} == {">6y experience": 1}
    score = {r.id: r.score for r in kept.collect()}
    assert score == {"a": 45, "c": 5, "f": 35, "r0": 10, "r1": 10, "r2": 10}  # b repeats a's text, d has a status, e is dead, g asks for too much
    assert [(r.id, r.section) for r in digest.collect()] == [("a", "shortlist"), ("f", "rest"), ("r0", "rest"), ("r1", "rest")]
    fresh = ranking.Digest(since="2024-01-01", max_years=6)
    assert {r.id for r in ranking.rank_postings(*args, fresh)[1].collect()} == {"a", "c"}
    topped = ranking.rank_postings(*args, ranking.Digest(since="2024-01-01", backfill_to=50, max_years=6))[1].collect()
    assert {r.id for r in topped if r.carried_over} == {"f", "r0", "r1", "r2"} and len(topped) == 6


def test_commands(spark, tmp_path, capsys):
    at = lambda n: str(tmp_path / n)
    (tmp_path / "inbox").mkdir()
    (tmp_path / "inbox" / "a.csv").write_text("company,title,location,url,source,posted\nAcme,Gas Trader,London,https://x.example/1,html,2024-01-30\nAcme,Cook,London,https://x.example/2,html,\nBeta,Trader,,https://x.example/3,html,\n")
    (tmp_path / "scoring.json").write_text(json.dumps({"title_tiers": {"core": {"points": 50, "patterns": ["trader"]}}, "source_weights": {"html": 5}, "report": {"shortlist_threshold": 40, "top_n": 10}}))
    (tmp_path / "collection.json").write_text(json.dumps({"include": ["trader"], "exclude": ["senior"], "role_words": ["analyst"], "domain_words": ["gas"]}))
    (tmp_path / "firms.csv").write_text("name,category,domain\nAcme,fund,acme.example\nAcme Two,fund,ACME.example\n")
    run = lambda *a: main([*a, "--as-of", "2024-01-31 00:00:00"], spark)
    assert run("validate", "--scoring", at("scoring.json"), "--collection", at("collection.json"), "--registry", at("firms.csv")) == 1 and "acme.example" in capsys.readouterr().out
    assert run("validate", "--scoring", at("scoring.json"), "--collection", at("collection.json"), "--keep", "Gas Trader", "--drop", "Cook") == 0
    (tmp_path / "bad.csv").write_text("name,domain\nAcme,a.example\nACME ,b.example\n")
    assert run("validate", "--registry", at("bad.csv")) == 2
    told = capsys.readouterr().out
    assert "lacks the column category" in told and "name acme stands 2 times" in told
    (tmp_path / "rules.json").write_text(json.dumps({"include": ["trad", "("], "exclude": [r"(\w+)+x"]}))
    assert run("validate", "--collection", at("rules.json")) == 2 and "may take very long" in capsys.readouterr().out
    assert run("ingest", "--inbox", at("inbox"), "--sightings", at("seen"), "--collection", at("collection.json")) == 0
    assert sorted(r.title for r in spark.read.parquet(at("seen")).collect()) == ["Gas Trader", "Trader"]
    assert run("track", "applied", "beta", "--sightings", at("seen"), "--statuses", at("statuses")) == 0
    rank = ("rank", "--sightings", at("seen"), "--scoring", at("scoring.json"), "--collection", at("collection.json"), "--statuses", at("statuses"), "--runs", at("runs"), "--out", at("out"), "--record")
    assert run(*rank, "--failed-stages", "5") == 0 and not (tmp_path / "runs").exists()
    assert run(*rank) == 0 and spark.read.parquet(at("runs")).count() == 1
    assert [(r.title, r.section) for r in spark.read.parquet(at("out/digest")).collect()] == [("Gas Trader", "shortlist")]
    assert run("apply-list", "--scored", at("out/scored"), "--out", at("apply")) == 0
    assert [r.title for r in spark.read.option("header", True).csv(at("apply")).collect()] == ["Gas Trader"]
    assert run("insights", "--sightings", at("seen")) == 0 and run("track", "stats", "--sightings", at("seen"), "--statuses", at("statuses")) == 0


def test_fold_seniority_and_doctorate_change_scores(spark, tmp_path, capsys):
    at = lambda n: str(tmp_path / n)
    run = lambda when, *a: main([*a, "--as-of", when], spark)
    head = "company,title,location,url,source,posted,salary_text\n"
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.csv").write_text(head + "Acme,Gas Trader,London,https://x.example/reed,reed,,\nAcme,Junior Trading Manager,London,https://x.example/2,html,,\nAcme,Trading Manager,London,https://x.example/3,html,,\nBeta,<b>Gas Trader</b>,London,https://x.example/4,html,,\n,Trader,London,https://x.example/5,html,,\nGamma,Cook,London,https://x.example/6,html,,\n")
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "b.csv").write_text(head + 'Acme,Gas Trader,London,https://x.example/own,greenhouse,,"£40,000 to £50,000"\nAcme,Gas Trader,London,https://x.example/late,indeed,,"£90,000"\n')
    (tmp_path / "scoring.json").write_text(json.dumps({
        "title_tiers": {"core": {"points": 50, "patterns": ["trad"]}}, "seniority": {"junior_markers": 35, "no_marker": 3, "phd_required": -45, "phd_preferred": -12},
        "source_weights": {"greenhouse": 9, "reed": 1, "html": 5}, "verification": {"unverified": 0, "live": 0}, "min_jd_chars": 20, "report": {"shortlist_threshold": 10, "top_n": 10},
    }))
    (tmp_path / "collection.json").write_text(json.dumps({"include": ["trad"], "exclude": ["manager", "senior"]}))
    assert run("2024-01-10 00:00:00", "ingest", "--inbox", at("one"), "--sightings", at("seen"), "--collection", at("collection.json")) == 0
    told = capsys.readouterr().out.split("\n")
    assert {"raw: 6", "matched: 3", "new: 3", "excluded word: 1", "no company: 1", "no match: 1"} <= set(told)
    assert run("2024-01-20 00:00:00", "ingest", "--inbox", at("two"), "--sightings", at("seen"), "--collection", at("collection.json")) == 0
    assert {"raw: 2", "matched: 2", "new: 0"} <= set(capsys.readouterr().out.split("\n"))
    state = {r.title: r for r in ranking.state_of(spark.read.parquet(at("seen"))).where("company = 'Acme'").collect()}
    gas = state["Gas Trader"]
    assert (gas.source, gas.url, gas.seen_count, gas.first_seen, gas.salary_min, gas.currency) == ("greenhouse", "https://x.example/own", 3, "2024-01-10 00:00:00", 90000.0, "GBP")  # of one batch the link that comes first in order
    asks = [(r.id, "2024-01-21", 1, text) for r, text in ((gas, "You hold a PhD in physics or maths."), (state["Junior Trading Manager"], "A doctorate is a plus for this role."))]
    spark.createDataFrame(asks, "id string, checked_at string, live int, description string").write.parquet(at("checks"))
    assert run("2024-01-31 00:00:00", "rank", "--sightings", at("seen"), "--scoring", at("scoring.json"), "--collection", at("collection.json"), "--checks", at("checks"), "--out", at("out")) == 0
    got = {(r.company, r.title): (r.score, r.why) for r in spark.read.parquet(at("out/digest")).collect()}
    assert got[("Acme", "Gas Trader")][0] == 50 + 3 - 45 + 9 and "no seniority marker+3" in got[("Acme", "Gas Trader")][1]
    assert got[("Acme", "Junior Trading Manager")][0] == 50 + 35 - 12 + 5  # the junior marker keeps a manager in
    assert got[("Beta", "Gas Trader")][0] == 50 + 3 + 5  # markup goes before the checks


def test_cuts_name_their_first_rows(spark):
    rows = [(str(i), f"firm {i % 3}", f"title {i:02d}", "", "", "", None, "2024-01-01", 9 if i % 2 else None) for i in range(40)]
    posts = spark.createDataFrame([r[:4] + ("", "", None, r[7]) for r in rows], "id string, company string, title string, location string, url string, source string, posted string, first_seen string")
    checks = spark.createDataFrame([(r[0], "2024-01-02", 1, r[8]) for r in rows], "id string, checked_at string, live int, years_required int")
    cuts = ranking.rank_postings(posts, checks, None, Rubric(), "2024-01-31", ranking.Digest(max_years=4))[2].collect()
    assert [(r.cut, r.n, len(r.first)) for r in cuts] == [(">4y experience", 20, 12)]
    assert [(x.company, x.title) for x in cuts[0].first] == sorted((r[1], r[2]) for r in rows if r[8])[:12]
