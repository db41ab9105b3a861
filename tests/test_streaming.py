from pyspark.sql import functions as F

from postmill.plans import report
from postmill.streaming import ingest


def test_inbox_stream_filters_once(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    head = "company,title,location,url,source,posted\n"
    (box / "1.csv").write_text(head + "A,Trader,,https://x/1,s,\nA,Chef,,https://x/2,s,\nA,Trader,,,s,\n")
    why = F.when(~F.contains(F.lower("title"), F.lit("trader")), "no match")
    run = lambda: ingest.ingest(ingest.inbox_stream(spark, str(box)), why, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    run()
    (box / "2.csv").write_text(head + "B,Gas Trader,,https://x/3,s,\n")
    run()
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["https://x/1", "https://x/3"]


def test_running_state(spark, tmp_path):
    src = tmp_path / "in"
    schema = "seq long, company string, title string, source string, url string"
    rows = [(1, "A", "T", "weak", "u1"), (2, "A", "T2", "strong", ""), (3, "A", "T3", "strong", "u3"), (4, "B", "T", "weak", "")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(schema).parquet(str(src))
    q = ingest.running_state(stream, F.col("company"), F.when(F.col("source") == "strong", 2).otherwise(1)).writeStream.format("memory").queryName("state_now").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = {r.id: r for r in spark.table("state_now").collect()}
    assert (got["A"].source, got["A"].url, got["A"].title, got["A"].seen_count) == ("strong", "u1", "T", 3) and got["B"].seen_count == 1


def test_reports_escape(spark):
    rows = spark.createDataFrame([(5, "A&B", "<script>", "javascript:x", "w")], "score int, company string, title string, url string, why string").collect()
    page = report.html_report(rows, "d")
    assert "<script>" not in page and "javascript" not in page and "A&amp;B" in page
    assert "A&B" in report.markdown_report(rows, "d")


def test_snapshots_rotate(spark, tmp_path):
    for i in range(4):
        report.snapshot(spark.range(1), str(tmp_path / "s"), f"{i}", keep=2)
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == ["postings-2", "postings-3"]


def test_late_sightings_give_the_batch_fold(spark, tmp_path):
    import random

    from postmill.operators import fold, state

    rnd = random.Random(1)
    rows = [(rnd.choice("abcd"), i, rnd.choice(["weak", "strong", None]), rnd.choice(["", f"u{i}"]), rnd.choice([None, float(i)])) for i in range(120)]
    schema = "id string, seq long, source string, url string, lo double"
    rank = F.when(F.col("source") == "strong", 2).when(F.col("source") == "weak", 1)
    rnd.shuffle(rows)
    f = state.Fold(("id",), "seq", rank, salary=("lo",))
    kept = state.BucketedState(spark, str(tmp_path / "state"), f, buckets=4)
    for part in range(3):
        spark.createDataFrame(rows[part * 40:part * 40 + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = ingest.folded(stream, kept, str(tmp_path / "cp"))
        assert q.awaitTermination(90) and q.exception() is None
    want = fold.upsert_fold(spark.createDataFrame(rows, schema), ["id"], "seq", rank, [], salary=["lo"])
    plain = lambda df: sorted((r.id, r.source, r.url, r.lo, r.seen_count) for r in df.collect())
    assert plain(kept.read()) == plain(want)
