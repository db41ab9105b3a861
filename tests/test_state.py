"""The bucketed fold and the segmented scan: batches in any order, hot keys, equal results."""

import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from postmill.operators import fold, state
from postmill.operators.scan import Scan

RANKS = {"board": 9, "agency": 4, "feed": 4, "mail": 1}


def replay(rows):
    """The fold, one sighting after the other."""
    out = {}
    for key, seq, source, url, lo, place in sorted(rows, key=lambda r: r[1]):
        rank = RANKS.get(source, 0)
        if key not in out:
            out[key] = {"place": place, "source": source, "url": url, "rank": rank, "lo": lo, "n": 1}
            continue
        s = out[key]
        s["n"] += 1
        if rank > s["rank"]:
            s["rank"], s["source"] = rank, source
            s["url"] = url or s["url"]
        if s["lo"] is None:
            s["lo"] = lo
    return {k: (s["place"], s["source"], s["url"] or "", s["lo"], s["n"]) for k, s in out.items()}


def made(n, keys, seed):
    rnd = random.Random(seed)
    seqs = rnd.sample(range(10 * n), n)
    key = lambda: "hot" if rnd.random() < 0.4 else f"k{rnd.randrange(keys)}"
    return [(key(), s, rnd.choice([*RANKS, None, "other"]), rnd.choice(["", None, f"u{s}"]), rnd.choice([None, None, float(s)]), f"p{s}") for s in seqs]


def fold_of():
    rank = F.coalesce(*[F.when(F.col("source") == k, F.lit(v)) for k, v in RANKS.items()])
    return state.Fold(("key",), "seq", rank, ("place",), salary=("lo",))


SCHEMA = "key string, seq long, source string, url string, lo double, place string"


def rows_of(df):
    return {r["key"]: (r["place"], r["source"], r["url"] or "", r["lo"], r["seen_count"]) for r in df.collect()}


def test_fold_equals_replay(spark):
    rows = made(3000, 200, 1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = rows_of(fold.upsert_fold(df, ["key"], "seq", fold_of().rank, ["place"], salary=["lo"]))
    assert got == replay(rows)


@pytest.mark.parametrize("seed", [2, 3])
def test_batches_in_any_order_give_one_fold(spark, tmp_path, seed):
    rows = made(1200, 150, seed)
    rnd = random.Random(seed)
    kept = state.BucketedState(spark, str(tmp_path / "state"), fold_of(), buckets=8)
    parts = [[] for _ in range(4)]
    for r in rows:
        parts[rnd.randrange(4)].append(r)
    for batch, part in enumerate(parts):
        kept.apply(spark.createDataFrame(part, SCHEMA), batch)
    assert rows_of(kept.read()) == replay(rows)
    assert kept.apply(spark.createDataFrame(parts[3], SCHEMA), 3) == []  # a batch counts once
    assert rows_of(kept.read()) == replay(rows)


def test_untouched_buckets_stay(spark, tmp_path):
    path = str(tmp_path / "state")
    kept = state.BucketedState(spark, path, fold_of(), buckets=16)
    rows = made(400, 100, 4)
    kept.apply(spark.createDataFrame(rows, SCHEMA), 0)
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before = files()
    new = [("k1", 5000, "board", "new", None, "p"), ("k2", 5001, "board", "new", None, "p")]
    touched = kept.apply(spark.createDataFrame(new, SCHEMA), 1)
    after = files()
    assert 1 <= len(touched) <= 2
    of = lambda name: int(name.split("bucket=")[1].split("/")[0])
    assert {f for f in before if of(f) not in touched} == {f for f in after if of(f) not in touched}
    assert all(before[f] == after[f] for f in before if of(f) not in touched)
    assert not {f for f in before if of(f) in touched} & set(after)
    assert rows_of(kept.read()) == replay(rows + new)


def test_interrupted_batch_is_applied_once(spark, tmp_path):
    kept = state.BucketedState(spark, str(tmp_path / "state"), fold_of(), buckets=8)
    rows, more = made(300, 60, 5), [(k, s + 100_000, *r) for k, s, *r in made(300, 60, 6)]
    kept.apply(spark.createDataFrame(rows, SCHEMA), 0)
    half = spark.createDataFrame(more, SCHEMA).where(kept._bucket() < 4)
    kept.apply(half, 1)  # as if the driver had died after some buckets
    kept.apply(spark.createDataFrame(more, SCHEMA), 1)
    assert rows_of(kept.read()) == replay(rows + more)


def test_empty_batch(spark, tmp_path):
    kept = state.BucketedState(spark, str(tmp_path / "state"), fold_of(), buckets=4)
    kept.apply(spark.createDataFrame([("a", 1, "mail", "u", None, "p")], SCHEMA), 0)
    assert kept.apply(spark.createDataFrame([], SCHEMA), 1) == []
    assert rows_of(kept.read()) == {"a": ("p", "mail", "u", None, 1)}


def test_scan_spreads_a_hot_key(spark):
    rnd = random.Random(7)
    rows = [(None if rnd.random() < 0.05 else "hot" if rnd.random() < 0.5 else f"k{rnd.randrange(40)}", i, rnd.choice([None, *range(-5, 30)])) for i in range(4000)]
    df = spark.createDataFrame(rows, "key string, at long, v long").repartition(5)
    scan = Scan(df, "key", "at", ranges=6).sum("total", F.col("v")).max("top", F.col("v")).sum("n", F.lit(1))
    spread = scan.rows.where("key = 'hot'").groupBy("__range").count().collect()
    assert len(spread) > 1 and max(r["count"] for r in spread) < 1500
    w = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("key", "at", F.sum("v").over(w).alias("total"), F.max("v").over(w).alias("top"), F.count("*").over(w).alias("n"))
    every = lambda d: sorted((str(r.key), r.at, r.total, r.top, r.n) for r in d.select("key", "at", "total", "top", "n").collect())
    assert every(scan.done()) == every(want)
    assert Scan(df.limit(0), "key", "at").sum("n", F.lit(1)).done().count() == 0


def test_streaks_and_start_times(spark):
    rnd = random.Random(8)
    rows = [("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(9)}", i, rnd.random() < 0.6, i * 100 + rnd.randrange(400)) for i in range(1500)]
    df = spark.createDataFrame(rows, "host string, at long, ok boolean, arrival long").repartition(3)
    streaks, last, want_streak, want_start = {}, {}, {}, {}
    for h, i, ok, arrival in rows:
        streaks[h] = 0 if ok else streaks.get(h, 0) + 1
        last[h] = max(arrival, last[h] + 350) if h in last else arrival
        want_streak[i], want_start[i] = streaks[h], last[h]
    assert {r["at"]: r["misses"] for r in fold.miss_streaks(df, "host", "at", ~F.col("ok")).collect()} == want_streak
    assert {r["at"]: r["start_ms"] for r in fold.throttled(df, "host", F.col("arrival"), ["at"], 350).collect()} == want_start


@pytest.mark.parametrize("few,accuracy", [(1 << 17, 1000), (20, 50), (5, 4)])
def test_percentiles_by_position(spark, few, accuracy):
    from postmill.operators import health

    rnd = random.Random(9)
    draw = lambda g: 7.0 if g == "same" or rnd.random() < 0.3 else rnd.choice([rnd.gauss(0, 9), float(rnd.randrange(5))])
    rows = [(g, draw(g)) for g in rnd.choices(["a", "b", "same", None], [6, 2, 1, 1], k=1500)] + [("one", 1.5), ("two", 1.0), ("two", 2.0), ("nulls", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    groups = {}
    for g, x in rows:
        if x is not None:
            groups.setdefault(g, []).append(x)
    got = {r.g: (r.n, r.lo, r.hi, r.p0, r.p25, r.p50, r.p99, r.p100) for r in health.index_percentiles(df, "v", (0.0, 0.25, 0.5, 0.99, 1.0), ["g"], accuracy, few).collect()}
    at = lambda xs, p: sorted(xs)[min(len(xs) - 1, int(len(xs) * p))]
    assert got == {g: (len(xs), min(xs), max(xs), *(at(xs, p) for p in (0.0, 0.25, 0.5, 0.99, 1.0))) for g, xs in groups.items()}
    every = [x for xs in groups.values() for x in xs]
    r = health.index_percentiles(df, "v", (0.5,), (), accuracy, few).first()
    assert (r.n, r.p50) == (len(every), at(every, 0.5))
    assert health.index_percentiles(df.where("false"), "v", (0.5,), ["g"]).count() == 0
