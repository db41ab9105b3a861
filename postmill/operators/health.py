"""Source health, hiring velocity, percentiles by index and tallies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.session import materialise


def source_health(seen: DataFrame, expected: DataFrame, as_of: str) -> DataFrame:
    """(source, week, usual, health): every source that was ever seen or is expected, its last 7 days against a quarter of the 28 before.

    An expected source (source, known) that was never seen is what ``known`` says ('not run here', 'no key', 'known
    broken'), or 'never seen'. One that brought 2 or more a week and now none is 'silent'; one that brought 5 or more
    and now less than 0.3 of that is 'falling'.
    """
    now = F.lit(as_of).cast("timestamp")
    ago = lambda d: now - F.make_dt_interval(F.lit(d))
    t = F.col("first_seen")
    counts = seen.groupBy("source").agg(F.count_if(t > ago(7)).alias("week"), (F.count_if((t > ago(35)) & (t <= ago(7))) / 4).alias("usual"))
    week, usual = F.coalesce("week", F.lit(0)), F.coalesce("usual", F.lit(0.0))
    verdict = (
        F.when(F.col("usual").isNull(), F.coalesce("known", F.lit("never seen"))).when((usual >= 2) & (week == 0), "silent")
        .when((usual >= 5) & (week < usual * 0.3), "falling").otherwise("ok")
    )
    return counts.join(expected, "source", "full").select("source", week.alias("week"), F.round(usual, 4).alias("usual"), verdict.alias("health"))


def silent_groups(health: DataFrame, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """Groups of sources that are all silent this week: one line for the group instead of one each."""
    of = F.coalesce(*[F.when(F.col("source").isin(*members), F.lit(g)) for g, members in groups.items()])
    return health.withColumn("grp", of).where("grp is not null").groupBy("grp").agg(F.sum("week").alias("week"), F.sum("usual").alias("usual")).where("week = 0 and usual > 0")


def never_seen_group(seen: DataFrame, members: tuple[str, ...]) -> DataFrame:
    """One row (members, seen = false) if none of a group of sources has ever brought anything."""
    n = seen.agg(F.count_if(F.col("source").isin(*members)).alias("n"))
    return n.where("n = 0").select(F.lit(", ".join(sorted(members))).alias("members"), F.lit(False).alias("seen"))


def velocity(rows: DataFrame, group: Column, at: str, top: int = 18, burst_days: int = 14) -> DataFrame:
    """Busiest groups: rows, days between first and last, and whether hiring looks continuous or like a burst."""
    span = F.floor((F.max(F.unix_timestamp(at)) - F.min(F.unix_timestamp(at))) / 86400)
    agg = rows.groupBy(group.alias("grp")).agg(F.count("*").alias("n"), span.alias("spread"))
    return agg.withColumn("kind", F.when(F.col("spread") > burst_days, "continuous").otherwise("burst")).orderBy(F.desc("n"), F.desc("spread"), "grp").limit(top)


def observed_weeks(rows: DataFrame, at: str) -> DataFrame:
    days = (F.max(F.unix_timestamp(at)) - F.min(F.unix_timestamp(at))) / 86400
    return rows.agg(F.greatest(F.lit(1), F.floor(days / 7)).alias("weeks"))


def index_percentiles(rows: DataFrame, value: str, shares: tuple[float, ...], by: list[str] = (), accuracy: int = 1000, few: int = 1 << 17) -> DataFrame:
    """Elements at position min(n - 1, int(n p)) of the sorted values, by group; null values don't count.

    Neither interpolated nor discrete percentiles. A mergeable quantile sketch brackets each position in one pass; a second
    counts exactly what lies below and inside each bracket, and only values inside are counted one by one and put in order. Brackets
    that hold more than ``few`` rows of several values are narrowed by a sketch of what is inside, and one that a sketch
    got wrong is opened to its group's end, so the result is exact whatever the sketch says (narrowing ends after six
    rounds, each by a twentieth or so). No pass shuffles all values.
    """
    vals = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    v, every = F.col("__v"), range(len(shares))
    ends = [min(1.0, max(0.0, p + d)) for p in shares for d in (-2 / accuracy, 2 / accuracy)]
    first = vals.groupBy(*by).agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.percentile_approx(v, ends, F.lit(accuracy)).alias("q"))
    place = lambda p: F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(p)))
    first = first.select(*by, "n", "lo", "hi", *[c for k, p in enumerate(shares) for c in (place(p).alias(f"t{k}"), F.col("q")[2 * k].alias(f"a{k}"), F.col("q")[2 * k + 1].alias(f"b{k}"))])
    state, _ = materialise(first.where("n > 0"), "brackets")  # a row a group; sketches may differ from run to run
    inside = lambda k: v.between(F.col(f"a{k}"), F.col(f"b{k}"))

    def beside(extra: DataFrame, left: DataFrame = vals) -> DataFrame:
        if not by:
            return left.join(F.broadcast(extra), how="cross")  # one row
        names = {c: f"__{c}" for c in by}
        same = F.lit(True)
        for c in by:
            same = same & left[c].eqNullSafe(F.col(names[c]))
        return left.join(extra.withColumnsRenamed(names), same).drop(*names.values())

    narrowed = 0
    while True:
        counts = beside(state).groupBy(*by).agg(*[c for k in every for c in (F.count_if(v < F.col(f"a{k}")).alias(f"below{k}"), F.count_if(inside(k)).alias(f"in{k}"))])
        state, _ = materialise(beside(counts, state), "brackets")
        early = [F.col(f"t{k}") < F.col(f"below{k}") for k in every]
        late = [F.col(f"t{k}") >= F.col(f"below{k}") + F.col(f"in{k}") for k in every]
        wide = [(F.col(f"in{k}") > few) & (F.col(f"a{k}") < F.col(f"b{k}")) for k in every]
        some = lambda cs: F.coalesce(F.bool_or(reduce(lambda x, y: x | y, cs)), F.lit(False))
        missed, broad = state.agg(some(early + late), some(wide)).first()
        bare = [*by, "n", "lo", "hi", *[f"t{k}" for k in every]]
        if missed:
            state = state.select(*bare, *[c for k in every for c in (F.when(early[k], F.col("lo")).otherwise(F.col(f"a{k}")).alias(f"a{k}"), F.when(late[k], F.col("hi")).otherwise(F.col(f"b{k}")).alias(f"b{k}"))])
        elif broad and narrowed < 6:
            narrowed += 1
            grid = [i / 64 for i in range(65)]
            cuts = beside(beside(state).groupBy(*by).agg(*[F.percentile_approx(F.when(inside(k), v), grid, F.lit(accuracy)).alias(f"q{k}") for k in every]), state)
            slot = lambda k: F.floor((F.col(f"t{k}") - F.col(f"below{k}")) * 64 / F.col(f"in{k}")).cast("int")
            narrow = lambda k, at, old: F.when(wide[k], F.element_at(f"q{k}", F.least(F.greatest(at, F.lit(1)), F.lit(65)))).otherwise(F.col(old)).alias(old)
            state, _ = materialise(cuts.select(*bare, *[c for k in every for c in (narrow(k, slot(k), f"a{k}"), narrow(k, slot(k) + 3, f"b{k}"))]), "brackets")
        else:
            break
    held = beside(state).select(*by, v, F.inline(F.filter(F.array(*[F.when(inside(k), F.struct(F.lit(k).alias("k"), (F.col(f"t{k}") - F.col(f"below{k}")).alias("want"))) for k in every]), lambda x: x.isNotNull())))
    counted = held.groupBy(*by, "k", "want", "__v").agg(F.count("*").alias("c"))
    run = counted.withColumn("upto", F.sum("c").over(Window.partitionBy(*by, "k").orderBy("__v")))
    picked = run.where((F.col("want") < F.col("upto")) & (F.col("want") >= F.col("upto") - F.col("c")))
    found = picked.groupBy(*by).agg(*[F.max(F.when(F.col("k") == k, v)).alias(f"p{round(100 * p)}") for k, p in enumerate(shares)])
    return beside(found, state.select(*by, "n", "lo", "hi"))


def label_tally(rows: DataFrame, labels: str, fetched: Column | None = None) -> DataFrame:
    """(label, n, share): how many rows carry each label; rows without any count as ``none``.

    With ``fetched``, those are told apart: pages that were read without a finding are 'no fingerprint', others 'never fetched'.
    """
    total_rows = rows.agg(F.count("*").alias("total"))
    rest = F.lit("none") if fetched is None else F.when(F.coalesce(fetched, F.lit(False)), "no fingerprint").otherwise("never fetched")
    flat = rows.select(F.explode(F.when(F.size(labels) > 0, F.col(labels)).otherwise(F.array(rest))).alias("label"))
    counts = flat.groupBy("label").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(total_rows), how="cross").select("label", "n", F.round(100 * F.col("n") / F.greatest("total", F.lit(1)), 4).alias("share"))


def funnel(rows: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """(stage, n): each stage's count in one pass."""
    wide = rows.agg(*[F.count_if(c).alias(k) for k, c in stages.items()])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(k).alias("stage"), F.col(k).alias("n")) for k in stages])))


def reason_counts(rows: DataFrame, reason: str) -> DataFrame:
    """Counts by the reason's part before a colon, most frequent first."""
    return rows.where(F.col(reason).isNotNull()).groupBy(F.trim(F.element_at(F.split(reason, ":"), 1)).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")
