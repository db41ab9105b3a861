"""Folding an append-only table of sightings into one row for each key."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.operators import state
from postmill.operators.components import components
from postmill.operators.scan import Scan
from postmill.session import materialise


def upsert_fold(sightings: DataFrame, key: list[str], seq: str, rank: Column, keep_first: list[str], source: str = "source", url: str = "url", salary: list[str] | None = None) -> DataFrame:
    """The state after replaying every key's sightings in the order of ``seq``.

    The first sighting fixes ``keep_first``. A later one of strictly higher source rank than any before replaces
    the source, and the url if it has one. The first sighting whose ``salary[0]`` isn't null gives all salary fields
    (else the first sighting). ``seen_count`` counts them all. Sightings are combined by key and rank before the shuffle,
    so no key is too large for a task.
    """
    f = state.Fold(tuple(key), seq, rank, tuple(keep_first), source, url if url in sightings.columns else None, tuple(salary or ()))
    return state.folded(state.summaries(sightings, f), f)


def latest_per_key(rows: DataFrame, key: list[str], seq: list[str]) -> DataFrame:
    """The row of each key with the largest ``seq``: insert-or-replace as a read of an append-only table."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*seq)).alias("r")).select(*key, *[F.col("r")[c].alias(c) for c in rest])


def first_per_key(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in an explicit order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def with_status(state: DataFrame, changes: DataFrame, key: str = "id", seq: str = "seq", default: str = "new") -> DataFrame:
    """State with the status last set for each id; ``default`` where none was."""
    latest = changes.groupBy(key).agg(F.max_by("status", seq).alias("__s"))
    return state.drop("status").join(latest, key, "left").withColumn("status", F.coalesce("__s", F.lit(default))).drop("__s")


def miss_streaks(rows: DataFrame, key: str, order: str, missed: Column) -> DataFrame:
    """Each row with its run of consecutive misses up to and including it; anything else, a null too, resets the count.

    The run is the row's place in its key less the place of the last row that was no miss: two running values, scanned over
    ranges so that one key may hold most rows.
    """
    scan = Scan(rows.withColumn("__hit", ~F.coalesce(missed, F.lit(False))), key, order).sum("__n", F.lit(1))
    scan = scan.max("__last", F.when(F.col("__hit"), F.col("__n")))
    return scan.done().withColumn("misses", F.col("__n") - F.coalesce("__last", F.lit(0))).drop("__hit", "__n", "__last")


def prune_missing(verdicts: DataFrame, dead_after: int = 3) -> DataFrame:
    """Names to drop: as many consecutive misses, or a single definite 410."""
    gone = F.rlike(F.coalesce(F.col("detail"), F.lit("")), F.lit("(?i)http 410"))
    reason = F.when(gone, "410 gone").when(F.col("misses") >= dead_after, F.concat(F.lit("unreachable "), F.col("misses").cast("string"), F.lit(" runs running")))
    return verdicts.where(F.col("verdict") == "unreachable").withColumn("why", reason).where("why is not null").select("name", "why")


def throttled(rows: DataFrame, key: str, arrival: Column, order: list[str], gap_ms: int = 350) -> DataFrame:
    """Start times when each key's requests keep a least gap: t(i) = max(arrival(i), t(i-1) + gap), in closed form.

    t(i) = i gap + max over j <= i of (arrival(j) - j gap): two running values instead of a recurrence, scanned over ranges so
    that one key may hold most rows.
    """
    scan = Scan(rows.withColumn("__arrival", arrival), key, order).sum("__n", F.lit(1))
    scan = scan.max("__slack", F.col("__arrival") - (F.col("__n") - 1) * gap_ms)
    return scan.done().withColumn("start_ms", (F.col("__n") - 1) * gap_ms + F.col("__slack")).drop("__n", "__slack", "__arrival")


def circuit_breaker(log: DataFrame, key: str = "host", at: str = "at", ok: str = "ok", failures: int = 6, cool_down: float = 900.0) -> DataFrame:
    """The requests a per-host breaker lets through: (host, at, ok, state).

    Six failures in a row open it for ``cool_down`` seconds; while open, requests are skipped and change nothing. The
    state after a request depends on all before it: each host's log passes a small loop in order, batch by batch, with
    three numbers carried from one batch to the next, so no log is held whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, streak, until = object(), 0, float("-inf")
        for batch in batches:
            states = []
            for h, t, good in zip(*(c.to_pylist() for c in batch.columns)):
                if h != host:
                    host, streak, until = h, 0, float("-inf")
                if t < until:
                    states.append("skipped")
                    continue
                streak = 0 if good else streak + 1
                states.append("ok" if good else "failed")
                if streak >= failures:
                    until, streak = t + cool_down, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(states, pa.string())], [key, at, ok, "state"])

    kinds = dict(log.dtypes)
    ordered = log.select(key, at, ok).repartition(key).sortWithinPartitions(key, at, ok)
    return ordered.mapInArrow(run, f"`{key}` {kinds[key]}, `{at}` {kinds[at]}, `{ok}` {kinds[ok]}, state string")


class _Accept:
    """A table function over one component's candidates (seq, n, d) in order: those whose name and domain no accepted one holds."""

    def __init__(self) -> None:
        self.names: set[str] = set()
        self.domains: set[str] = set()

    def eval(self, row):
        n, d = row["n"], row["d"]
        if n not in self.names and d not in self.domains:
            self.names.add(n)
            if d:
                self.domains.add(d)
            yield row["seq"], n


def accept_new(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates (seq, name, category, domain) with a verdict, each judged against the registry and those accepted before it.

    A name or a domain that is taken is refused; a refused candidate claims neither. Blank domains never collide; names and
    domains are the same whatever the case. Whether a candidate is accepted depends on those that share its name or domain, on
    those that share one with them, and so on: the components of that relation. Each component passes a table function in the order of
    ``seq``, which holds the names and domains that it accepted. Components take rounds that grow with the logarithm of the longest
    chain; candidates that repeat a name and domain go in once, and those that the registry refuses not at all.
    """
    key = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    names = existing.select(key("name").alias("n")).distinct().withColumn("name_taken", F.lit(True))
    domains = existing.select(key("domain").alias("d")).where("d <> ''").distinct().withColumn("domain_taken", F.lit(True))
    judged = candidates.select("seq", "name", key("name").alias("n"), key("domain").alias("d")).join(names, "n", "left").join(domains, "d", "left")
    first = F.when(F.col("n") == "", "no name").when(F.col("name_taken"), "name taken").when(F.col("domain_taken"), "domain taken")
    judged, _ = materialise(judged.select("seq", "name", "n", "d", first.alias("verdict")), "judged")
    heads, _ = materialise(judged.where("verdict is null").groupBy("n", "d").agg(F.min("seq").alias("seq")), "heads")
    of_name = F.concat(F.lit("n"), "n")
    edges = heads.select(of_name.alias("u"), F.when(F.col("d") == "", of_name).otherwise(F.concat(F.lit("d"), "d")).alias("v"))
    placed = heads.join(components(edges), of_name == F.col("node")).select("component", "seq", "n", "d")
    accept = F.udtf(_Accept, returnType="by long, n string")
    took = accept(placed.asTable().partitionBy("component").orderBy("seq"))
    final = (
        F.when(F.col("verdict").isin("no name", "name taken"), F.col("verdict")).when(F.col("by") < F.col("seq"), "name taken")
        .when(F.col("verdict").isNull() & (F.col("by") == F.col("seq")), "accepted").otherwise("domain taken")
    )
    return judged.join(took, "n", "left").select("seq", "name", final.alias("verdict"))
