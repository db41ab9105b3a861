"""Components and registry additions against plain loops."""

import random

from pyspark.sql import functions as F

from postmill.operators import fold
from postmill.operators.components import components
from postmill.sources import registry_tables


def judge(existing, rows):
    names, domains, out = {n.strip().lower() for n, _ in existing}, {d.strip().lower() for _, d in existing if d.strip()}, {}
    for seq, name, domain in sorted(rows):
        n, d = (name or "").strip().lower(), (domain or "").strip().lower()
        out[seq] = "no name" if not n else "name taken" if n in names else "domain taken" if d in domains else "accepted"
        if out[seq] == "accepted":
            names.add(n)
            domains |= {d} - {""}
    return out


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + rnd.randrange(200)) for _ in range(300)] + [(5000, 5000), (None, 1), (7, None)] + [(rnd.randrange(6000, 6400), rnd.randrange(6000, 6400)) for _ in range(150)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and v is not None:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_long_chain_of_candidates(spark):
    """Each candidate shares its name with the one before and its domain with the one after: every verdict waits for the last."""
    rows = [(i, f"n{(i + 1) // 2}", f"d{i // 2}.example") for i in range(3000)]
    existing = [("Acme", "acme.example")]
    df = spark.createDataFrame([(s, n, "x", d) for s, n, d in rows], "seq long, name string, category string, domain string").repartition(4)
    got = {r.seq: r.verdict for r in fold.accept_new(spark.createDataFrame(existing, "name string, domain string"), df).collect()}
    assert got == judge(existing, rows)


def test_random_candidates(spark):
    rnd = random.Random(2)
    pick = lambda p, n: rnd.choice(["", " ", None, f"{p}{rnd.randrange(n)}", f" {p.upper()}{rnd.randrange(n)} ", f"{p}0"])
    rows = [(i, pick("n", 60), pick("d", 60)) for i in range(500)]
    existing = [("N1", "d2"), ("n3", "")]
    df = spark.createDataFrame([(s, n, "x", d) for s, n, d in rows], "seq long, name string, category string, domain string")
    got = {r.seq: r.verdict for r in fold.accept_new(spark.createDataFrame(existing, "name string, domain string"), df).collect()}
    assert got == judge(existing, rows)


def test_names_meet_whatever_their_accents(spark):
    todo = spark.createDataFrame([("Société Générale",), ("NEW firm",), (" Zürich Re ",)], "name string")
    done = spark.createDataFrame([("SOCIETE generale",), ("zurich re",), ("zurich re",)], "name string")
    left = registry_tables.unanswered(todo, done)
    assert [r.name for r in left.collect()] == ["NEW firm"]
    assert "Python" not in left._jdf.queryExecution().executedPlan().toString()
