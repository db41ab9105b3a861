"""Every registered query of the engine against its SQL, on the smallest tables."""

import html
import math
import os
import re
import unicodedata

import duckdb
import pytest

from postmill.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v.is_integer() else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(str(plain(r[c])) for c in cols) for r in df.collect())
    res = duck.execute(registry.ORACLE_SQL[name])
    at = [d[0] for d in res.description]
    assert sorted(at) == cols
    assert got == sorted(tuple(str(plain(r[at.index(c)])) for c in cols) for r in res.fetchall())


def test_clean_text_by_plain_steps(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}

    def plain(text):
        t = unicodedata.normalize("NFKC", html.unescape(re.sub("<[^>]+>", " ", text or "")))
        return " ".join("".join(c for c in t if c not in "\u200b\u200c\u200d\u2060\ufeff").split())

    assert {r.doc_id: r.clean for r in registry.QUERIES["clean_text_nfkc"](spark, DATA).collect()} == {d: plain(t) for d, t in texts.items()}


def test_excerpts_by_plain_steps(spark):
    lead, wants, stop, asks = (re.compile(p, re.A | re.I) for p in (r"\babout the role\b[: -]*", r"\brequirements?\s*[:-]\s*", r"\b(?:benefits|how to apply|privacy)\b", r"experience|degree|ability to|\bthe\b"))
    flat = lambda t: re.sub(r"\s+", " ", t, flags=re.A).strip(" ")
    cut_at = lambda t, p: t[:m.start()] if (m := p.search(t)) and m.start() > 60 else t

    def trim(t):
        t = flat(t)
        if len(t) <= 260:
            return t
        parts = re.split(r"(?<=[.!?])\s", t[:260], flags=re.A)
        kept = " ".join(parts[:-1])
        return kept.strip(" ") if len(parts) > 1 and len(kept) > 130 else re.sub("[ ,;:]+$", "", re.sub(r"\s\S*$", "", t[:260], flags=re.A)) + "…"

    def plain(t):
        t = t or ""
        m, w = lead.search(t), wants.search(t)
        asking = [s for s in re.split(r"(?<=[.!?])\s", flat(t), flags=re.A) if asks.search(s)][:3]
        return trim(cut_at(cut_at(t[m.end():] if m else t, stop), wants)), trim(cut_at(t[w.end():], stop)) if w else trim(" ".join(asking)) if asking else ""

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: (r.summary, r.requirements) for r in registry.QUERIES["description_excerpts"](spark, DATA).collect()}
    assert got == {d: plain(t) for d, t in texts.items()}


def test_every_other_query_has_sql():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"clean_text_nfkc", "description_excerpts"}
