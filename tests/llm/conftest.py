import os

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, with repeated rows, null ids and a clashing extra column on demand."""

    def make(texts, start=0, extra=False):
        rows = [(i + start, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit("x") for c in ("id", "score", "node", "comp", "key", "shard", "spans", "y", "n")})
        return df

    return make
