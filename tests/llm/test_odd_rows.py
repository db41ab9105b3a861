"""Every operator over documents on nulls, empty and very long texts, repeated rows, clashing columns and empty tables."""

import pytest

from postmill.llm import decontaminate, language, pieces, pii, quality, secrets, sharding, toxicity
from postmill.llm.neardup import near_duplicates

LONG = " ".join(f"word{i % 977} and{i}" for i in range(60_000))
ITEM = "a benchmark item about rivers and their bridges in winter"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "plain words of a plain text", "en"), (1, "plain words of a plain text", "en"), (2, None, "en"), (2, None, "en"), (3, "", None), (4, LONG, "en"), (4, LONG, "en"), (5, " ​ \n\t", "de"), (None, "no id here", "de"), (6, LONG + " " + ITEM, None)]
    clash = ("score", "predicted", "held_out", "spans", "matches", "ids", "key", "node", "shard", "size", "item_id", "label", "quality", "toxic", "n", "bin")
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", *[f"'mine' as {c}" for c in clash])


@pytest.fixture(scope="module")
def operators(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (2, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (1, ITEM)], "item_id long, text string")
    vocabulary = pieces.load_vocabulary()
    markov = secrets.fit_markov(secrets.identifiers([]), secrets.random_strings())
    return {
        "toxicity": lambda d: toxicity.toxicity_report(d, labels), "quality": lambda d: quality.quality_report(d, labels), "sharding": sharding.shard_documents, "near duplicates": near_duplicates,
        "language": lambda d: language.identify_language(d, language.train_language(d)), "decontamination": lambda d: decontaminate.contamination(d, bench), "pieces": lambda d: pieces.encode_documents(d, vocabulary, verify=True),
        "personal data": pii.find_personal_data, "secrets": lambda d: secrets.find_secrets(d, markov),
    }


@pytest.mark.parametrize("name", ["toxicity", "quality", "sharding", "near duplicates", "language", "decontamination", "pieces", "personal data", "secrets"])
def test_odd_rows(spark, odd, operators, name):
    got = [r.asDict() for r in operators[name](odd).collect()]
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 1, 1, 2, 2, 3, 4, 4, 5, 6]
    for d in (1, 2, 4):  # repeated rows get the same result, but for the place in a shard
        a, b = ({k: v for k, v in r.items() if k not in ("slot", "kept")} for r in got if r["doc_id"] == d)
        assert a == b
    if name == "decontamination":
        assert {r["doc_id"] for r in got if r["matches"]} == {6}
    if name == "pieces":
        assert all(r["round_trip"] for r in got)
    assert operators[name](odd.limit(0)).count() == 0
