"""A training corpus from the documents table, in five stages.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; it is written as Parquet and read again
as the next one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import decontaminate, neardup, pieces, quality, secrets
from postmill.session import materialise
from postmill.sources.tables import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model doesn't reject (score of 0.3 or more), as they are, repeated rows too.

    Null and empty texts are scored like any other. Columns named like the model's own are the input's in the result.
    """
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    kept = quality.score_quality(own, model, threshold=0.3, text_col=f"c{docs.columns.index('text')}").where("predicted = 1")
    return kept.select(*own.columns).toDF(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more): the smallest id.

    Rows that repeat a kept id with another text stay; of those that repeat id and text the least of the other columns
    stays. Null ids stay, and so do null and empty texts, which are copies of nothing.
    """
    found = neardup.near_duplicates(docs, words_each=5, percent=80, buckets=128)
    kept = found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("__rows"))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    once = docs.join(kept.where("__rows = 1"), "doc_id", "left_semi")
    again = docs.join(kept.where("__rows > 1"), "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("__rest")).select("doc_id", "text", "__rest.*")
    return docs.where("doc_id is null").unionByName(once).unionByName(again).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, as they are; null and empty texts hold none, and repeated rows stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its secrets replaced by a mask; n_chars follows the text. Null texts stay null, empty ones empty."""
    clean = secrets.redact_secrets(docs, secrets.train_markov(docs, table(spark, sf_dir, "labels")))
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's SentencePiece ids and whether they decode to its text; null and empty texts have none, and do."""
    encoded = pieces.encode_documents(docs.select("doc_id", "text", "lang", "source"), pieces.load_vocabulary(), verify=True)
    return encoded.select("doc_id", "lang", "source", F.size("ids").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("SentencePiece encoding", encoding_stage),
]

#: No stage of these can be told in SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, _ = materialise(docs, "stage")
    return docs
