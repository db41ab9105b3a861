"""The firm registry: readers and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.text import norm


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with a header: every column a trimmed string, missing values empty; malformed bytes are replaced."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").option("mode", "PERMISSIVE").csv(path)
    return raw.select(*[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) if c in raw.columns else F.lit("").alias(c) for c in columns])


def read_csv_maybe_header(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV that may lack its header: a row that names the first column is one."""
    raw = spark.read.option("header", False).csv(path)
    got = raw.columns
    rows = raw.select(*[F.trim(F.coalesce(F.col(got[i]), F.lit(""))).alias(c) if i < len(got) else F.lit("").alias(c) for i, c in enumerate(columns)])
    return rows.where(F.lower(columns[0]) != columns[0].lower())


def inbox(spark: SparkSession, path: str) -> DataFrame:
    """Posting CSVs of a drop folder, salaries where the files have them; rows without a URL are left out."""
    return read_csv(spark, path, ["company", "title", "location", "url", "source", "posted", "salary_min", "salary_max", "currency", "salary_text"]).where("url <> ''")


def categories(registry: DataFrame, seq: str = "seq") -> DataFrame:
    """(firm, category): the last row of each normalised name wins."""
    return registry.groupBy(norm("name").alias("firm")).agg(F.max_by("category", seq).alias("category"))


def unanswered(todo: DataFrame, done: DataFrame, name: str = "name") -> DataFrame:
    """Rows whose name has no answer yet, whatever case and accents: names are compared under a collation, in the JVM."""
    key = lambda: F.collate(F.trim(F.col(name)), "UNICODE_CI_AI")
    return todo.withColumn("__k", key()).join(done.select(key().alias("__k")).distinct(), "__k", "left_anti").drop("__k")


def shared_domains(registry: DataFrame) -> DataFrame:
    """Domains that more than one name claims; blank ones never collide."""
    return registry.where("trim(domain) <> ''").groupBy(F.lower("domain").alias("domain")).agg(F.count("*").alias("n"), F.countDistinct("name").alias("names")).where("names > 1")


def repeated_names(registry: DataFrame) -> DataFrame:
    """(name, n): names that stand more than once, whatever the case."""
    return registry.where("trim(name) <> ''").groupBy(F.lower(F.trim("name")).alias("name")).agg(F.count("*").alias("n")).where("n > 1")


def blanked(registry: DataFrame, bad: DataFrame, column: str = "domain") -> DataFrame:
    """The registry with one column emptied for the names of ``bad``."""
    flagged = bad.select("name").distinct().withColumn("__bad", F.lit(True))
    return registry.join(flagged, "name", "left").withColumn(column, F.when(F.col("__bad"), "").otherwise(F.col(column))).drop("__bad")


def carried(new: DataFrame, previous: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New answers, and the previous one wherever there is no new one."""
    p = previous.select(key, *[F.col(c).alias(f"__p_{c}") for c in columns])
    return new.select(key, *columns).join(p, key, "full").select(key, *[F.coalesce(c, f"__p_{c}").alias(c) for c in columns])


def write_verdicts(checked: DataFrame, path: str) -> None:
    """Firm checks as CSV, sorted by verdict and name."""
    checked.select("name", "domain", "verdict", "detail", "final_url", "misses").orderBy("verdict", "name").write.mode("overwrite").option("header", True).csv(path)
