"""Sinks: ranked CSV, HTML and Markdown reports, append-only logs and snapshots with rotation."""

from __future__ import annotations

import html
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from postmill.operators.score import explained
from postmill.session import drop_scratch


def write_scored(rows: DataFrame, path: str, columns: tuple[str, ...] = ("score", "company", "title", "location", "url", "source", "posted")) -> None:
    """The ranking as CSV with the explanation flattened."""
    have = [c for c in columns if c in rows.columns]
    rows.select(*have, explained(F.col("why")).alias("why")).write.mode("overwrite").option("header", True).csv(path)


def append_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def record_run(spark: SparkSession, path: str, ran_at: str, considered: int, kept: int) -> None:
    """One row more in the run log, the delta's watermark."""
    spark.createDataFrame([(ran_at, considered, kept)], "ran_at string, considered long, kept long").write.mode("append").parquet(path)


def last_run(runs: DataFrame) -> str | None:
    return runs.agg(F.max("ran_at").alias("m")).first()["m"]


def html_report(rows: Iterable[Row], title: str) -> str:
    """A table of at most a digest's rows (top-k, collected); every value is escaped."""
    esc = lambda v: html.escape(str("" if v is None else v), quote=True)
    body = []
    for r in rows:
        d = r.asDict()
        link = d.get("url") or ""
        name = f'<a href="{esc(link)}">{esc(d.get("title"))}</a>' if link.startswith(("http://", "https://")) else esc(d.get("title"))
        body.append(f"<tr><td>{esc(d.get('score'))}</td><td>{esc(d.get('company'))}</td><td>{name}</td><td>{esc(d.get('why'))}</td></tr>")
    return f"<!doctype html><meta charset=utf-8><title>{esc(title)}</title><h1>{esc(title)}</h1><table>{''.join(body)}</table>"


def markdown_report(rows: Iterable[Row], title: str) -> str:
    cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {cell(title)}", "", "| score | company | title |", "|-|-|-|"]
    return "\n".join([*lines, *(f"| {cell(r['score'])} | {cell(r['company'])} | {cell(r['title'])} |" for r in rows)])


def link_index(firms: DataFrame, template: str = "https://www.google.com/search?q=") -> DataFrame:
    """(category, links): search links of each category's firms, sorted by name."""
    row = F.struct(F.lower("name").alias("k"), F.col("name"), F.concat(F.lit(template), F.url_encode(F.concat("name", F.lit(" careers")))).alias("url"))
    return firms.groupBy("category").agg(F.array_sort(F.collect_list(row)).alias("l")).select("category", F.transform("l", lambda x: F.struct(x["name"], x["url"])).alias("links")).orderBy("category")


def observed(rows: DataFrame, counts: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """Rows, and how many meet each condition: counted on the plan that some action runs anyway, read by ``get`` after it."""
    watch = Observation()
    return rows.observe(watch, *[F.count_if(c).alias(k) for k, c in counts.items()]), watch


def run_report(new: DataFrame) -> DataFrame:
    """A run's new rows by company; its counts come from ``observed``."""
    return new.orderBy("company", "title")


def snapshot(rows: DataFrame, root: str, stamp: str, keep: int = 5) -> None:
    """A dated copy of the state; only the ``keep`` latest names stay."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{root}/postings-{stamp}")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("postings-"))
    for old in names[:-keep]:
        drop_scratch(spark, f"{root}/{old}")
