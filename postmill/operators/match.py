"""TF-IDF matching of documents against one query text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.text import content_terms, present
from postmill.operators.index import byte_cuts, content_runs, text_index
from postmill.session import materialise, narrow_batches


def term_counts(docs: DataFrame, key: str, text: str = "text", stop: tuple[str, ...] = ()) -> DataFrame:
    """(key, term, n, pos): counts and first positions in long form."""
    return docs.select(key, F.posexplode(content_terms(text, stop)).alias("pos", "term")).groupBy(key, "term").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))


def tfidf_cosine(docs: DataFrame, key: str, query: DataFrame, text: str = "text", stop: tuple[str, ...] = ()) -> DataFrame:
    """(key, cosine) of every document that shares a term with the query (one row), idf = ln(1 + n / (1 + df)) over documents and query.

    The texts become an inverted index; the query then reads its own terms' postings and nothing else. ``index.TextIndex`` is for
    many queries, and for the best documents alone.
    """
    found = text_index(docs, key, text, stop).search(query.select(F.lit(0).alias("qid"), F.col(text).alias("text")), "text", stop)
    return found.select(F.col("doc").alias(key), "cosine")


def relative_scores(rows: DataFrame, score: str = "cosine") -> DataFrame:
    """Scores as whole percentages of the largest, half to even; the largest comes from an aggregate, not a one-task window."""
    rows, _ = materialise(rows, "scores")  # read twice: one short row a document
    top = rows.agg(F.max(score).alias("__top"))
    share = 100 * F.col(score) / F.coalesce(F.nullif("__top", F.lit(0.0)), F.lit(1.0))
    return rows.join(F.broadcast(top), how="cross").withColumn("relative", F.bround(share, 0).cast("int")).drop("__top")


def gaps(docs: DataFrame, key: str, query: DataFrame, text: str = "text", top: int = 60, show: int = 8, stop: tuple[str, ...] = ()) -> DataFrame:
    """(key, gaps): the first ``show`` of a document's ``top`` most frequent terms that the query lacks; ties in order of appearance.

    Terms are counted where a document is read, and nothing is shuffled; documents that share a key are counted together, in a
    shuffle.
    """
    q = query.select(F.explode(content_terms(text, stop)).alias("term")).distinct()
    if not _told_apart(docs, key):
        w = Window.partitionBy(key).orderBy(F.desc("n"), "pos")
        best = term_counts(docs, key, text, stop).withColumn("k", F.row_number().over(w)).where(F.col("k") <= top)
        missing = best.join(F.broadcast(q), "term", "left_anti").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", "term"))).alias("m"))
        return missing.select(key, F.array_join(F.slice("m.term", 1, show), " ").alias("gaps"))
    narrow_batches(docs.sparkSession)
    own = _gap_finder([r["term"] for r in q.collect()], top, show, stop)  # one text's terms
    found = docs.select(F.col(key).alias("key"), F.lower(present(text)).alias("text")).mapInArrow(own, f"key {docs.schema[key].dataType.simpleString()}, gaps string")
    return found.withColumnRenamed("key", key)


def _gap_finder(query: list[str], top: int, show: int, stop: tuple[str, ...]):
    """Each document's gaps, a few MB of text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in byte_cuts(batch.column("text"), 2048, 2 << 20):
                part = batch.slice(lo, hi - lo)
                doc, terms = content_runs(part.column("text"))
                coded = terms.dictionary_encode()
                words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                among = lambda few: pc.is_in(words, value_set=pa.array(few, pa.large_string())).to_numpy(zero_copy_only=False)
                kept = ~among(stop)[code] if len(words) else np.zeros(0, bool)
                pair, pos, n = np.unique(doc[kept] * max(1, len(words)) + code[kept], return_index=True, return_counts=True)
                doc, code = pair // max(1, len(words)), pair % max(1, len(words))
                order = np.lexsort((pos, -n, doc))
                doc, code = doc[order], code[order]
                for cut, lacking in ((top, None), (show, ~among(query))):
                    if lacking is not None:
                        doc, code = doc[lacking[code]], code[lacking[code]]
                    first = np.arange(len(doc)) - np.searchsorted(doc, doc) < cut
                    doc, code = doc[first], code[first]
                of = np.unique(doc)
                at = pa.array(np.append(np.searchsorted(doc, of), len(doc)).astype(np.int32))
                shown = pa.ListArray.from_arrays(at, words.cast(pa.string()).take(pa.array(code)))
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(of)), pc.binary_join(shown, " ")], ["key", "gaps"])

    return run


def leading_lines(lines: DataFrame, docs: DataFrame, key: str, top: int = 3, most_bytes: int = 1 << 20) -> DataFrame:
    """The ``top`` lines of a reference text (rows of ``line``, each once) that share most words with each document; ties by line, descending.

    A document's overlaps depend on its own terms alone. So lines of up to ``most_bytes`` in all go to the tasks, which judge a document
    where it is read: nothing is shuffled. Longer reference texts, and documents that share a key, meet the lines in a join, with the same rows.
    """
    size = lines.agg(F.sum(F.octet_length("line"))).first()[0]
    if (size or 0) > most_bytes or not _told_apart(docs, key):
        return _lines_joined(lines, docs, key, top)
    rows = lines.select("line", F.array_distinct(content_terms("line")).alias("terms")).where("size(terms) > 0").collect()
    rows.sort(key=lambda r: r["line"].encode(), reverse=True)
    narrow_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("key"), F.lower(present("text")).alias("text")).mapInArrow(_leader([r["line"] for r in rows], [r["terms"] for r in rows], top), f"key {kind}, line string, overlap long, k int")
    return found.withColumnRenamed("key", key)


def _lines_joined(lines: DataFrame, docs: DataFrame, key: str, top: int) -> DataFrame:
    terms = docs.select(key, F.explode(F.array_distinct(content_terms("text"))).alias("term"))
    of_line = lines.select("line", F.explode(F.array_distinct(content_terms("line"))).alias("term"))
    shared = terms.join(of_line, "term").groupBy(key, "line").agg(F.count("*").alias("overlap"))
    w = Window.partitionBy(key).orderBy(F.desc("overlap"), F.desc("line"))
    return shared.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top)


def _told_apart(docs: DataFrame, key: str) -> bool:
    """Whether no two documents share a key: a pass over the keys alone."""
    return docs.groupBy(key).count().where("count > 1").isEmpty()


def _leader(lines: list[str], terms: list[list[str]], top: int):
    """Each document's leading lines (given in descending order, with their distinct terms), a few MB of text and overlaps at a time."""
    at: dict[str, list[int]] = {}
    for i, own in enumerate(terms):
        for t in own:
            at.setdefault(t, []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, named, n = pa.array(list(at), pa.large_string()), pa.array(lines, pa.string()), len(lines)
        held = np.array([len(x) for x in at.values()], np.int64)
        begin, line_of = np.cumsum(held) - held, np.array([i for x in at.values() for i in x], np.int64)
        rows = max(1, min(2048, (4 << 20) // max(1, len(line_of))))  # no more than 4M overlaps meet
        for batch in batches:
            for lo, hi in byte_cuts(batch.column("text"), rows, 2 << 20) if n else ():
                part = batch.slice(lo, hi - lo)
                doc, found = content_runs(part.column("text"))
                code = pc.index_in(found, value_set=vocabulary)
                known = code.is_valid().to_numpy(zero_copy_only=False)
                pair = np.unique(doc[known] * len(at) + code.drop_null().to_numpy())
                doc, code = pair // len(at), pair % len(at)
                times = held[code]
                place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)  # within a term's lines
                cell, overlap = np.unique(np.repeat(doc, times) * n + line_of[np.repeat(begin[code], times) + place], return_counts=True)
                doc, line = cell // n, cell % n
                order = np.lexsort((line, -overlap, doc))
                doc, line, overlap = doc[order], line[order], overlap[order]
                k = np.arange(len(doc)) - np.searchsorted(doc, doc) + 1
                best = k <= top
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(doc[best])), named.take(pa.array(line[best])), pa.array(overlap[best].astype(np.int64)), pa.array(k[best].astype(np.int32))], ["key", "line", "overlap", "k"])

    return run
