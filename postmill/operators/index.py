"""An inverted index over texts: postings by term and block of documents, norms, and block maxima that let a top-k search skip blocks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.text import content_terms, present
from postmill.session import materialise, narrow_batches, scratch_path

_KIND = np.zeros(256, np.uint8)
_KIND[ord("a"):ord("z") + 1] = 1
_KIND[[ord("+"), ord("#")]] = 2
_KIND[ord(".")] = 3


def content_runs(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(text of each term, terms) of lower-case texts: the terms of ``functions.text.content_terms``, a batch at a time."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0]:ends[-1]] if len(texts) and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    kind = _KIND[raw]
    inside = np.concatenate([[False], kind > 0, [False]])
    edge = np.zeros(len(raw) + 1, bool)
    edge[ends] = True
    begin = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    stop = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    letters = np.append(np.flatnonzero(kind == 1), len(raw))
    first = letters[np.searchsorted(letters, begin)]
    long = stop - first >= 3
    first, stop = first[long], stop[long]
    solid = np.flatnonzero((kind > 0) & (kind < 3))
    last = solid[np.searchsorted(solid, stop) - 1] + 1 if len(first) else stop
    step = np.zeros(len(raw) + 1, np.int8)
    step[first] += 1
    step[last] -= 1
    data = raw[np.cumsum(step[:-1]) > 0]
    offsets = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int64)
    terms = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    return np.searchsorted(ends, first, side="right") - 1, terms


def byte_cuts(texts: pa.Array, rows: int, most: int) -> list[tuple[int, int]]:
    """(from, to) of consecutive texts in pieces of at most so many rows and about so many bytes; a longer text alone."""
    cuts, held = [0], 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > cuts[-1] and (held + n > most or i - cuts[-1] >= rows):
            cuts.append(i)
            held = 0
        held += n
    return list(zip(cuts, [*cuts[1:], len(texts)])) if len(texts) else []


def _poster(stop: tuple[str, ...], block_rows: int, block_bytes: int):
    """Each block's terms with the documents that hold them, how often, and the largest count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            # texts of like length share a block, so that its least norm tells something of all of them
            order = pc.sort_indices(pc.binary_length(batch.column("text")))
            for lo, hi in byte_cuts(batch.column("text").take(order), block_rows, block_bytes):
                part = batch.take(order.slice(lo, hi - lo))
                doc, terms = content_runs(part.column("text"))
                coded = terms.dictionary_encode()
                words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                key, n = np.unique(code * max(1, part.num_rows) + doc, return_counts=True)
                code, doc = key // max(1, part.num_rows), key % max(1, part.num_rows)
                at = np.searchsorted(code, np.arange(len(words) + 1))
                most = np.maximum.reduceat(n, at[:-1]) if len(words) else np.zeros(0, np.int64)
                kept = pa.array(np.ones(len(words), bool)) if not stop else pc.invert(pc.is_in(words, pa.array(stop, pa.large_string())))
                out = pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(words), block)), words.cast(pa.string()), pa.array(np.diff(at).astype(np.int32)), pa.array(most.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), part.column("key").take(pa.array(doc))), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))),
                ], ["block", "term", "df", "most", "docs", "counts"])
                yield out.filter(kept)
                block += 1

    return run


def _scorer(k: int | None):
    """Cosines of one block's documents (in order, with norms) with the queries of one part, from the block's postings of their terms; of each query the ``k`` best, or all."""

    def run(postings: pa.Table, block: pa.Table) -> pa.Table:
        none = pa.table({"qid": postings.column("qid").combine_chunks().flatten()[:0], "doc": postings.column("docs").combine_chunks().flatten()[:0], "cosine": pa.array([], pa.float64())})
        if not postings.num_rows or not block.num_rows:
            return none
        lists = {c: postings.column(c).combine_chunks() for c in ("docs", "counts", "qid", "qn", "qnorm")}
        flat = {c: x.flatten() for c, x in lists.items()}
        term_of = lambda c: np.repeat(np.arange(postings.num_rows), pc.list_value_length(lists[c]).to_numpy(zero_copy_only=False))
        docs, norm2 = (block.column(c).combine_chunks().flatten() for c in ("held", "norm2"))
        norm2, wq, w = norm2.to_numpy(), postings.column("wq").to_numpy(), postings.column("w").to_numpy()
        coded = flat["qid"].dictionary_encode()
        names, query, term = coded.dictionary, coded.indices.to_numpy(), term_of("qid")
        order = np.argsort(query, kind="stable")
        query, term, qn, qnorm = query[order], term[order], flat["qn"].to_numpy()[order].astype(float), flat["qnorm"].to_numpy()[order]
        of_doc, of_count, of_term = pc.index_in(flat["docs"], value_set=docs).to_numpy(), flat["counts"].to_numpy().astype(float), term_of("docs")
        dot, moved = np.zeros((len(names), len(docs))), np.zeros((len(names), len(docs)))
        some = max(1, (2 << 20) // len(docs))  # so many terms at a time, for 16 MB of counts
        for lo in range(0, postings.num_rows, some):
            hi = min(lo + some, postings.num_rows)
            n = np.zeros((hi - lo, len(docs)))
            a, b = np.searchsorted(of_term, [lo, hi])
            n[of_term[a:b] - lo, of_doc[a:b]] = of_count[a:b]
            mine = np.flatnonzero((term >= lo) & (term < hi))
            at = np.searchsorted(query[mine], np.arange(len(names) + 1))
            for q in range(len(names)):
                own = mine[at[q]:at[q + 1]]
                if len(own):
                    t = term[own]
                    part = n[t - lo]
                    dot[q] += (qn[own] * wq[t] ** 2) @ part
                    moved[q] += (wq[t] ** 2 - w[t] ** 2) @ part ** 2
        first = np.searchsorted(query, np.arange(len(names)))
        cosine = np.divide(dot, np.sqrt(np.maximum(norm2 + moved, 1e-300)) * qnorm[first][:, None])
        asked_for = block.column("asked_for")
        wanted = range(len(names)) if not asked_for.null_count == 0 else np.flatnonzero(pc.is_in(names, value_set=asked_for.combine_chunks().flatten()).to_numpy(zero_copy_only=False))
        found = [(q, np.flatnonzero(dot[q] > 0)) for q in wanted]
        if k is not None:
            found = [(q, d[np.argsort(-cosine[q, d], kind="stable")[:k]]) for q, d in found]
        if not any(len(d) for _, d in found):
            return none
        q, d = np.concatenate([np.full(len(d), q) for q, d in found]), np.concatenate([d for _, d in found])
        return pa.table({"qid": names.take(pa.array(q)), "doc": docs.take(pa.array(d)), "cosine": pa.array(cosine[q, d])})

    return run


@dataclass
class TextIndex:
    """``postings`` (shard, term, block, df, most, docs, counts), ``terms`` (term, df, w), ``norms`` (doc, block, norm2) and the number of documents.

    ``w`` is ln(1 + (N + 1) / (1 + df)): a query counts as one document more. Its own terms then have a df of one more, which changes
    weights and norms through these terms alone, so their postings suffice to put any query's norms right.
    """

    postings: DataFrame
    terms: DataFrame
    norms: DataFrame
    documents: int
    shards: int

    def shard(self, term: Column | str) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.shards)).cast("int")

    def asked(self, queries: DataFrame, text: str = "text", stop: tuple[str, ...] = (), part: int = 256) -> DataFrame:
        """(qid, part, term, qn, wq, w, qnorm) of every query's terms that some document holds; written, as it is read again and again.

        About ``part`` queries make a part, and are scored together.
        """
        n, parts = self.documents + 1, max(1, -(-queries.select("qid").distinct().count() // part))
        counts = queries.select("qid", F.explode(content_terms(text, stop)).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qn"))
        q = counts.join(self.terms.select("term", "df", "w"), "term", "left").withColumn("wq", F.log(1 + F.lit(n) / (2 + F.coalesce("df", F.lit(0)))))
        norms = q.groupBy("qid").agg(F.sqrt(F.sum(F.pow(F.col("qn") * F.col("wq"), 2))).alias("qnorm"))
        dealt = F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int").alias("part")
        return materialise(q.where("df is not null").join(norms, "qid").select("qid", dealt, "term", "qn", "wq", "w", "qnorm"), "asked")[0]

    def _read(self, asked: DataFrame) -> DataFrame:
        """Postings of the asked terms: only their shards' files are opened, and few terms are pushed into the scan."""
        few = asked.select("term", self.shard("term").alias("shard")).distinct().limit(257).collect()
        if len(few) <= 256:
            return self.postings.where(F.col("shard").isin(sorted({r["shard"] for r in few})) & F.col("term").isin([r["term"] for r in few]))
        found = asked.select(self.shard("term").alias("shard")).distinct().collect()  # as many as there are shards, at most
        return self.postings.where(F.col("shard").isin([r["shard"] for r in found]))

    def _scores(self, asked: DataFrame, blocks: DataFrame | None = None, k: int | None = None) -> DataFrame:
        """(qid, doc, cosine) of asked queries and documents that share a term, or of (qid, block) in ``blocks`` alone; the ``k`` best of each query and block.

        A block's postings meet its documents and a part of the queries in one place, all of bounded size; only cosines leave it. Pairs
        of query and document are never shuffled.
        """
        of_term = asked.groupBy("part", "term").agg(F.first("wq").alias("wq"), F.first("w").alias("w"), F.collect_list(F.struct("qid", "qn", "qnorm")).alias("of"))
        rows = self._read(asked).join(of_term, "term")
        held = self.norms.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("doc", "norm2"))).alias("d"))
        if blocks is None:
            meet = held.join(F.broadcast(asked.select("part").distinct().withColumn("asked_for", F.lit(None).cast(f"array<{asked.schema['qid'].dataType.simpleString()}>"))), how="cross")
        else:
            parts = asked.select("qid", "part").distinct()
            meet = held.join(blocks.join(parts, "qid").groupBy("block", "part").agg(F.collect_list("qid").alias("asked_for")), "block")
            rows = rows.join(meet.select("block", "part"), ["block", "part"], "left_semi")
        rows = rows.select("block", "part", "docs", "counts", "wq", "w", F.col("of.qid").alias("qid"), F.col("of.qn").alias("qn"), F.col("of.qnorm").alias("qnorm"))
        meet = meet.select(F.col("block").alias("b"), F.col("part").alias("p"), F.col("d.doc").alias("held"), F.col("d.norm2").alias("norm2"), "asked_for")
        kinds = [f"{c} {t.schema[c].dataType.simpleString()}" for t, c in ((asked, "qid"), (self.norms, "doc"))]
        return rows.groupBy("block", "part").cogroup(meet.groupBy("b", "p")).applyInArrow(_scorer(k), f"{', '.join(kinds)}, cosine double")

    def search(self, queries: DataFrame, text: str = "text", stop: tuple[str, ...] = ()) -> DataFrame:
        """(qid, doc, cosine) of every query (qid, text) and every document that shares a term with it."""
        return self._scores(self.asked(queries, text, stop))

    def bounds(self, asked: DataFrame) -> DataFrame:
        """(qid, block, bound): no document of the block has a higher cosine with the query."""
        most, wq, w = F.col("most"), F.col("wq"), F.col("w")
        least = self.norms.groupBy("block").agg(F.min("norm2").alias("least"))
        up = self._read(asked).join(asked, "term").groupBy("qid", "block").agg(F.sum(most * F.col("qn") * wq * wq).alias("dot"), F.sum(most * most * (w * w - wq * wq)).alias("lost"), F.first("qnorm").alias("qnorm"))
        room = F.col("least") - F.col("lost")
        bound = F.when(room > 1e-12, F.col("dot") / (F.sqrt(room) * F.col("qnorm"))).otherwise(1.0)
        return up.join(least, "block").select("qid", "block", (F.least(bound, F.lit(1.0)) * (1 + 1e-9)).alias("bound"))

    def top(self, queries: DataFrame, k: int, text: str = "text", stop: tuple[str, ...] = (), first_blocks: int = 2) -> tuple[DataFrame, DataFrame]:
        """((qid, doc, cosine, place) of each query's ``k`` best documents, (qid, block, bound, read) of its blocks).

        The blocks of the highest bounds are read first; the kth cosine there is what any other block's bound must reach to be
        read at all. Ties go to the smaller document.
        """
        asked = self.asked(queries, text, stop)
        bounds, _ = materialise(self.bounds(asked).withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), "block"))), "bounds")
        score = lambda blocks: self._scores(asked, blocks, k)
        best = Window.partitionBy("qid").orderBy(F.desc("cosine"), "doc")
        early, _ = materialise(score(bounds.where(F.col("n") <= first_blocks)).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k), "early")
        floor = early.where(F.col("place") == k).select("qid", F.col("cosine").alias("floor"))
        judged, _ = materialise(bounds.join(floor, "qid", "left").withColumn("read", (F.col("n") <= first_blocks) | F.col("floor").isNull() | (F.col("bound") >= F.col("floor"))), "judged")
        found = early.drop("place").unionByName(score(judged.where((F.col("n") > first_blocks) & F.col("read"))))
        return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k), judged.select("qid", "block", "bound", "read")


def text_index(docs: DataFrame, key: str, text: str = "text", stop: tuple[str, ...] = (), shards: int = 16, block_rows: int = 2048, block_bytes: int = 2 << 20) -> TextIndex:
    """Index texts by term. ``key`` tells documents apart and is not null; texts that are null or hold no term are counted, and never found.

    One pass cuts the texts into terms and counts them, a block of ``block_rows`` documents or about ``block_bytes`` of text at a time
    (a longer text alone), so memory is bounded and what is shuffled is a row a block and term, not one a document and term. Postings are written by shard of the term and sorted by it: a query opens its
    terms' shards and skips row groups of others. Norms take one join of these rows with the terms' weights.
    """
    narrow_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.lower(present(text)).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    raw = rows.mapInArrow(_poster(stop, block_rows, block_bytes), f"block long, term string, df int, most int, docs array<{kind}>, counts array<int>")
    shard = F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int")
    path = scratch_path(docs.sparkSession, "postings")
    # a shard is split over as many tasks as its size asks for, so no task grows with the input
    raw.withColumn("shard", shard).hint("rebalance", "shard").sortWithinPartitions("shard", "term").write.partitionBy("shard").parquet(path)
    postings = docs.sparkSession.read.schema(f"block long, term string, df int, most int, docs array<{kind}>, counts array<int>, shard int").parquet(path)
    n = docs.count()
    weight = F.log(1 + F.lit(n + 1) / (1 + F.col("df")))
    terms, _ = materialise(postings.groupBy("shard", "term").agg(F.sum("df").alias("df")).withColumn("w", weight), "terms")
    flat = postings.join(terms.select("shard", "term", "w"), ["shard", "term"]).select("block", "w", F.explode(F.arrays_zip("docs", "counts")).alias("p"))
    norms, _ = materialise(flat.groupBy(F.col("p.docs").alias("doc"), "block").agg(F.sum(F.pow(F.col("p.counts") * F.col("w"), 2)).alias("norm2")), "norms")
    return TextIndex(postings, terms, norms, n, shards)
