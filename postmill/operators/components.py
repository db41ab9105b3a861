"""Connected components of an edge table, in rounds that grow with the logarithm of its longest chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.session import drop_scratch, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (u, v); the component is its smallest node.

    Each round hangs every node's neighbours on the least of them (first the larger ones, then the smaller ones), which halves
    chains. Neighbourhoods are never collected: the least neighbour comes from an aggregate, and meets the edges in a
    join whose hot keys Spark can split. Each round's edges are written and the round before is dropped. Rows with a null
    end are left out; an edge from a node to itself makes it a component of its own.
    """
    rows = edges.where("u is not null and v is not null")
    nodes, _ = materialise(rows.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "nodes")
    now, path = materialise(rows.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    print_of = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    mark = print_of(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new, new_path = materialise(small, "edges")
        new_mark = print_of(new)
        drop_scratch(edges.sparkSession, path)
        now, path = new, new_path
        if new_mark == mark:
            break
        mark = new_mark
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))
