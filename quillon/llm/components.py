"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over (u, v) with u > v: neighbours move to the smallest neighbour of u."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.join(low, "u")
    if large:
        out = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b); root is the smallest node that the links reach.

    No link is dropped and nothing but two sums goes to the driver. Each round is checkpointed, so
    that the plan stays short and a lost executor repeats one round at most. An empty table gives
    an empty result; loops and repeated links are harmless.
    """
    edges = checkpointed(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = F.struct(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"))
    last = edges.agg(mark.alias("s")).first()["s"]
    while last["n"]:
        edges = checkpointed(_star(_star(edges, True), False))
        now = edges.agg(mark.alias("s")).first()["s"]
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
