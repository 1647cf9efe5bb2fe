"""Connected components of a distributed edge list, by alternating star contractions.

Every step replaces edges by edges to the least neighbour, so paths shorten until each component is a star
around its least node. Steps are joins and partial minima; a node with many edges is a hot join key that
adaptive execution splits, and no component is collected anywhere.

Defined cases: links with a null end and links of a node with itself don't count; repeated links, in either
direction, are one; an empty table gives an empty result; columns besides the two ends are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v) with u > v: large stars move the larger neighbours, small stars the smaller ones."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """links: two columns of longs. One row for each node that has a link to another one and isn't the least of its component: node, root."""
    edges = common.stored(links.select(a, b, F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).select("u", "v").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        following = common.stored(_star(_star(edges, True), False), "edges")
        common.discard(edges)
        edges, before, state = following, state, _state(following)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
