"""Connected components of a graph of links, as joins and grouped minima that end in tables of the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlake.llm.common import drop_stored, stored


#: Edges that one partition takes; a graph with fewer needs no shuffle.
EDGES = 250_000


def _fitted(edges: DataFrame, n: int) -> DataFrame:
    return edges.coalesce(-(-n // EDGES) or 1)


def _towards_least(pairs: DataFrame, n: int) -> DataFrame:
    """Each node u and its neighbours v as rows (u, v); points every v to the least of u's neighbourhood."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    if n > EDGES:  # as a table of its own, so that Spark can split a node with very many edges in the join
        least = stored(least, "least")
    return pairs.join(least, "u")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable by links, for every node that has a link to another.

    Rounds of two steps (Kiveris et al. 2014): nodes hand their larger neighbours to the least of their neighbourhood, then their
    smaller ones. The edges shrink to stars in a number of rounds that is logarithmic in the longest path. A hot node is many rows
    of a join with one row of minima, never a list in one task.
    """
    ends = links.select(F.col(a).cast("bigint").alias("x"), F.col(b).cast("bigint").alias("y")).where("x <> y")
    edges = stored(ends.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    mark, n = None, edges.count()
    while True:
        edges = _fitted(edges, n)
        ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        both = edges.select(F.inline(ends))  # not a union, which would have twice the partitions
        large = _towards_least(both, n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        held = stored(large, "large-star")
        small = _towards_least(_fitted(held, n), n).select(
            F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        )
        now = stored(small.where("u <> v").distinct(), "small-star")
        drop_stored(edges)
        drop_stored(held)
        edges = now
        # edges only ever move towards smaller nodes: unchanged count and sums mean an unchanged graph
        at = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(at):
            break
        mark, n = tuple(at), at[0]
    edges = _fitted(edges, n)
    nodes = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component")))
    return edges.select(F.inline(nodes)).distinct()
