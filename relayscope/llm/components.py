"""Connected components by rounds of large-star and small-star."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayscope.llm.shared import dropped, written


def connected_components(edges: DataFrame) -> DataFrame:
    """id, component of each end of ``edges`` (columns a and b): the smallest id that it reaches.

    Loops and repeated edges don't matter; no edges give an empty table. Each
    round is a few groupings with a combine on the map side, so a vertex with
    very many neighbours is no task of its own.
    """

    def both_ways(rows: DataFrame, one: Column, two: Column) -> DataFrame:
        return rows.select(F.explode(F.array(one, two)).alias("e")).select("e.a", "e.b").where("a <> b")

    def edge(a: str, b: str) -> Column:
        return F.struct(F.col(a).alias("a"), F.col(b).alias("b"))

    def kept(rows: DataFrame) -> tuple[DataFrame, tuple]:
        """The distinct edges, from the larger end to the smaller, and what tells them from other sets of edges."""
        table = written(rows.distinct(), "edges")
        return table, tuple(table.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now, before = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while before[0]:
        # Large star: every larger neighbour of a vertex goes to the vertex's least neighbour, itself included.
        both = both_ways(now, edge("a", "b"), edge("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: a vertex's smaller neighbours and itself go to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        after, state = kept(both_ways(large.join(least, "a"), edge("b", "m"), edge("a", "m")))
        dropped(now)
        now, last, before = after, before, state
        if last == before:
            break
    ends = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ends.union(now.select(F.col("b"), F.col("b"))).distinct()
