"""Connected components of a graph whose edges never fit one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.llm.tables import written


def _key(edges: DataFrame) -> tuple:
    got = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(got)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: bigint); root is the smallest node of its component.

    Alternates two star contractions until the edge set stands still: each node links its larger
    neighbours to its smallest one, then its smaller neighbours likewise. A node's smallest
    neighbour is a partial aggregate, so a node with millions of neighbours is no hot group; the
    edges of a round are a written table. The number of rounds grows with the logarithm of the
    longest path. Self loops and repeated edges are ignored; an empty edge table gives no rows.
    """
    now = written(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (state := _key(now)) != before and state[0]:
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("m").alias("a"), "b").where(F.col("a") != F.col("b")).distinct()
        large = written(large, "edges-large")
        # each edge (a, b) has a < b, so b's smaller neighbours are its a's
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        kept = large.join(low, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y"))
        now = written(kept.where(F.col("x") != F.col("y")).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
