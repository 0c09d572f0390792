"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import cut, discard


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame, into: list[str]) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least", into)
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, into: list[str]) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = cut(down.groupBy("a").agg(F.min("b").alias("m")), "least", into)
    return (
        down.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b: long) -> (node, label): label is the smallest node of its component; nodes without edges are absent.

    Each round is two aggregations and two joins on the edge table, which never grows beyond its size; every round is
    cut to a table in the shared folder. So are the least neighbours, of which a node has one row: both sides of the join
    are plain tables then, and adaptive execution splits the edges of a node that has very many. Ends when a round changes
    nothing.
    """
    spark, passing = edges.sparkSession, []
    edges = cut(edges.where("a <> b").distinct(), "edges", passing)
    mark = _mark(edges)
    for _ in range(max_rounds if mark[0] else 0):
        passed, passing = passing, []
        large = cut(_large_star(edges, passed).distinct(), "edges", passed)
        edges = cut(_small_star(large, passed).distinct(), "edges", passing)
        discard(spark, passed)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        if mark[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label"))
    return labels.union(roots).groupBy("node").agg(F.min("label").alias("label"))
