"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.session import remove_path, scratch_path


def _store(edges: DataFrame, path: str) -> DataFrame:
    """Written and read again, so that a lost executor costs one round at most."""
    edges.write.parquet(path)
    return edges.sparkSession.read.parquet(path)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``m`` beside each edge. The key is a struct, so that both sides are shuffled for this join alone: it can split a
    node of many edges, which it could not in the shuffle that the minima come from."""
    return edges.join(least.select(F.struct("a").alias("k"), "m"), F.struct(edges["a"]) == F.col("k")).select("a", "b", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node join the least node next to it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return _with_least(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours join the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    others = _with_least(down, least).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node that can be reached; nodes without an edge are left out.

    Rounds of large and small stars until nothing changes. Each works on edges with
    minima combined before the shuffle and joins that can split a node with many edges;
    no component is ever gathered.
    """
    spark, scratch = edges.sparkSession, scratch_path(edges.sparkSession, "components")
    edges = edges.toDF("a", "b").where("a <> b")
    edges = _store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{scratch}/0")
    mark, round_ = _mark(edges), 0
    while mark[0]:
        round_ += 1
        edges = _store(_small_star(_large_star(edges)), f"{scratch}/{round_}")
        remove_path(spark, f"{scratch}/{round_ - 1}")
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
