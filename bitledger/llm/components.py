"""Connected components of a graph given as an edge table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitledger.llm.text import partitions
from bitledger.session import remove_path, scratch_path

_EDGE = "a bigint, b bigint"


# Edges of one partition in the rounds.
EDGES = 100_000


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (``a``, ``b``; both bigint), the
    component being its smallest node.

    Alternates the large-star and small-star steps: every node hands its larger (smaller)
    neighbours to the smallest node it sees. Minima are taken by an aggregate and joined back,
    so no neighbour list is ever collected and a node with very many edges can be split. Each
    round is written to the shared folder in as many parts as its edges need, and the table of
    the round before is removed; the rounds end when the edges no longer change.
    """
    spark = edges.sparkSession
    path = scratch_path(spark, "edges")
    edges.where("a <> b").select("a", "b").distinct().write.parquet(path)
    current, seen = spark.read.schema(_EDGE).parquet(path), None
    while (state := _fingerprint(current)) != seen:
        seen = state
        parts = min(partitions(spark), -(-state[0] // EDGES) or 1)
        last, path = path, scratch_path(spark, "edges")
        # Few parts write few shuffle files, however many partitions a shuffle has.
        larger = _large_star(current.coalesce(parts)).coalesce(parts).distinct()
        _small_star(larger.coalesce(parts)).coalesce(parts).distinct().coalesce(parts).write.parquet(path)
        current = spark.read.schema(_EDGE).parquet(path)
        remove_path(spark, last)
    # Now every edge leads from a node to its component.
    star = current.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component"))
    return star.union(star.select(F.col("component").alias("node"), "component")).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    ends = F.xxhash64(F.greatest("a", "b"), F.least("a", "b")).cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(ends)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    larger = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return larger.where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b")))
