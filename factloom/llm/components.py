"""Connected components of an edge table, by alternating large-star and
small-star rounds (Kiveris et al., Connected Components in MapReduce and
Beyond, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop_written, written


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def _kept(edges: DataFrame, *used: DataFrame) -> DataFrame:
    """Edges, written; the tables that they were made from go."""
    out = written(edges, "components")
    for table in used:
        drop_written(edges.sparkSession, table)
    return out


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "components-least")
    return _kept(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), least)


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = written(down.groupBy("a").agg(F.min("b").alias("m")), "components-least")
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _kept(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), least)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) of bigint -> (node, root): every node of the edges with the
    smallest node that it reaches. Self loops and nulls are ignored, repeated
    edges count once; no edges give no rows.

    Each round is written to the shared folder, so that lineage stays short;
    the number of rounds grows with the logarithm of the longest chain. The
    least neighbours are written too: joined from a table, both sides are plain
    exchanges, and a node of very many edges is split.
    """
    spark = edges.sparkSession
    now = _small_star(edges.filter("a <> b").select("a", "b"))
    before = None
    while (mark := _signature(now)) != before:
        if not mark[0]:
            break
        before = mark
        large = _large_star(now)
        after = _small_star(large)
        for done in (now, large):
            drop_written(spark, done)
        now = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
