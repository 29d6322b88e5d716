"""Supersession chains: walks, heads, timelines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import Grant, readable
from ..functions.staging import written

#: Hops that a walk takes at most.
DEPTH_CAP = 64


def _walk(memory: DataFrame, anchor: object, forward: bool, cap: int) -> DataFrame:
    """(id, depth) by a recursive query: one hop per round, in the engine."""
    hop = "m.id = c.superseded_by" if forward else "m.superseded_by = c.id"
    return memory.sparkSession.sql(
        f"""
        WITH RECURSIVE chain(id, superseded_by, depth) AS (
          SELECT id, superseded_by, 0 FROM {{links}} WHERE id = :anchor
          UNION ALL
          SELECT m.id, m.superseded_by, c.depth + 1 FROM {{links}} m JOIN chain c ON {hop} WHERE c.depth < {cap}
        ) SELECT id, depth FROM chain""",
        args={"anchor": anchor},
        links=memory.select("id", "superseded_by"),
    )


def chain_ids(memory: DataFrame, anchor: object, cap: int = DEPTH_CAP) -> DataFrame:
    """The anchor and what replaced it, hop by hop; a cycle ends at the cap."""
    return _walk(memory, anchor, True, cap - 1)


def head(memory: DataFrame, anchor: object, cap: int = DEPTH_CAP) -> DataFrame:
    """The row at the end of the anchor's chain."""
    last = chain_ids(memory, anchor, cap).agg(F.max_by("id", "depth").alias("id"))
    return memory.join(F.broadcast(last), "id", "left_semi")


def chain_neighbours(memory: DataFrame, anchor: object) -> DataFrame:
    """One hop each way."""
    before, after = F.col("superseded_by") == F.lit(anchor), F.col("supersedes") == F.lit(anchor)
    return memory.filter(before | after).withColumn("side", F.when(before, "predecessor").otherwise("successor"))


def subject_history(memory: DataFrame, anchor: object, grants: Iterable[Grant], cap: int = DEPTH_CAP) -> DataFrame:
    """The whole chain of the anchor, oldest first: its readable versions, how
    many were withheld, and whether the walk ran out of hops. Nothing for an
    anchor that can't be read. Both walks are bounded by the cap, so the chain
    is sent to the rows and the frames after it are small."""
    back = _walk(memory, anchor, False, cap).withColumn("depth", -F.col("depth"))
    chain = _walk(memory, anchor, True, cap).unionByName(back).groupBy("id").agg(F.min("depth").alias("depth"))
    walked = memory.join(F.broadcast(chain), "id").withColumn("_readable", readable(grants))
    gap = walked.agg(F.count_if(~F.col("_readable")).alias("withheld"), F.coalesce(F.bool_or(F.abs("depth") >= cap), F.lit(False)).alias("depth_capped"), F.coalesce(F.bool_or((F.col("id") == F.lit(anchor)) & F.col("_readable")), F.lit(False)).alias("_open"))
    shown = walked.filter("_readable").crossJoin(F.broadcast(gap)).filter("_open").drop("_readable", "_open")
    return shown.orderBy("depth", "created_at", "id")


def heads(memory: DataFrame, cap: int = DEPTH_CAP) -> DataFrame:
    """(id, head, hops) of every row at once. Only links move: each round
    doubles the hops that they span, and is written so that the plan of the
    next one does not hold it twice; six rounds do for chains of 64, a round
    in which nothing moves is the last. A cycle ends at the cap."""
    links = memory.filter("superseded_by is not null").select("id", F.col("superseded_by").alias("head"), F.lit(1).alias("hops"))
    known = memory.select(F.col("id").alias("head"))
    step = written(links.join(known, "head", "left_semi").select("id", "head", "hops"), "heads")
    n, before = 1, -1
    while n < cap and (now := step.agg(F.coalesce(F.sum("hops"), F.lit(0))).first()[0]) != before:
        before = now
        onward = step.select(F.col("id").alias("head"), F.col("head").alias("far"), F.col("hops").alias("more"))
        moved = step.join(onward, "head", "left").select("id", F.coalesce("far", "head").alias("head"), F.least(F.col("hops") + F.coalesce("more", F.lit(0)), F.lit(cap)).alias("hops"))
        step, n = written(moved, "heads"), 2 * n
    return memory.select("id").join(step, "id", "left").select("id", F.coalesce("head", "id").alias("head"), F.coalesce("hops", F.lit(0)).alias("hops"))
