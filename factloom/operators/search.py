"""Retrieval: vector and lexical arms, linear or reciprocal-rank fusion.

All filters stand inside both arms, ahead of their limits: filtering after a
limit changes the answer. One builder specialises the plan by its arguments.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.predicates import Ceiling, has_tags, held_at, linked, live, use_boost, within
from ..functions.vector import similarity_to
from . import postings


@dataclass(frozen=True)
class Weights:
    vector: float = 1.0
    lexical: float = 0.35
    usage: float = 0.05
    secondary: float = 0.85
    rrf_k: float = 60.0


def candidates(limit: int) -> int:
    """How many rows an arm gives for a page of so many."""
    return max(4 * limit, 20)


def holds(now: datetime, as_of: datetime | None = None, history: bool = False) -> Column:
    """Which rows an arm may give; an instant decides before history does."""
    if as_of is not None:
        return held_at(as_of)
    return F.lit(True) if history else live(now)


def vector_arm(rows: DataFrame, probe: Sequence[float], limit: int) -> DataFrame:
    """(id, similarity, rank_vec): the nearest rows; of equal ones the smaller id."""
    top = rows.filter("embedding is not null").select("id", similarity_to(probe).alias("similarity")).orderBy(F.col("similarity").desc(), "id").limit(limit)
    return top.withColumn("rank_vec", F.row_number().over(W.orderBy(F.col("similarity").desc(), "id")).cast("long"))


def lexical_arm(rows: DataFrame, query: str, limit: int, index: postings.Index | None = None) -> DataFrame:
    """(id, lexical, rank_lex): open rows that match the query, best first. The
    index holds open texts alone, so that no text is read here; without an index the
    rows' own are indexed first."""
    reach = rows.filter("sensitivity = 'open'")
    if index is None:
        top = postings.match(postings.pack(reach.filter("content is not null")), query, reach.filter("content is not null")).orderBy(F.col("lexical").desc(), "id").limit(limit)
    else:
        top = postings.top(index, query, reach, limit)
    return top.withColumn("rank_lex", F.row_number().over(W.orderBy(F.col("lexical").desc(), "id")).cast("long"))


def search(
    memory: DataFrame,
    probe: Sequence[float],
    query: str | None,
    primary: Iterable[Ceiling],
    secondary: Iterable[Ceiling] = (),
    *,
    now: datetime,
    limit: int = 8,
    fusion: str = "linear",
    as_of: datetime | None = None,
    history: bool = False,
    tags: Sequence[str] = (),
    weights: Weights = Weights(),  # noqa: B008
    index: postings.Index | None = None,
    lexical: DataFrame | None = None,
) -> DataFrame:
    """The best rows of both arms: memory's columns, similarity, lexical,
    is_primary, score (unrounded), by score, then newest, then id.

    ``index`` is the inverted index that the lexical arm reads; an arm of one's
    own is given as (id, lexical, rank_lex). Without a query only the vector
    arm counts. The arms hold at most ``candidates(limit)`` rows
    each, so that their fusion and the join back are broadcasts.
    """
    primary, secondary = list(primary), list(secondary)
    reach = memory.filter(within([*primary, *secondary]) & holds(now, as_of, history) & has_tags(list(tags)))
    n = candidates(limit)
    vec = vector_arm(reach, probe, n)
    if lexical is None:
        lexical = lexical_arm(reach, query, n, index) if query else None
    if lexical is None:
        merged = vec.withColumn("lexical", F.lit(0.0)).withColumn("rank_lex", F.lit(None).cast("long"))
    else:
        merged = vec.join(lexical, "id", "full").withColumns({"similarity": F.coalesce("similarity", F.lit(0.0)), "lexical": F.least(F.coalesce("lexical", F.lit(0.0)), F.lit(1.0))})
    rows = memory.join(F.broadcast(merged), "id")
    near = F.col("namespace").isin([n for n, _ in primary])
    penalty = F.when(near, 1.0).otherwise(weights.secondary)
    if fusion == "rrf":
        part = lambda w, rank: F.coalesce(F.lit(w) / (F.lit(weights.rrf_k) + F.col(rank)), F.lit(0.0))
        score = (part(weights.vector, "rank_vec") + part(weights.lexical, "rank_lex")) * (1 + weights.usage * use_boost()) * penalty
    else:
        score = (F.col("similarity") * weights.vector + F.col("lexical") * weights.lexical + use_boost() * weights.usage) * penalty
    scored = rows.withColumn("is_primary", near).withColumn("score", score).drop("rank_vec", "rank_lex")
    return scored.orderBy(F.col("score").desc(), F.col("created_at").desc(), "id").limit(limit)


def neighbours(memory: DataFrame, probe: Sequence[float], namespace: str, *, now: datetime, floor: float, limit: int) -> DataFrame:
    """Live rows of one namespace at a similarity or above, nearest first."""
    near = memory.filter((F.col("namespace") == namespace) & live(now) & F.col("embedding").isNotNull()).withColumn("similarity", similarity_to(probe))
    return near.filter(F.col("similarity") >= floor).orderBy(F.col("similarity").desc(), "id").limit(limit)


def nearest_ids(memory: DataFrame, probe: Sequence[float], k: int) -> DataFrame:
    """The k nearest of all linked rows, exactly."""
    return vector_arm(memory.filter(linked()), probe, k).select("id", "similarity", F.col("rank_vec").alias("rank"))


def forget_candidates(memory: DataFrame, probe: Sequence[float], query: str | None, ceilings: Iterable[Ceiling], *, now: datetime, floor: float, limit: int = 25, index: postings.Index | None = None) -> DataFrame:
    """What a request to forget would remove: history too, use does not count."""
    found = search(memory, probe, query, ceilings, now=now, limit=min(limit, 25), history=True, weights=Weights(usage=0.0), index=index)
    return found.filter(F.col("similarity") >= floor)


def plan_namespaces(requested: Sequence[str] | None, project: str | None, readable_names: Iterable[str], siblings: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """(primary, secondary): an explicit list is all there is; else the default
    set, then names in one alias group and everything else that can be read."""
    names = set(readable_names)
    if requested:
        return [n for n in dict.fromkeys(requested) if n in names], []
    first = [n for n in dict.fromkeys(["user:me", "global", project]) if n in names]
    rest = [n for n in dict.fromkeys([*siblings, *sorted(names)]) if n in names and n not in first]
    return first, rest


def admitted(hits: DataFrame, ceilings: Iterable[Ceiling]) -> DataFrame:
    """Hits that the ceilings do not cover: none, unless a plan is wrong."""
    return hits.filter(~within(ceilings))
