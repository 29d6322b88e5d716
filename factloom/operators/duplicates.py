"""Exact and near duplicates, conflicts, and the cleanup pass over them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.predicates import Grant, differs, live, readable
from ..functions.staging import written
from ..functions.text import cluster_key, duplicate_key
from . import similarity
from .listing import in_cleanup, live_embedded_counts, unread

# Similarity bands and the bound of a pair scan.
NEAR_CERTAIN, MODEL_FLOOR, CONFLICT_FLOOR, SCAN_MAX, STALE_DAYS, STALE_MOST = 0.97, 0.65, 0.90, 2000, 90, 1_000_000


def exact_duplicates(memory: DataFrame, grants: Iterable[Grant], now: datetime, *, since: datetime | None = None, level: str = "sealed", scope: str | None = None, limit: int | None = None) -> DataFrame:
    """Members of groups of two or more facts with one normal form, of which at
    least one is not older than the watermark. Groups are counted by a digest
    first, so that one window holds only what is doubled, not the store."""
    rows = in_cleanup(memory, grants, now, level, scope).withColumn("norm", F.sha2(duplicate_key("namespace", "content"), 256))
    touched = F.lit(True) if since is None else F.max(F.col("created_at") >= F.lit(since))
    groups = rows.groupBy("norm").agg(F.count("*").alias("members"), (F.min(touched) if since is None else touched).alias("touched")).filter("members > 1 and touched")
    out = rows.join(groups.select("norm", "members"), "norm").orderBy("norm", "created_at", "id")
    return out if limit is None else out.limit(limit)


def similar_pairs(memory: DataFrame, grants: Iterable[Grant], now: datetime, floor: float, *, since: datetime | None = None, level: str = "sealed", scope: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """(namespace, a, b, similarity): pairs of one namespace at the floor or
    above, at least one side not older than the watermark."""
    rows = in_cleanup(memory, grants, now, level, scope)
    return similarity.pairs(rows, floor, asked=None if since is None else F.col("created_at") >= F.lit(since), carry=carry)


def conflicts(memory: DataFrame, grants: Iterable[Grant], now: datetime, floor: float, dismissed: DataFrame | None = None, *, limit: int | None = None, offset: int = 0, scan_most: int | None = None, contents: bool = True) -> DataFrame:
    """Pairs of live facts that say nearly the same, older first, without those
    that somebody dismissed. Without contents, all pairs come in no order; a
    page is cut before contents are looked up. Namespaces of more than ``scan_most`` live vectors
    are refused, if that is given (``SCAN_MAX``); else all are answered."""
    grants = list(grants)
    refuse_large(memory, grants, now, scan_most)
    rows = memory.filter(live(now) & readable(grants))
    found = similarity.pairs(rows, floor, carry=["created_at"], without=None if dismissed is None else dismissed.select("lo_id", "hi_id"))
    first = F.struct(F.col("a_created_at").alias("at"), F.col("a").alias("id")) < F.struct(F.col("b_created_at").alias("at"), F.col("b").alias("id"))
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    out = found.select(pick("a", "b").alias("older_id"), pick("b", "a").alias("newer_id"), "namespace", "similarity", pick("a_created_at", "b_created_at").alias("older_at"))
    order = (F.col("similarity").desc(), "older_at", "older_id", "newer_id")
    if limit is not None:
        out = out.orderBy(*order).offset(offset).limit(limit)
    if not contents:
        return out
    of = lambda end: rows.select(F.col("id").alias(f"{end}_id"), F.col("content").alias(f"{end}_content"))
    return out.join(of("older"), "older_id").join(of("newer"), "newer_id").orderBy(*order).select("older_id", "newer_id", "namespace", "similarity", "older_at", "older_content", "newer_content")


def largest_scan(memory: DataFrame, grants: Iterable[Grant], now: datetime, most: int = SCAN_MAX) -> str | None:
    """The namespace whose pair scan would be too large, or None."""
    top = live_embedded_counts(memory, grants, now).limit(1).collect()
    return top[0].namespace if top and top[0].n > most else None


def refuse_large(memory: DataFrame, grants: Iterable[Grant], now: datetime, most: int | None) -> None:
    """For callers who would rather narrow a scan than wait for it."""
    if most is not None and (name := largest_scan(memory, grants, now, most)):
        raise ValueError(f"more than {most} live facts with vectors in {name}: narrow the scan")


def live_members(members: DataFrame, memory: DataFrame) -> DataFrame:
    """Members of proposals with what became of them: missing, retired, changed or none."""
    state = memory.select(F.col("id").alias("memory_id"), F.lit(True).alias("here"), F.col("superseded_by").isNotNull().alias("gone"), F.col("content").alias("now_content"))
    what = F.when(F.col("here").isNull(), "missing").when(F.col("gone"), "retired").when(differs(F.col("content"), F.col("now_content")), "changed")
    return members.join(state, "memory_id", "left").withColumn("became", what).drop("here", "gone")


def close_answered(proposals: DataFrame, members: DataFrame, memory: DataFrame, now: datetime) -> DataFrame:
    """Pending proposals are obsolete once any member is gone or changed."""
    gone = live_members(members, memory).filter("became is not null").select(F.col("proposal_id").alias("id")).distinct().withColumn("_gone", F.lit(True))
    closed = (F.col("state") == "pending") & F.coalesce("_gone", F.lit(False))
    rows = proposals.join(gone, "id", "left")
    return rows.withColumns({"state": F.when(closed, "obsolete").otherwise(F.col("state")), "decided_at": F.when(closed, F.lit(now)).otherwise(F.col("decided_at"))}).drop("_gone")


def queue(proposals: DataFrame, found: DataFrame) -> DataFrame:
    """found (kind, namespace, ids, similarity, created_at) -> proposals with
    what is new. One proposal for each cluster, whatever its state."""
    keyed = found.withColumn("cluster_key", cluster_key(F.col("kind"), F.col("ids").cast("array<string>"))).dropDuplicates(["cluster_key"])
    new = keyed.join(proposals.select("cluster_key"), "cluster_key", "left_anti")
    fields = {f.name: f.dataType for f in proposals.schema.fields}
    values = {"id": F.substring("cluster_key", 1, 32), "cluster_key": F.col("cluster_key"), "kind": F.col("kind"), "namespace": F.col("namespace"), "similarity": F.col("similarity"), "state": F.lit("pending"), "created_at": F.col("created_at"), "keep_id": F.col("keep_id") if "keep_id" in found.columns else F.lit(None)}
    return proposals.unionByName(new.select(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields.items()]))


def survivors(groups: DataFrame) -> DataFrame:
    """(norm, id, occurred_at, created_at) -> (norm, keep_id, ids): the member
    that is true last stays; without dates the oldest."""
    dated = F.max_by("id", F.struct("occurred_at", "created_at", "id"))
    undated = F.min_by("id", F.struct("created_at", "id"))
    return groups.groupBy("norm").agg(F.when(F.count("occurred_at") > 0, dated).otherwise(undated).alias("keep_id"), F.array_sort(F.collect_set("id")).alias("ids"))


def cleanup_pass(memory: DataFrame, grants: Iterable[Grant], now: datetime, *, since: datetime | None = None, level: str = "sealed", scope: str | None = None, daily: bool = True, near: float = NEAR_CERTAIN, floor: float = MODEL_FLOOR, stale_most: int = STALE_MOST, scan_most: int | None = None) -> dict[str, DataFrame]:
    """One pass: exact groups; near-certain pairs neither side of which an
    exact group took, so what those took is not compared at all; pairs for the
    model to judge, open on both sides; stale facts on the daily pass, and
    whether there are more than are given; and the new watermark."""
    grants = list(grants)
    refuse_large(memory, grants, now, scan_most)
    old = unread(memory, grants, STALE_DAYS, stale_most + 1, now, level, scope) if daily else memory.limit(0)
    exact = exact_duplicates(memory, grants, now, since=since, level=level, scope=scope)
    claimed = exact.select("id").distinct()
    free = written(similar_pairs(memory.join(claimed, "id", "left_anti"), grants, now, floor, since=since, level=level, scope=scope, carry=["sensitivity"]), "cleanup-pairs")
    model = free.filter((F.col("similarity") < near) & (F.col("a_sensitivity") == "open") & (F.col("b_sensitivity") == "open")).drop("a_sensitivity", "b_sensitivity")
    free = free.drop("a_sensitivity", "b_sensitivity")
    newest = in_cleanup(memory, grants, now, level, scope).agg(F.max("created_at").alias("newest"))
    through = F.greatest(F.col("newest"), F.lit(since)) if since is not None else F.col("newest")
    return {
        "exact": exact,
        "near_certain": free.filter(F.col("similarity") >= near),
        "model_band": model,
        "stale": old.limit(stale_most),
        "stale_truncated": old.agg((F.count("*") > stale_most).alias("truncated")),
        "watermark": newest.select(through.alias("through")),
    }


def successive_facts(memory: DataFrame, grants: Iterable[Grant], tag: str, now: datetime, level: str = "sealed") -> DataFrame:
    """(older_id, newer_id): neighbours in valid time among the facts of a
    single-valued tag; equal starts make no pair."""
    rows = memory.filter(live(now) & F.col("occurred_at").isNotNull() & F.array_contains("tags", tag) & readable(grants))
    by_start = rows.groupBy("namespace", "occurred_at").agg(F.max("id").alias("last_id"), F.min("id").alias("first_id"))
    order = W.partitionBy("namespace").orderBy("occurred_at")
    return by_start.select("namespace", F.col("last_id").alias("older_id"), F.lead("first_id").over(order).alias("newer_id"), "occurred_at", F.lead("occurred_at").over(order).alias("next_at")).filter("newer_id is not null")


def same_day(memory: DataFrame, grants: Iterable[Grant], tag: str, now: datetime) -> DataFrame:
    """How many facts of a tag share their start with another."""
    rows = memory.filter(live(now) & F.col("occurred_at").isNotNull() & F.array_contains("tags", tag) & readable(grants))
    return rows.groupBy("namespace", "occurred_at").agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("same_day"))


def supersession_proposals(memory: DataFrame, arities: DataFrame, grants: Iterable[Grant], now: datetime) -> DataFrame:
    """(tag, namespace, older_id, newer_id) for all tags declared single."""
    tags = [r.tag for r in arities.filter("arity = 'single'").select("tag").distinct().orderBy("tag").collect()]  # declared by hand, few
    out = None
    for tag in tags:
        part = successive_facts(memory, grants, tag, now).select(F.lit(tag).alias("tag"), "namespace", "older_id", "newer_id")
        out = part if out is None else out.unionByName(part)
    kind = memory.schema["id"].dataType.simpleString()
    return out if out is not None else memory.sparkSession.createDataFrame([], f"tag string, namespace string, older_id {kind}, newer_id {kind}")
