"""The review queue: one list of what a person should decide."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guards import stated_dates
from ..functions.predicates import Ceiling, Grant, readable
from .duplicates import conflicts, largest_scan
from .listing import stale, undated
from .policy import visible_proposals

# What can be decided about each kind of item.
VERDICTS = {"conflict": ["supersede", "merge", "keep_both"], "stale": ["confirm", "merge"], "proposal": ["apply", "dismiss"]}


def verdicts(source: str, may_delete: bool) -> Column:
    found = VERDICTS[source] + (["delete"] if may_delete and source != "proposal" else [])
    return F.array(*map(F.lit, found))


def shaped_for(source: str, verdict: str) -> bool:
    return verdict in VERDICTS.get(source, []) or verdict == "delete" and source in ("conflict", "stale")


def dismissed_pairs(ledger: DataFrame, memory: DataFrame, grants: Iterable[Grant], limit: int | None) -> DataFrame:
    """Dismissed pairs, newest first, both of whose facts the caller can read."""
    seen = memory.filter(readable(grants)).select("id")
    rows = ledger.join(seen.withColumnRenamed("id", "lo_id"), "lo_id", "left_semi").join(seen.withColumnRenamed("id", "hi_id"), "hi_id", "left_semi")
    return rows if limit is None else rows.orderBy(F.col("dismissed_at").desc(), "lo_id", "hi_id").limit(limit)


def date_candidates(memory: DataFrame, ceilings: Iterable[Ceiling], limit: int, now: datetime, scan: int = 20) -> DataFrame:
    """Undated facts whose text states a day: one is proposed, more are
    ambiguous; days to come do not count."""
    past = F.filter(F.col("dates"), lambda d: d <= F.lit(now.date()))
    rows = undated(memory, ceilings, limit * scan, now).withColumn("dates", stated_dates("content")).withColumn("dates", past).filter(F.size("dates") > 0)
    verdict = F.when(F.size("dates") == 1, "proposed").otherwise("ambiguous")
    return rows.withColumn("verdict", verdict).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def review_queue(memory: DataFrame, proposals: DataFrame, members: DataFrame, dismissed: DataFrame, grants: Sequence[Grant], now: datetime, *, floor: float = 0.90, days: int = 90, limit: int = 50, scan_max: int | None = None, may_delete: bool = False, more: Sequence[Callable[[], DataFrame]] = ()) -> DataFrame:
    """(key, source, namespace, rows, similarity, age_days, verdicts): conflicts,
    stale facts and proposals. Conflicts are left out where the largest
    namespace is beyond ``scan_max``. Further sources give the same columns."""
    age = lambda at: F.floor((F.lit(now).cast("timestamp").cast("double") - F.col(at).cast("double")) / 86400)
    none = F.lit(None)
    parts = []
    if scan_max is None or largest_scan(memory, grants, now, scan_max) is None:
        c = conflicts(memory, grants, now, floor, dismissed, limit=limit, contents=False)
        parts.append(c.select(F.concat_ws(":", F.lit("conflict"), "older_id", "newer_id").alias("key"), F.lit("conflict").alias("source"), "namespace", F.array(F.col("older_id").cast("string"), F.col("newer_id").cast("string")).alias("rows"), F.round("similarity", 4).alias("similarity"), none.cast("long").alias("age_days"), verdicts("conflict", may_delete).alias("verdicts")))
    s = stale(memory, grants, days, limit, now)
    parts.append(s.select(F.concat_ws(":", F.lit("stale"), "id").alias("key"), F.lit("stale").alias("source"), "namespace", F.array(F.col("id").cast("string")).alias("rows"), none.cast("double").alias("similarity"), age("created_at").alias("age_days"), verdicts("stale", may_delete).alias("verdicts")))
    p = visible_proposals(proposals, members, memory, grants).filter("state = 'pending'").orderBy(F.col("created_at").desc(), "id").limit(limit)
    own = members.groupBy(F.col("proposal_id").alias("id")).agg(F.array_sort(F.collect_set(F.col("memory_id").cast("string"))).alias("rows"))
    parts.append(p.join(own, "id", "left").select(F.concat_ws(":", F.lit("proposal"), F.lit("cleanup"), "id").alias("key"), F.lit("proposal").alias("source"), "namespace", "rows", none.cast("double").alias("similarity"), age("created_at").alias("age_days"), verdicts("proposal", may_delete).alias("verdicts")))
    out = parts[0]
    for part in [*parts[1:], *[source() for source in more]]:
        out = out.unionByName(part)
    return out


def page(rows: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """(page, has more): one row beyond the page is looked for."""
    return rows.limit(limit), rows.limit(limit + 1).count() > limit
