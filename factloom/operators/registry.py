"""The exact key/value registry with redirects, versions and history."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import credentials, guards
from ..functions.guards import REVIEW_DAYS, canonical_keys, canonical_kinds, suggested_keys
from ..functions.staging import written
from ..functions.predicates import Ceiling, rank_of, sensitivity_rank, within

KEY = ["namespace", "kind", "key"]


def _arms(rows: DataFrame, aliases: DataFrame, namespace: str, kind: str, key: str, top: str) -> DataFrame:
    """What is stored under the key itself (0), and under what it redirects to (1)."""
    own = rows.filter((F.col("namespace") == namespace) & (F.col("kind") == kind) & (sensitivity_rank() <= rank_of(top)))
    to = aliases.filter((F.col("namespace") == namespace) & (F.col("kind") == kind) & (F.col("alias_key") == key)).select(F.col("canonical").alias("key"), F.col("alias_key").alias("resolved_from"))
    direct = own.filter(F.col("key") == key).withColumn("resolved_from", F.lit(None).cast("string")).withColumn("preference", F.lit(0))
    return direct.unionByName(own.join(to, "key").withColumn("preference", F.lit(1)))


def get(registry: DataFrame, aliases: DataFrame, namespace: str, kind: str, key: str, top: str = "sealed") -> DataFrame:
    return _arms(registry, aliases, namespace, kind, key, top).orderBy("preference", "key").limit(1).drop("preference")


def get_first(registry: DataFrame, aliases: DataFrame, ceilings: Sequence[Ceiling], kind: str, key: str) -> DataFrame:
    """The same over several namespaces; the first in order that answers wins."""
    out = None
    for k, (namespace, top) in enumerate(ceilings):
        part = _arms(registry, aliases, namespace, kind, key, top).withColumn("precedence", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out.orderBy("precedence", "preference", "key").limit(1).drop("precedence", "preference")


def history(past: DataFrame, aliases: DataFrame, namespace: str, kind: str, key: str, top: str = "sealed", limit: int = 20) -> DataFrame:
    """What a key held, newest first: all rows of the arm that answers."""
    arms = _arms(past, aliases, namespace, kind, key, top)
    best = arms.withColumn("_best", F.min("preference").over(W.partitionBy("kind")))
    return best.filter("preference = _best").orderBy(F.col("replaced_at").desc(), F.col("version").desc()).limit(limit).drop("_best", "preference")


def listing(registry: DataFrame, ceilings: Iterable[Ceiling]) -> DataFrame:
    return registry.filter(within(ceilings)).orderBy("namespace", "kind", "key")


def due_for_review(registry: DataFrame, ceilings: Iterable[Ceiling], now: datetime) -> DataFrame:
    return registry.filter(within(ceilings) & (F.col("review_after") <= F.lit(now))).orderBy("review_after", "namespace", "key")


def non_canonical(registry: DataFrame, ceilings: Iterable[Ceiling]) -> DataFrame:
    """Keys that are not in normal form, with what they may have meant."""
    rows = registry.filter(within(ceilings)).withColumns({"canonical": canonical_keys("key"), "suggestion": suggested_keys("key")})
    return rows.filter(~F.col("canonical").eqNullSafe(F.col("key")))


def resolve_alias(aliases: DataFrame, namespace: str, kind: str, alias_key: str) -> DataFrame:
    return aliases.filter((F.col("namespace") == namespace) & (F.col("kind") == kind) & (F.col("alias_key") == alias_key))


def review_after(kind: Column, now: datetime) -> Column:
    """When an entry of a kind is due again."""
    days = F.lit(None).cast("int")
    for name, n in REVIEW_DAYS.items():
        days = F.when(kind == name, n).otherwise(days)
    return F.lit(now) + F.make_dt_interval(days=days)


def strictest_level(old: Column, new: Column) -> Column:
    """An archived value keeps the higher of its level and the new one."""
    return F.when(sensitivity_rank(new) > sensitivity_rank(old), new).otherwise(old)


def upsert(registry: DataFrame, past: DataFrame, entries: DataFrame, now: datetime, top: str = "sealed") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(registry, history, refused): a new value counts the version up and
    archives the old one; an entry stored above the caller's ceiling is not
    touched. entries: one row per key, with value, provenance and sensitivity."""
    new = entries.select(*KEY, *[F.col(c).alias(f"new_{c}") for c in ("value", "sensitivity")], F.lit(True).alias("_new"))
    both = registry.join(new, KEY, "full")
    stored, offered = F.col("version").isNotNull(), F.col("_new").isNotNull()
    allowed = ~stored | (sensitivity_rank() <= rank_of(top))
    take = offered & allowed
    pick = lambda c: F.when(take, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    version = F.when(take & stored, F.col("version") + 1).when(take, F.lit(1).cast("long")).otherwise(F.col("version")).alias("version")
    rest = [c for c in registry.columns if c not in (*KEY, "value", "sensitivity", "version", "review_after")]
    due = F.when(take, review_after(F.col("kind"), now)).otherwise(F.col("review_after")).alias("review_after")
    after = both.select(*KEY, pick("value"), pick("sensitivity"), version, due, *rest).select(*registry.columns)
    archived = both.filter(take & stored).select(*KEY, "value", strictest_level(F.col("sensitivity"), F.col("new_sensitivity")).alias("sensitivity"), "version", F.lit(now).alias("replaced_at"))
    raised = archived.groupBy(*KEY).agg(F.max(sensitivity_rank()).alias("_least"))
    older = past.join(raised, KEY, "left").withColumn("sensitivity", F.when(sensitivity_rank() < F.col("_least"), F.element_at(F.array(F.lit("open"), F.lit("private"), F.lit("sealed")), F.col("_least") + 1)).otherwise(F.col("sensitivity"))).drop("_least")
    return after, older.unionByName(archived, allowMissingColumns=True), both.filter(offered & ~allowed).select(*KEY)


def set_entries(registry: DataFrame, past: DataFrame, entries: DataFrame, now: datetime, top: str = "sealed") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries as callers send them -> (registry, history, refused with the
    reason): names are brought to their normal form, credentials at the open
    level are refused, then ``upsert``. Of several that come to one key the
    smallest value counts; the others are refused as ``repeated``."""
    named = entries.withColumns({"_ns": guards.namespace("namespace"), "_kind": canonical_kinds("kind"), "_key": canonical_keys("key")})
    level = F.coalesce("sensitivity", F.lit("open"))
    reason = (
        F.when(F.col("_ns").isNull() | ~guards.writable(F.col("_ns")), "namespace")
        .when(F.col("_kind").isNull(), "kind")
        .when(F.col("_key").isNull(), "key")
        .when(F.coalesce(F.trim("value"), F.lit("")) == "", "empty")
        .when((level == "open") & credentials.finding("value").isNotNull(), "credential")
    )
    judged = named.withColumns({"sensitivity": level, "reason": reason})
    order = W.partitionBy("_ns", "_kind", "_key", F.col("reason").isNull()).orderBy("value", "sensitivity")
    judged = judged.withColumn("_n", F.row_number().over(order)).withColumn("reason", F.when(F.col("reason").isNull() & (F.col("_n") > 1), "repeated").otherwise(F.col("reason")))
    judged = written(judged.select("namespace", "kind", "key", "value", "sensitivity", "_ns", "_kind", "_key", "reason"), "entries-judged")
    good = judged.filter("reason is null").select(F.col("_ns").alias("namespace"), F.col("_kind").alias("kind"), F.col("_key").alias("key"), "value", "sensitivity")
    after, history_, above = upsert(registry, past, good, now, top)
    return after, history_, judged.filter("reason is not null").select(*KEY, "reason").unionByName(above.withColumn("reason", F.lit("above_ceiling")))


def delete(registry: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows go; their history stays."""
    return registry.join(keys.select(*KEY), KEY, "left_anti")


def add_alias(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """A redirect made from a refused write never replaces one made by hand."""
    on = ["namespace", "kind", "alias_key"]
    rank = F.when(F.col("origin") == "rejected-write", 0).otherwise(1)
    both = aliases.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = W.partitionBy(*on).orderBy(rank.desc(), F.col("_new").desc())
    return both.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_new")
