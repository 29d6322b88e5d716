"""The predicates that nearly every query shares, as columns."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Grant = tuple[str, str]  # (namespace pattern, highest level)
Ceiling = tuple[str, str]  # (namespace, highest level)

#: Levels in order. Whatever is none of them ranks above all grants.
LEVELS = ("open", "private", "sealed")
UNKNOWN_RANK = 99


def _c(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def field(name: str, side: str = "") -> Column:
    return F.col(f"{side}.{name}" if side else name)


def sensitivity_rank(level: str | Column = "sensitivity") -> Column:
    level = _c(level)
    ranked = F.when(level == LEVELS[0], 0).when(level == LEVELS[1], 1).when(level == LEVELS[2], 2)
    return ranked.otherwise(UNKNOWN_RANK)


def rank_of(level: str) -> int:
    return LEVELS.index(level) if level in LEVELS else UNKNOWN_RANK


def linked(side: str = "") -> Column:
    """Not replaced by another fact (the link alone)."""
    return field("superseded_by", side).isNull()


def live(now: datetime, side: str = "") -> Column:
    until = field("occurred_until", side)
    return linked(side) & (until.isNull() | (until > F.lit(now)))


def expired(now: datetime, side: str = "") -> Column:
    """Its period closed without a successor. Reads superseded_at, not the
    link: a lost link still is a supersession."""
    until = field("occurred_until", side)
    return field("superseded_at", side).isNull() & until.isNotNull() & (until <= F.lit(now))


def held_at(instant: datetime, side: str = "") -> Column:
    """Half-open valid time; an unknown start is when the store learnt of it."""
    start = F.coalesce(field("occurred_at", side), field("created_at", side))
    until = field("occurred_until", side)
    return (start <= F.lit(instant)) & (until.isNull() | (until > F.lit(instant)))


def pattern_matches(pattern: str, namespace: str | Column = "namespace") -> Column:
    """A trailing star makes a prefix; there are no other wildcards."""
    pattern = pattern.strip().lower()
    if pattern.endswith("*"):
        return F.startswith(_c(namespace), F.lit(pattern[:-1]))
    return _c(namespace) == pattern


def any_of(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def readable(grants: Iterable[Grant], side: str = "") -> Column:
    """Some grant matches the namespace at the row's level or above. No grants
    read nothing."""
    rank = sensitivity_rank(field("sensitivity", side))
    return any_of(pattern_matches(p, field("namespace", side)) & (rank <= rank_of(top)) for p, top in grants)


def within(ceilings: Iterable[Ceiling], side: str = "") -> Column:
    """Resolved ceilings: of a namespace listed twice the lower one holds. The
    namespaces of a level are one ``IN`` list, which reaches the scan."""
    least: dict[str, int] = {}
    for namespace, top in ceilings:
        least[namespace] = min(rank_of(top), least.get(namespace, UNKNOWN_RANK + 1))
    rank, namespace = sensitivity_rank(field("sensitivity", side)), field("namespace", side)
    by_rank: dict[int, list[str]] = {}
    for name, r in least.items():
        by_rank.setdefault(r, []).append(name)
    return any_of(namespace.isin(sorted(names)) & (rank <= r) for r, names in sorted(by_rank.items()))


def within_table(df: DataFrame, ceilings: DataFrame) -> DataFrame:
    """The same for ceilings in a table (namespace, max): an equi-join."""
    least = ceilings.groupBy("namespace").agg(F.min(sensitivity_rank("max")).alias("max_rank"))
    return df.join(least, "namespace").filter(sensitivity_rank() <= F.col("max_rank")).drop("max_rank")


def readable_table(df: DataFrame, grants: DataFrame) -> DataFrame:
    """The same for grants in a table (pattern, max): a semi-join. Patterns are
    compared with all prefixes of a namespace by equality, so it needs no
    nested loop: a namespace of n characters has n + 2 keys."""
    star = F.trim(F.lower("pattern"))
    keyed = grants.select(F.when(F.endswith(star, F.lit("*")), star).otherwise(F.concat(F.lit("="), star)).alias("key"), sensitivity_rank("max").alias("top")).groupBy("key").agg(F.max("top").alias("top"))
    names = df.select("namespace").distinct()
    prefixes = F.transform(F.sequence(F.lit(0), F.length("namespace")), lambda n: F.concat(F.substring("namespace", F.lit(1), n), F.lit("*")))
    keys = names.select("namespace", F.explode(F.array_union(prefixes, F.array(F.concat(F.lit("="), F.col("namespace"))))).alias("key"))
    tops = keys.join(keyed, "key").groupBy("namespace").agg(F.max("top").alias("top"))
    return df.join(tops, "namespace").filter(sensitivity_rank() <= F.col("top")).drop("top")


def in_scope(scope: str | None) -> Column:
    """No scope is everything, a trailing star a prefix, else the namespace."""
    return F.lit(True) if not scope else pattern_matches(scope)


def at_or_below(level: str) -> Column:
    """The ceiling of the cleanup queries: sealed admits all levels."""
    if level == "open":
        return F.col("sensitivity") == "open"
    return F.col("sensitivity").isin("open", "private") if level == "private" else F.lit(True)


def has_tags(need: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, need)), F.col("tags"))) == 0 if need else F.lit(True)


def overlaps_tags(some: list[str]) -> Column:
    return F.arrays_overlap("tags", F.array(*map(F.lit, some)))


def before_cursor(created_at: datetime, id_: object) -> Column:
    """Keyset paging, newest first."""
    return F.struct(F.col("created_at"), F.col("id")) < F.struct(F.lit(created_at).alias("created_at"), F.lit(id_).alias("id"))


def confirm_hidden(now: datetime, days: int) -> Column:
    """Not confirmed within the window, which is a day at least."""
    at = F.col("last_confirmed_at")
    return at.isNull() | (at < days_before(now, max(days, 1)))


def days_before(now: datetime, days: int) -> Column:
    return F.lit(now) - F.make_dt_interval(days=F.lit(days))


def use_boost(count: str | Column = "access_count") -> Column:
    return F.least(F.log1p(_c(count).cast("double")) / F.log(F.lit(11.0)), F.lit(1.0))


def differs(a: Column, b: Column) -> Column:
    """Null-safe difference."""
    return ~a.eqNullSafe(b)


def of_tenant(df: DataFrame, tenant: str) -> DataFrame:
    return df.filter(F.col("tenant") == tenant)
