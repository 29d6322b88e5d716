"""Who may read and write what: grants, ceilings, levels of new facts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.predicates import LEVELS, Ceiling, Grant, any_of, pattern_matches, rank_of, sensitivity_rank

#: What each callable operation needs.
CAPABILITIES = {
    "memory_search": "read",
    "memory_write": "write",
    "memory_forget": "delete",
    "memory_history": "history",
    "context_bootstrap": "read",
    "registry_get": "read",
    "registry_set": "write",
    "registry_history": "history",
    "alias_put": "write",
    "namespaces_list": "read",
    "review_queue": "read",
    "review_decide": "write",
}


def matches(pattern: str, namespace: str) -> bool:
    pattern = pattern.strip().lower()
    return namespace.startswith(pattern[:-1]) if pattern.endswith("*") else namespace == pattern


def ceiling(grants: Iterable[Grant], namespace: str) -> str | None:
    """The highest level over all matching grants; None when none matches."""
    tops = [top for pattern, top in grants if matches(pattern, namespace)]
    return max(tops, key=rank_of, default=None)


def resolve(grants: Sequence[Grant], namespaces: Iterable[str]) -> list[Ceiling]:
    return [(n, top) for n in namespaces if (top := ceiling(grants, n)) is not None]


def ceilings(grants: Sequence[Grant], namespace: str | Column = "namespace") -> Column:
    """The highest level that the matching grants give, null where none matches."""
    n = F.col(namespace) if isinstance(namespace, str) else namespace
    held = lambda level: any_of(pattern_matches(p, n) for p, top in grants if top == level)
    return F.coalesce(*[F.when(held(level), level) for level in reversed(LEVELS)])


def admits(grants: Sequence[Grant], namespace: str, level: str) -> bool:
    top = ceiling(grants, namespace)
    return top is not None and rank_of(level) <= rank_of(top)


def covers(grants: Sequence[Grant], scope: str | None) -> bool:
    """Whether one grant at the highest level takes in a whole scope."""
    wanted = (scope or "*").strip().lower()
    for pattern, top in grants:
        pattern = pattern.strip().lower()
        if top != "sealed":
            continue
        if pattern == wanted or pattern.endswith("*") and wanted.rstrip("*").startswith(pattern[:-1]):
            return True
    return False


def permits(capabilities: Iterable[str], operation: str) -> bool:
    need = CAPABILITIES.get(operation)
    return need is not None and need in set(capabilities)


def default_level(df: DataFrame, rules: DataFrame, requested: str | Column | None = None) -> DataFrame:
    """df with ``level``: that of the longest matching pattern (of equal ones
    the smaller text), else open; a request may raise it, never lower it.

    rules: (pattern, sensitivity). The patterns meet the distinct namespaces,
    not the rows, and meet them by equality: each namespace asks with itself
    and with all its beginnings.
    """
    star = F.endswith("pattern", F.lit("*"))
    stem = F.when(star, F.expr("left(pattern, length(pattern) - 1)")).otherwise(F.col("pattern"))
    clean = rules.select(F.trim(F.lower("pattern")).alias("pattern"), F.col("sensitivity").alias("rule_level")).withColumns({"star": star, "stem": stem})
    asks = F.expr("transform(sequence(0, length(namespace) + 1), k -> IF(k > length(namespace), struct(false AS star, namespace AS stem), struct(true AS star, left(namespace, k) AS stem)))")
    names = df.select("namespace").distinct().select("namespace", F.inline(asks))
    best = names.join(clean, ["star", "stem"]).groupBy("namespace").agg(F.min_by("rule_level", F.struct(-F.length("pattern"), F.col("pattern"))).alias("rule_level"))
    level = F.coalesce("rule_level", F.lit("open"))
    joined = df.join(best, "namespace", "left")
    if requested is not None:
        asked = F.col(requested) if isinstance(requested, str) else requested
        level = F.when(sensitivity_rank(asked) > sensitivity_rank(level), asked).otherwise(level)
    return joined.withColumn("level", level).drop("rule_level")


def first_rule_level(namespace: str | Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The level of the first rule that matches, in the order given; else open."""
    level = F.lit("open")
    for pattern, rule_level in reversed(rules):
        level = F.when(pattern_matches(pattern, namespace), F.lit(rule_level)).otherwise(level)
    return level


def visible_at_level(grants: Sequence[Grant], level: Column, namespace: str = "namespace") -> Column:
    """Some grant matches the namespace and reaches a level."""
    return any_of(pattern_matches(p, namespace) & (sensitivity_rank(level) <= rank_of(top)) for p, top in grants)


def visible_proposals(proposals: DataFrame, members: DataFrame, memory: DataFrame, grants: Sequence[Grant]) -> DataFrame:
    """Proposals in a granted namespace none of whose members is out of reach;
    a member whose row is gone blocks nothing."""
    from ..functions.predicates import readable

    hidden = members.join(memory.select(F.col("id").alias("memory_id"), "namespace", "sensitivity"), "memory_id").filter(~readable(grants)).select(F.col("proposal_id").alias("id"))
    granted = any_of(pattern_matches(p) for p, _ in grants)
    return proposals.filter(granted).join(hidden, "id", "left_anti")


def strictest(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of rows that name a key twice the lower level."""
    w = W.partitionBy(*keys).orderBy(sensitivity_rank("max"))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
