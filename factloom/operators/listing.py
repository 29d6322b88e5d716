"""Pages of facts, and counts over them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import Ceiling, Grant, at_or_below, before_cursor, confirm_hidden, days_before, expired, has_tags, in_scope, linked, live, overlaps_tags, readable, sensitivity_rank, within
from ..functions.text import normal_tags

#: Page sizes, as (default, most).
PAGES = {"search": (8, 50), "review": (50, 200), "review_scan": (50, 2000), "history": (20, 200), "export": (20000, 20000)}


def page_size(kind: str, asked: int | None) -> int:
    default, most = PAGES[kind]
    return min(max(asked or default, 1), most)


def by_id(memory: DataFrame, id_: object) -> DataFrame:
    return memory.filter(F.col("id") == F.lit(id_))


def by_ids(memory: DataFrame, ids: Sequence[object]) -> DataFrame:
    return memory.filter(F.col("id").isin(list(ids)))


def exact(memory: DataFrame, namespace: str, content: str, now: datetime) -> DataFrame:
    """The newest live fact with just this text."""
    same = memory.filter((F.col("namespace") == namespace) & (F.col("content") == content) & live(now))
    return same.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(1)


def whole_store(memory: DataFrame, limit: int, after: object | None = None) -> DataFrame:
    rows = memory if after is None else memory.filter(F.col("id") > F.lit(after))
    return rows.orderBy("id").limit(limit)


def for_export(memory: DataFrame, top: str, now: datetime, limit: int, offset: int = 0) -> DataFrame:
    return memory.filter(live(now) & at_or_below(top)).orderBy("created_at", "id").offset(offset).limit(page_size("export", limit))


def sample(memory: DataFrame, ceilings: Iterable[Ceiling], n: int, seed: int = 0) -> DataFrame:
    """Contents picked by a hash of the id: random in effect, the same again."""
    rows = memory.filter(within(ceilings) & linked() & F.col("content").isNotNull())
    return rows.orderBy(F.md5(F.concat_ws("-", F.lit(seed), F.col("id"))), "id").limit(n).select("id", "content")


def recent(memory: DataFrame, ceilings: Iterable[Ceiling], limit: int, *, now: datetime, namespace: str | None = None, cursor: tuple | None = None, history: bool = False, tags: Sequence[str] = ()) -> DataFrame:
    rows = memory.filter(within(ceilings) & has_tags(list(tags)))
    rows = rows if history else rows.filter(live(now))
    rows = rows if namespace is None else rows.filter(F.col("namespace") == namespace)
    rows = rows if cursor is None else rows.filter(before_cursor(*cursor))
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def undated(memory: DataFrame, ceilings: Iterable[Ceiling], limit: int, now: datetime) -> DataFrame:
    rows = memory.filter(within(ceilings) & F.col("occurred_at").isNull() & live(now))
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def retired_since(memory: DataFrame, ceilings: Iterable[Ceiling], since: datetime, limit: int, now: datetime) -> DataFrame:
    """What left the live reads: replaced, or ended without a successor."""
    next_ = memory.select(F.col("id").alias("successor_id"), F.col("namespace").alias("successor_namespace"))
    gone = (F.col("superseded_at").isNotNull() & (F.col("superseded_at") >= F.lit(since))) | (expired(now) & (F.col("occurred_until") >= F.lit(since)))
    at = F.coalesce("superseded_at", "occurred_until")
    page = memory.filter(within(ceilings) & gone).withColumns({"retired_at": at, "expired": expired(now), "end_open": F.col("occurred_at").isNotNull() & F.col("occurred_until").isNull()})
    top = page.orderBy(F.col("retired_at").desc(), F.col("id").desc()).limit(limit)  # the join adds no rows, so it follows the limit
    joined = top.join(next_, top.superseded_by == next_.successor_id, "left")
    return joined.select("id", "namespace", "content", "sensitivity", "occurred_at", "occurred_until", "retired_at", "expired", "end_open", "successor_id", "successor_namespace")


def stale(memory: DataFrame, grants: Iterable[Grant], days: int, limit: int, now: datetime, offset: int = 0) -> DataFrame:
    rows = memory.filter(live(now) & F.col("last_accessed_at").isNull() & (F.col("created_at") < days_before(now, days)) & confirm_hidden(now, days) & readable(grants))
    return rows.orderBy("created_at", "id").offset(offset).limit(limit)


def unread(memory: DataFrame, grants: Iterable[Grant], days: int, limit: int, now: datetime, level: str = "sealed", scope: str | None = None) -> DataFrame:
    rows = in_cleanup(memory, grants, now, level, scope).filter((F.col("access_count") == 0) & F.col("last_confirmed_at").isNull() & (F.col("created_at") < days_before(now, days)))
    return rows.orderBy("created_at", "id").limit(limit)


def in_cleanup(memory: DataFrame, grants: Iterable[Grant], now: datetime, level: str = "sealed", scope: str | None = None) -> DataFrame:
    """What all cleanup queries look at."""
    return memory.filter(live(now) & F.col("content").isNotNull() & at_or_below(level) & in_scope(scope) & readable(grants))


def tagged_dated(memory: DataFrame, grants: Iterable[Grant], tag: str, now: datetime, level: str = "sealed", limit: int = 500) -> DataFrame:
    rows = memory.filter(live(now) & F.col("occurred_at").isNotNull() & F.array_contains("tags", tag) & at_or_below(level) & readable(grants))
    return rows.orderBy(F.col("occurred_at").desc(), F.col("id").desc()).limit(limit)


def newest_in_scope(memory: DataFrame, grants: Iterable[Grant], now: datetime, level: str = "sealed", scope: str | None = None) -> DataFrame:
    return in_cleanup(memory, grants, now, level, scope).agg(F.max("created_at").alias("newest"))


def namespace_counts(memory: DataFrame, registry: DataFrame) -> DataFrame:
    """Facts without a successor by namespace; namespaces that only the
    registry knows count none."""
    counted = memory.filter(linked()).groupBy("namespace").agg(F.count("*").alias("n"))
    return counted.unionByName(registry.select("namespace").distinct().withColumn("n", F.lit(0).cast("long"))).groupBy("namespace").agg(F.sum("n").alias("n"))


def namespace_summary(memory: DataFrame, ceilings: Iterable[Ceiling], now: datetime) -> DataFrame:
    alive = live(now)
    return memory.filter(within(ceilings)).groupBy("namespace").agg(
        F.count_if(alive).alias("live"), F.count_if(F.col("superseded_by").isNotNull()).alias("retired"), F.count_if(alive & (sensitivity_rank() > 0)).alias("above_open"), F.max("created_at").alias("last_write")
    )


def tag_summary(memory: DataFrame, ceilings: Iterable[Ceiling], now: datetime) -> DataFrame:
    """Live facts by tag; a tag that a fact has twice counts once, and so the
    count needs no distinct."""
    rows = memory.filter(within(ceilings) & live(now)).select(F.explode(F.array_distinct("tags")).alias("tag"))
    return rows.groupBy("tag").agg(F.count("*").alias("live")).orderBy(F.col("live").desc(), "tag")


def live_embedded_counts(memory: DataFrame, grants: Iterable[Grant], now: datetime) -> DataFrame:
    rows = memory.filter(live(now) & F.col("embedding").isNotNull() & readable(grants))
    return rows.groupBy("namespace").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "namespace")


def rows_by_table(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table in each user namespace."""
    parts = [df.filter(F.startswith("namespace", F.lit("user:"))).groupBy("namespace").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "namespace", "n") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def pair_counts(memory: DataFrame, grants: Iterable[Grant]) -> DataFrame:
    """What supersession did to the periods that it closed, over pairs of which
    both sides can be read."""
    m = memory.filter(readable(grants) & F.col("superseded_by").isNotNull()).select("superseded_by", "occurred_at", "occurred_until")
    s = memory.filter(readable(grants)).select(F.col("id").alias("superseded_by"), F.col("occurred_at").alias("next_at"))
    dated = F.col("occurred_at").isNotNull()
    return m.join(s, "superseded_by").agg(
        F.count("*").alias("pairs"), F.count_if(F.col("occurred_until").isNotNull()).alias("closed"), F.count_if(dated & F.col("occurred_until").isNull()).alias("dated_but_open"), F.count_if(dated & F.col("next_at").isNotNull()).alias("both_dated")
    )


def staleness(memory: DataFrame, now: datetime) -> DataFrame:
    """How much of the store is read: counts, share (2 places), median age in
    days of what was never read, and the oldest of it."""
    never = live(now) & F.col("last_accessed_at").isNull()
    age = (F.lit(now).cast("timestamp").cast("double") - F.col("created_at").cast("double")) / 86400
    counted = memory.agg(
        F.count_if(live(now)).alias("live"), F.count_if(never).alias("never_accessed"), F.expr("0").alias("_"), F.percentile(F.when(never, age), F.lit(0.5)).alias("median"), F.max(F.when(never, age)).alias("oldest")
    )
    share = F.when(F.col("live") > 0, F.round(F.col("never_accessed") * 100.0 / F.col("live"), 2)).otherwise(0.0)
    return counted.select("live", "never_accessed", share.alias("pct_never"), F.round("median", 2).alias("median_age_days"), F.round("oldest", 2).alias("max_age_days"))


def dating_compliance(memory: DataFrame, within_seconds: int) -> DataFrame:
    gap = F.abs(F.unix_micros(F.col("occurred_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp")))
    return memory.agg(F.count("*").alias("total"), F.count("occurred_at").alias("dated"), F.count_if(gap <= within_seconds * 1_000_000).alias("near_created_at"))


def digest(memory: DataFrame, registry: DataFrame, ceilings: Iterable[Ceiling], now: datetime, *, profile: str = "user:me", project: str | None = None, sizes: tuple[int, int, int, int] = (10, 10, 10, 50), days: int = 30) -> dict[str, DataFrame]:
    """What a session starts from, as seven small frames over one filtered
    base: profile, project, recent and registry lists, two counts, and the
    live facts by namespace."""
    ceilings = list(ceilings)
    base = memory.filter(within(ceilings) & live(now))
    entries = registry.filter(within(ceilings))
    newest = [F.col("created_at").desc(), F.col("id").desc()]
    return {
        "profile": base.filter(F.col("namespace").isin(profile, "global")).orderBy(overlaps_tags(["profile", "preference", "identity"]).desc(), *newest).limit(sizes[0]),
        "project_context": (base.filter(F.col("namespace") == project) if project else base.limit(0)).orderBy(*newest).limit(sizes[1]),
        "recent": base.filter(F.col("created_at") > days_before(now, days)).orderBy(*newest).limit(sizes[2]),
        "registry": entries.orderBy("kind", "key", "namespace").limit(sizes[3]),
        "memories_count": base.agg(F.count("*").alias("n")),
        "registry_count": entries.agg(F.count("*").alias("n")),
        "by_namespace": base.groupBy("namespace").agg(F.count("*").alias("n")),
    }


def bootstrap(parts: dict[str, DataFrame], budget: int = 6000) -> DataFrame:
    """The digest as lines of text (section, position, line): a fact shows in
    the first section that has it, and lines stop where the budget of
    characters is used up. The parts are pages, so one window holds them all."""
    from pyspark.sql import Window as W

    from ..functions.text import one_line

    order = ["profile", "project_context", "recent"]
    rows = None
    for k, name in enumerate(order):
        part = parts[name].select(F.lit(k).alias("section_no"), F.lit(name).alias("section"), "id", "created_at", one_line("content").alias("line"))
        rows = part if rows is None else rows.unionByName(part)
    first = rows.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy("section_no"))).filter("_n = 1").drop("_n")
    place = W.orderBy("section_no", F.col("created_at").desc(), F.col("id").desc())
    used = F.sum(F.length("line") + 1).over(place.rowsBetween(W.unboundedPreceding, 0))
    return first.withColumns({"position": F.row_number().over(place), "used": used}).filter(F.col("used") <= budget).select("section", "position", "id", "line")


def with_normal_tags(df: DataFrame) -> DataFrame:
    return df.withColumn("tags", normal_tags("tags"))
