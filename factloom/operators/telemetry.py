"""Statistics of calls."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which operations read and write, and how far back to look.
READS = ["memory_search", "context_bootstrap", "registry_get"]
WRITES = ["memory_write", "registry_set"]
HOURS, MOST_HOURS = 168, 2160


def look_back(now: datetime, hours: int) -> Column:
    return F.col("created_at") > F.lit(now) - F.make_dt_interval(hours=F.lit(min(max(hours, 1), MOST_HOURS)))


def session_key() -> Column:
    """The session, or the hour for calls that name none."""
    return F.coalesce("session_id", F.concat(F.lit("hour:"), F.date_format("created_at", "yyyy-MM-dd HH")))


def tool_stats(calls: DataFrame, now: datetime, hours: int = HOURS) -> DataFrame:
    at = lambda p: F.expr(f"cast(percentile_disc({p}) within group (order by latency_ms) as int)")
    return calls.filter(look_back(now, hours)).groupBy("tool", "client").agg(
        F.count("*").alias("calls"), F.count_if(~F.col("succeeded")).alias("failures"), F.count_if(F.col("unprompted")).alias("unprompted"), at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms")
    )


def client_stats(calls: DataFrame, now: datetime, hours: int = HOURS, reads: Sequence[str] = READS, writes: Sequence[str] = WRITES) -> DataFrame:
    """Counts by client. Sessions are counted in two steps, by (client, session)
    first, so that no distinct of sessions needs one task."""
    read, write = F.col("tool").isin(*reads), F.col("tool").isin(*writes)
    told = F.col("unprompted").eqNullSafe(F.lit(True))
    per = calls.filter(look_back(now, hours)).groupBy("client", session_key().alias("bucket")).agg(
        F.count("*").alias("calls"), F.count_if(read).alias("reads"), F.count_if(write).alias("writes"), F.count_if(~F.col("succeeded")).alias("failures"), F.max(told & read).alias("ur"), F.max(told & write).alias("uw")
    )
    return per.groupBy("client").agg(
        *[F.sum(c).alias(c) for c in ("calls", "reads", "writes", "failures")], F.count("bucket").alias("sessions"), F.count_if("ur").alias("sessions_with_unprompted_read"), F.count_if("uw").alias("sessions_with_unprompted_write")
    )


def rate(part: str, whole: str) -> Column:
    """Four places; nothing where there is nothing to divide by."""
    return F.when(F.col(whole) > 0, F.round(F.col(part) / F.col(whole), 4))


def client_rates(stats: DataFrame) -> DataFrame:
    return stats.withColumns(
        {"unprompted_read_rate": rate("sessions_with_unprompted_read", "sessions"), "unprompted_write_rate": rate("sessions_with_unprompted_write", "sessions"), "writes_per_read": rate("writes", "reads"), "failure_rate": rate("failures", "calls")}
    )


def totals(stats: DataFrame, client: str | None = None) -> DataFrame:
    """Sums over all clients for those who may see the whole store, else over
    one's own calls."""
    rows = stats if client is None else stats.filter(F.col("client") == client)
    return rows.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.coalesce(F.sum("failures"), F.lit(0)).alias("failures"), F.count("*").alias("rows"))


def record(calls: DataFrame, new: DataFrame) -> DataFrame:
    return calls.unionByName(new, allowMissingColumns=True)


def hourly(calls: DataFrame) -> DataFrame:
    return calls.groupBy(F.window("created_at", "1 hour").alias("w"), "tool").agg(F.count("*").alias("calls"), F.count_if(~F.col("succeeded")).alias("failures")).select(F.col("w.start").alias("hour"), "tool", "calls", "failures")
