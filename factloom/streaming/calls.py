"""Streams of calls and of shown facts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import ECHO_DAYS, ECHO_SLACK, Fence
from ..operators.telemetry import session_key


def files(spark: SparkSession, path: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; offsets are in the checkpoint."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def hourly(calls: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Calls and failures by hour and operation, given out once the watermark passes the hour."""
    return calls.withWatermark("created_at", late).groupBy(F.window("created_at", "1 hour").alias("w"), "tool").agg(F.count("*").alias("calls"), F.count_if(~F.col("succeeded")).alias("failures")).select(F.col("w.start").alias("hour"), "tool", "calls", "failures")


def sliding(calls: DataFrame, length: str = "24 hours", step: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return calls.withWatermark("created_at", late).groupBy(F.window("created_at", length, step).alias("w"), "client").agg(F.count("*").alias("calls")).select(F.col("w.end").alias("until"), "client", "calls")


def sessions(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """Calls by client and session id, or hour where there is none."""
    return calls.withWatermark("created_at", late).groupBy(F.window("created_at", "1 hour").alias("w"), "client", session_key().alias("bucket")).agg(F.count("*").alias("calls"))


def gap_sessions(calls: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return calls.withWatermark("created_at", late).groupBy(F.session_window("created_at", gap).alias("w"), "client").agg(F.count("*").alias("calls")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "client", "calls")


def first_seen(facts: DataFrame, late: str = "90 days") -> DataFrame:
    """Each digest once within the watermark."""
    return facts.withWatermark("observed_at", late).dropDuplicatesWithinWatermark(["content_sha256"])


def echoes(emissions: DataFrame, probes: DataFrame, slack: int = ECHO_SLACK, days: int = ECHO_DAYS) -> DataFrame:
    """What was said joined to what had been shown before, both as streams: the
    bounds on time let each side forget."""
    e = emissions.withWatermark("first_emitted_at", f"{slack} seconds").alias("e")
    p = probes.withWatermark("observed_at", f"{slack} seconds").alias("p")
    on = F.expr(f"e.content_sha256 = p.content_sha256 AND e.first_emitted_at <= p.observed_at + INTERVAL {slack} SECONDS AND e.first_emitted_at >= p.observed_at - INTERVAL {days} DAYS")
    return e.join(p, on).select("e.*", *[f"p.{c}" for c in probes.columns if c != "content_sha256"])


def fences(lines: DataFrame) -> DataFrame:
    """(file_path, byte_start, text) as a stream -> the lines outside fences.
    The state of a file is the uuid that is open and where it opened; lines of
    a file come in order, as a file's reader gives them."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        opened, since = state.get if state.exists else ("", -1)
        fence = Fence(opened or None, since if since >= 0 else None)
        for pdf in batches:
            pdf = pdf.sort_values("byte_start")
            keep = [not fence.observe(t or "", int(o))[0] for t, o in zip(pdf["text"], pdf["byte_start"], strict=True)]
            yield pdf[keep][["file_path", "byte_start", "text"]]
        state.update((fence.opened or "", -1 if fence.since is None else fence.since))

    return lines.groupBy("file_path").applyInPandasWithState(run, "file_path string, byte_start long, text string", "opened string, since long", "append", "NoTimeout")


def advance(table_path: str, name: str = "through"):
    """A foreachBatch function that keeps a data-dependent watermark: the
    largest time seen, never less than before, as a small table that each
    batch writes anew under its own number."""

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        newest = batch.agg(F.max("created_at").alias(name))
        try:
            before = spark.read.parquet(table_path)
        except Exception:  # the first batch: there is no table yet
            before = newest.limit(0).withColumn("epoch", F.lit(0).cast("long"))
        top = before.filter(F.col("epoch") < epoch).agg(F.max(name).alias(name))
        newest.unionByName(top).agg(F.max(name).alias(name)).withColumn("epoch", F.lit(epoch).cast("long")).write.mode("append").parquet(table_path)

    return run
