"""Files: discovery, lines with byte offsets, integrity of what was read."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_lines
from .byte_lines import SENSITIVE

# Fixed value: the longest line that is read.
MAX_LINE = 4 << 20
RANGE_BYTES = 64 << 20


def sensitive(path: str | Column = "path") -> Column:
    """Some part of the path, in any case, holds a word of the list."""
    low = F.lower(F.col(path) if isinstance(path, str) else path)
    out = F.lit(False)
    for word in SENSITIVE:
        out = out | F.contains(low, F.lit(word))
    return out


def discover(spark: SparkSession, root: str, pattern: str = "*.jsonl", since: datetime | None = None, most: int | None = None) -> DataFrame:
    """(path, length, modified) of the files below a folder, at most so many of
    the newest; names only, no contents are read. Sensitive paths and what
    symbolic links lead to are left out."""
    after = since.replace(tzinfo=since.tzinfo or UTC).timestamp() if since else 0.0
    found = [f for f in byte_lines.listed(root, pattern) if f[2] >= after][:most]
    rows = spark.createDataFrame(found, "path string, length long, at double")
    return rows.select("path", "length", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")).alias("modified"))


def intact(marks: DataFrame) -> DataFrame:
    """(file_path, byte_offset): from where each file of marks (file_path,
    byte_offset, prefix_sha256) is to be read; 0 where the beginning is no
    longer what was read. A task hashes a file at a time, in constant memory."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                try:
                    same = r["prefix_sha256"] is None or byte_lines.digest(r["file_path"], r["byte_offset"]) == r["prefix_sha256"]
                except FileNotFoundError:
                    same = False
                out.append((r["file_path"], r["byte_offset"] if same else 0))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], names=["file_path", "byte_offset"])

    return marks.select("file_path", F.col("byte_offset").cast("long").alias("byte_offset"), "prefix_sha256").mapInArrow(run, "file_path string, byte_offset long")


def lines(spark: SparkSession, root: str, marks: DataFrame | None = None, pattern: str = "*.jsonl", max_line: int = MAX_LINE, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file_path, byte_start, byte_end, text, oversized): all whole lines after
    each file's offset in marks; a file whose beginning is no longer the one
    that was read is read from 0. The driver holds a number for each file."""
    spark.dataSource.register(byte_lines.ByteLines)
    offsets = {} if marks is None else {r.file_path: r.byte_offset for r in intact(marks).collect() if r.byte_offset}
    options = {"path": root, "pattern": pattern, "rangeBytes": str(range_bytes), "maxLine": str(max_line), "offsets": json.dumps(offsets)}
    return spark.read.format("byte_lines").options(**options).load()


def line_stream(spark: SparkSession, root: str, pattern: str = "*.jsonl", max_line: int = MAX_LINE, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The same lines as a stream, as files grow."""
    spark.dataSource.register(byte_lines.ByteLines)
    return spark.readStream.format("byte_lines").options(path=root, pattern=pattern, rangeBytes=str(range_bytes), maxLine=str(max_line)).load()


def reached(read: DataFrame) -> DataFrame:
    """(file_path, byte_offset, prefix_sha256): how far each file was read."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [byte_lines.digest(p, n) for p, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=["file_path", "byte_offset", "prefix_sha256"])

    ends = read.groupBy("file_path").agg(F.max("byte_end").alias("byte_offset"))
    return ends.mapInArrow(run, "file_path string, byte_offset long, prefix_sha256 string")
