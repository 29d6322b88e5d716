"""Plumbing shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: What the contracts call a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python worker turns into numpy arrays at once.
CHUNK_BYTES = 1 << 20


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``; only in local mode,
    where one machine is the whole cluster, an unset one falls back to a
    temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends here
    and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def anchored(docs: DataFrame, name: str) -> tuple[DataFrame, str, str]:
    """docs with two columns more, whose names follow: a hash of the file and
    the place in it from which each row comes. They name a row in any later
    read of it, so that what is decided about a row needs no copy of the row. A
    table that isn't read from Parquet files as it is, is written to some first."""
    file, place = fresh(docs, "from_file", "from_place")
    for frame in (docs, None):
        frame = frame or written(docs, name)
        try:
            meta = frame.metadataColumn("_metadata")
            return frame.withColumns({file: F.xxhash64(meta["file_path"]), place: meta["row_index"]}), file, place
        except AnalysisException:
            continue
    raise ValueError("the shared folder gives no places of rows")


def drop_written(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(os.path.dirname(file))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_hash(column: str | Column, salt: int) -> Column:
    """A uniform number in [0, 1) that depends on the id alone."""
    return F.pmod(F.xxhash64(F.col(column) if isinstance(column, str) else column, F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def crc_mod(column: str, divisor: int) -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(divisor))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that df has not, whatever their case."""
    taken = {c.lower() for c in df.columns}
    return [next(c for k in range(len(taken) + 1) if (c := name + "_" * k).lower() not in taken) for name in names]


def wider(df: DataFrame, **more: str) -> StructType:
    """The schema of df with more fields, by name and type."""
    extra = [StructField(name, _parse_datatype_string(kind)) for name, kind in more.items()]
    return StructType([*df.schema.fields, *extra])


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most ``limit`` bytes of text each; a
    row longer than that comes alone."""
    offsets = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
    start = 0
    while start < batch.num_rows:
        before = offsets[start - 1] if start else 0
        end = max(start + 1, int(offsets.searchsorted(before + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end
