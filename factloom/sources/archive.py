"""Archives: gzip JSON lines, a counted header and five sections in order;
and a vault of one Markdown file per fact."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import written
from ..functions.text import slug
from . import gzip_members
from .byte_lines import opened

# The sections in their order, format and version.
SECTIONS = ["memory", "registry", "alias", "registry_history", "sealed_item"]
FORMAT, VERSION = "fact-archive", 1


#: Records of a member, and what an archive may expand to by default.
MEMBER_ROWS = 50_000
MOST_BYTES, MOST_RATIO = 1 << 40, 200.0


def write(tables: dict[str, DataFrame], path: str, created_at: str, includes_superseded: bool = True, keys: dict[str, list[str]] | None = None, member_rows: int = MEMBER_ROWS) -> None:
    """A folder of gzip members which, one after the other, are one gzip file
    of JSON lines: the header with the sections' counts, then the sections,
    each by its key. A range partition each task sorts; a record's number is its
    place there after all partitions before, so that the members are cut
    alike on every run."""
    spark = next(iter(tables.values())).sparkSession
    keys = keys or {}
    parts = []
    for k, name in enumerate(SECTIONS):
        if name in tables:
            df = tables[name]
            order = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in keys.get(name, df.columns[:1])])
            parts.append(df.select(F.lit(k).alias("section_no"), order.alias("key"), F.to_json(F.struct(F.lit(name).alias("section"), *[F.col(c) for c in df.columns])).alias("value")))
    by = ("section_no", "key", "value")
    ordered = written(reduce(DataFrame.unionByName, parts).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id()), "archive")
    counts = dict.fromkeys(SECTIONS, 0) | {SECTIONS[r.section_no]: r["count"] for r in ordered.groupBy("section_no").count().collect()}
    part, before, offsets = F.shiftright("place", 33), 0, []
    for r in sorted(ordered.groupBy(part.alias("part")).count().collect()):
        offsets.append((r["part"], before))
        before += r["count"]
    nth = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)
    numbered = ordered.withColumn("part", part).join(F.broadcast(spark.createDataFrame(offsets, "part long, before long")), "part").select(nth.alias("nth"), "value")
    head = F.struct(F.lit("header").alias("section"), F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"), F.lit(created_at).alias("created_at"), F.struct(*[F.lit(counts[k]).alias(k) for k in SECTIONS]).alias("counts"), F.lit(includes_superseded).alias("includes_superseded"))
    rows = spark.range(1).select(F.lit(-1).cast("long").alias("nth"), F.to_json(head).alias("value")).unionAll(numbered)
    gzip_members.write(rows.withColumn("member", F.greatest(F.floor(F.col("nth") / member_rows), F.lit(0))), path)


def read(spark: SparkSession, path: str, schemas: dict[str, str], max_version: int = VERSION, most_bytes: int = MOST_BYTES, most_ratio: float = MOST_RATIO) -> dict[str, DataFrame]:
    """The sections as tables. Refused: what expands to more than a budget of
    bytes or of the ratio to its size (before it is expanded), no header,
    another format, a newer version, and counts that are not what the header says."""
    size = gzip_members.sizes(spark, path, most_bytes, most_ratio).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.bool_or("refused"), F.lit(False)).alias("refused")).first()
    if size.refused or size.bytes > most_bytes:
        raise ValueError(f"the archive expands to more than {most_bytes} bytes, or {most_ratio} times its size")
    lines = spark.read.text(path).withColumn("section", F.get_json_object("value", "$.section"))
    head = lines.filter("section = 'header'").select(F.from_json("value", f"format string, version int, counts struct<{','.join(f'{s}:bigint' for s in SECTIONS)}>").alias("h")).select("h.*").collect()
    if len(head) != 1 or head[0].format != FORMAT:
        raise ValueError("not an archive: it needs one header of its format")
    if head[0].version > max_version:
        raise ValueError(f"the archive's version {head[0].version} is newer than {max_version}")
    found = {r.section: r["count"] for r in lines.filter("section <> 'header'").groupBy("section").count().collect()}
    for name in SECTIONS:
        if (head[0].counts[name] or 0) != found.get(name, 0):
            raise ValueError(f"{name}: {found.get(name, 0)} records, the header says {head[0].counts[name]}")
    return {name: lines.filter(F.col("section") == name).select(F.from_json("value", ddl).alias("r")).select("r.*") for name, ddl in schemas.items()}


def _quoted(c: str | Column) -> Column:
    c = F.col(c).cast("string") if isinstance(c, str) else c
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', '\\\\"'), F.lit('"'))


def vault(memory: DataFrame, root: str = "vault") -> DataFrame:
    """(path, contents): a note for each fact at a path that its day, text and
    id give, with its data in front and links to what it replaced and what
    replaced it; of a fact that has no note here, the id."""
    day = F.date_format("created_at", "yyyy-MM-dd")
    short = F.substring(F.regexp_replace(F.col("id").cast("string"), "[^A-Za-z0-9]", ""), 1, 8)
    stem = F.concat_ws("-", day, F.nullif(slug("content", 48), F.lit("")), short)
    named = memory.withColumn("_stem", stem)
    names = named.select(F.col("id").alias("_id"), F.col("_stem").alias("_name"))
    linked = named
    for c in ("supersedes", "superseded_by"):  # by id: most facts link to none, and nulls of a key would meet in one task
        links = memory.filter(F.col(c).isNotNull()).select("id", c).join(names.toDF(c, f"_{c}"), c).drop(c)
        linked = linked.join(links, "id", "left")
    line = lambda label, value: F.concat(F.lit(label + ": "), value)
    link = lambda c: F.coalesce(F.concat(F.lit("[["), F.col(f"_{c}"), F.lit("]]")), _quoted(c))
    front = F.concat_ws(
        "\n", line("fact_id", _quoted("id")), line("namespace", _quoted("namespace")), line("sensitivity", F.col("sensitivity")), line("source_client", _quoted("source_client")), line("created_at", _quoted(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))),
        line("access_count", F.col("access_count").cast("string")), F.when(F.size("tags") > 0, line("tags", F.concat(F.lit("["), F.array_join(F.transform("tags", _quoted), ", "), F.lit("]")))),
        line("supersedes", link("supersedes")), line("superseded_by", link("superseded_by")), F.when(F.col("superseded_by").isNotNull(), "status: superseded"),
    )
    note = F.concat(F.lit("---\n"), front, F.lit("\n---\n\n"), F.when(F.col("superseded_by").isNotNull(), "> Retired. A later fact replaced this one.\n\n").otherwise(""), F.trim("content"), F.lit("\n"))
    return linked.select(F.concat_ws("/", F.lit(root), F.lit("memory"), slug("namespace", 48), F.concat("_stem", F.lit(".md"))).alias("path"), note.alias("contents"))


def write_vault(notes: DataFrame, base: str) -> DataFrame:
    """Writes each note as a file of its own and gives the manifest (path,
    bytes, sha256), which is written as JSON lines below ``_manifest`` once all
    notes are there. Tasks write what they hold; a repeated task writes the same
    bytes to the same places."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root, _ = opened(base)
        for batch in batches:
            rows = []
            for path, contents in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = contents.encode()
                fs.create_dir(f"{root}/{path}".rsplit("/", 1)[0])
                with fs.open_output_stream(f"{root}/{path}", compression=None) as out:
                    out.write(data)
                rows.append((path, len(data), hashlib.sha256(data).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["path", "bytes", "sha256"])

    manifest = notes.select("path", "contents").mapInArrow(run, "path string, bytes long, sha256 string")
    manifest.write.mode("overwrite").json(f"{base}/_manifest")
    return notes.sparkSession.read.schema("path string, bytes long, sha256 string").json(f"{base}/_manifest")
