"""Memory dumps: sections of ``[date] (confidence) - fact`` lines and an end marker."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# End markers, section routes, and words that are no project.
COMPLETE, MORE = "COMPLETE", "MORE REMAINS"
ROUTES = {"PROJECT": "project", "PROJECTS": "project", "HEALTH": "personal:health", "FINANCE": "personal:finance"}
NOT_A_NAME = ["the", "this", "that", "these", "those", "they", "user", "we", "it", "my", "our", "an", "in", "on", "is", "has", "uses", "working"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, line, text), in the order of the file."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_path"), F.split(F.decode("content", "UTF-8"), r"\r?\n").alias("l"))
    return raw.select("file_path", F.posexplode("l").alias("pos", "text")).select("file_path", (F.col("pos") + 1).alias("line"), "text")


def parse(lines: DataFrame, today: date) -> DataFrame:
    """lines with kind (blank, end, section, entry, unrecognised), section,
    occurred_at, confidence, content, namespace, ending, dropped. In a dump
    that breaks off the last entry may be half a fact and is dropped; a date
    after today is taken off its fact."""
    t = F.trim("text")
    header = (F.length(t) >= 4) & F.rlike(t, F.lit(r"^[A-Z &-]+$")) & F.rlike(t, F.lit("[A-Z]"))
    entry = r"^\[(unknown|\d{4}-\d{2}-\d{2})\]\s*(?:\((stated|inferred)\))?\s*-\s*(\S.*)$"
    kind = F.when(t == "", "blank").when(t.isin(COMPLETE, MORE), "end").when(header, "section").when(F.rlike(t, F.lit(entry)), "entry").otherwise("unrecognised")
    order = W.partitionBy("file_path").orderBy("line")
    whole = W.partitionBy("file_path")
    rows = lines.withColumns({"t": t, "kind": kind})
    rows = rows.withColumn("section", F.coalesce(F.last(F.when(F.col("kind") == "section", F.col("t")), ignorenulls=True).over(order), F.lit("UNSECTIONED")))
    is_entry = F.col("kind") == "entry"
    said = F.try_to_timestamp(F.regexp_extract("t", entry, 1), F.lit("yyyy-MM-dd")).cast("date")
    rows = rows.withColumns(
        {
            "ending": F.coalesce(F.last(F.when(F.col("kind") == "end", F.col("t")), ignorenulls=True).over(whole.orderBy("line").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.lit("TRUNCATED")),
            "said": F.when(is_entry, said),
            "confidence": F.when(is_entry, F.when(F.regexp_extract("t", entry, 2) == "inferred", "inferred").otherwise("stated")),
            "content": F.when(is_entry, F.trim(F.regexp_extract("t", entry, 3))),
            "last_entry": F.max(F.when(is_entry, F.col("line"))).over(whole),
        }
    )
    route = F.lit("user:me")
    for name, to in ROUTES.items():
        route = F.when(F.col("section") == name, to).otherwise(route)
    first = F.lower(F.regexp_replace(F.regexp_extract("content", r"^(\S+)", 1), r"[^\p{L}\p{N}]+$", ""))
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(first, "['’]s$", ""), r"[^a-z0-9._]+", "-"), "^-+|-+$", "")
    slug = F.when((F.length(name) >= 2) & ~name.isin(*NOT_A_NAME) & F.rlike(name, F.lit("^[a-z0-9]")), F.substring(name, 1, 127))
    space = F.when(route == "project", F.coalesce(F.concat(F.lit("project:"), slug), F.lit("user:me"))).otherwise(route)
    late = F.col("said") > F.lit(today)
    return rows.select(
        "file_path", "line", "kind", "section", F.when(~F.coalesce(late, F.lit(False)), F.col("said")).alias("occurred_at"), F.coalesce(late, F.lit(False)).alias("future_dated"), "confidence", "content", F.when(is_entry, space).alias("namespace"), "ending",
        (is_entry & (F.col("ending") == "TRUNCATED") & (F.col("line") == F.col("last_entry"))).alias("dropped"),
    )
