"""The corpus pipeline: five stages from raw documents to a mixed corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents, whatever further ones there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import entropy_mix, langid, secret_scan, simhash_bk, template_decontam
from factloom.llm._shared import crc_mod, drop_written, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (null or empty texts, no letters,
    or below the calibrated threshold) go; each row is judged by its own text,
    with or without an id, repeated rows alike. An empty table stays empty."""
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    model = langid.fit(docs, F.col("doc_id").isNotNull() & ~held_out)
    named, _, _, rejected = langid.predict(docs, model)
    return named.filter(~F.col(rejected)).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, the one with the
    smallest id (null is the largest). Rows are told apart by their texts, so
    unlike texts under one id or without an id stay; null and empty texts are
    one group; repeated rows leave one."""
    return simhash_bk.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item, also with other parameters, go,
    with or without an id, repeated rows alike. Null and empty texts stay."""
    return template_decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; all rows stay, null and empty texts
    and null ids as they are, repeated rows alike."""
    return secret_scan.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, with their size, number of copies and words
    taken and their source's target; those taken no time (wordless ones among
    them) go. Null ids and null sources are mixed like others, repeated rows
    have copies of their own."""
    return entropy_mix.taken(docs)[0]


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixing", mixing),
]

#: SQL can't express the stages; tests hold each to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop_written(spark, before)
        before = docs
    return docs
