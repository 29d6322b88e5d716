"""Question sets for retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_haystack_date

QUESTION = "question_id string, question_type string, question string, answer string, question_date string, haystack_session_ids array<string>, haystack_dates array<string>, answer_session_ids array<string>, haystack_sessions array<array<struct<role:string,content:string>>>"
#: A question set smaller than this is a mistake, not a benchmark.
LEAST = 100


def questions(spark: SparkSession, path: str, least: int = LEAST) -> DataFrame:
    """One row per question of a JSON array."""
    df = spark.read.schema(QUESTION).option("multiLine", "true").json(path)
    if (n := df.limit(least).count()) < least:
        raise ValueError(f"{n} questions; {least} are needed")
    return df


def sessions(df: DataFrame) -> DataFrame:
    """(question_id, session_id, at, turns, gold): each question's sessions."""
    zipped = F.arrays_zip(F.col("haystack_session_ids").alias("i"), F.col("haystack_dates").alias("d"), F.col("haystack_sessions").alias("t"))
    rows = df.select("question_id", "answer_session_ids", F.explode(zipped).alias("s"))
    return rows.select("question_id", F.col("s.i").alias("session_id"), parse_haystack_date("s.d").alias("at"), F.col("s.t").alias("turns"), F.array_contains("answer_session_ids", F.col("s.i")).alias("gold"))


def cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases, refused) of JSON lines with a question and either ``expect_id``
    or ``"expect": "none"``, not both and not neither."""
    raw = spark.read.schema("question string, expect_id string, expect string, origin string").json(path)
    none = F.col("expect") == "none"
    good = (F.trim("question") != "") & (F.col("expect_id").isNotNull() & F.col("expect").isNull() | F.col("expect_id").isNull() & none)
    return raw.filter(F.coalesce(good, F.lit(False))).select("question", "expect_id", "origin"), raw.filter(~F.coalesce(good, F.lit(False)))
