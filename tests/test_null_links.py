"""Rows without a link do not meet in one task."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import ingest
from factloom.sources import archive


@pytest.fixture
def shuffled(spark):
    values = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def largest(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_proposals_without_a_fact(shuffled):
    rows = shuffled.range(0, 800, 1, 4).select("id", F.when(F.col("id") < 80, F.col("id")).alias("memory_id"), F.lit("words").alias("content"), F.lit("quote").alias("quote"), F.lit("written").alias("state"))
    before = shuffled.range(80).select("id", F.lit("a").alias("content"))
    after = before.withColumn("content", F.when(F.col("id") % 2 == 0, "a"))
    sealed = ingest.sealed_later(rows, before, after)
    assert sealed.count() == 800 and sealed.filter("content = ''").count() == 40 and largest(sealed) < 400
    decided = ingest.clear_plaintext(rows, after)
    assert decided.count() == 800 and decided.filter("content is null").count() == 760 and largest(decided) < 400
    relinked = ingest.relinked(rows, rows.withColumn("memory_id", F.when(F.col("id") >= 40, F.col("id") % 80)), after)
    assert relinked.count() == 800 and relinked.filter("content = ''").count() == 40 + 360


def test_notes_that_replaced_nothing(shuffled):
    facts = shuffled.range(0, 800, 1, 4).selectExpr(
        "id", "concat('fact ', id) AS content", "'global' AS namespace", "'open' AS sensitivity", "'c' AS source_client", "timestamp'2024-01-01' AS created_at", "0L AS access_count", "array('t') AS tags",
        "if(id = 5, 3L, null) AS supersedes", "if(id = 3, 5L, null) AS superseded_by")
    notes = archive.vault(facts)
    assert largest(notes) < 400
    found = {r.contents.split("fact_id: \"")[1].split("\"")[0]: r.contents for r in notes.collect()}
    assert len(found) == 800 and "supersedes: [[2024-01-01-fact-3-3]]" in found["5"] and "superseded_by: [[2024-01-01-fact-5-5]]" in found["3"] and "[[" not in found["7"]
