"""Measures of retrieval quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _dcg(hits: Column, k: int) -> Column:
    gains = F.transform(F.slice(hits, 1, k), lambda h, i: F.when(h, 1 / F.log2(i + 2.0)).otherwise(0.0))
    return F.aggregate(gains, F.lit(0.0), lambda s, x: s + x)


def measures(results: DataFrame) -> DataFrame:
    """(…, hits, relevant) with the five measures of each question: whether each
    place holds what is relevant, and how many are relevant in all."""
    hits, n = F.col("hits"), F.col("relevant")
    ideal = lambda k: _dcg(F.array_repeat(F.lit(True), F.least(n, F.lit(k)).cast("int")), k)
    first = F.array_position(hits, True)
    any_of = {f"recall_any_at_{k}": F.when(F.array_contains(F.slice(hits, 1, k), True), 1.0).otherwise(0.0) for k in (5, 10, 20)}
    ndcg = F.when(n > 0, _dcg(hits, 10) / ideal(10)).otherwise(0.0)
    return results.withColumns({**any_of, "ndcg_at_10": ndcg, "mrr": F.when(first > 0, 1.0 / first).otherwise(0.0)})


def metrics(results: DataFrame) -> DataFrame:
    """(…, ids, gold) with the five measures of each question."""
    hits = F.transform("ids", lambda i: F.array_contains("gold", i))
    return measures(results.withColumns({"hits": hits, "relevant": F.size("gold")})).drop("hits", "relevant")


def aggregate(measured: DataFrame, kind: str) -> DataFrame:
    """Means by kind of question, and over all."""
    means = [F.count("*").alias("questions"), *[F.avg(c).alias(c) for c in ("recall_any_at_5", "recall_any_at_10", "recall_any_at_20", "ndcg_at_10", "mrr")]]
    return measured.groupBy(F.col(kind).alias("kind")).agg(*means).unionByName(measured.agg(*means).withColumn("kind", F.lit("all")))


def golden(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, expect_id) against (query_id, pos from 0, id): recall at 1
    and 5, mean reciprocal rank, and hits on cases that expect none."""
    place = cases.join(hits, (cases.query_id == hits.query_id) & (cases.expect_id == hits.id), "left").groupBy(cases.query_id, cases.expect_id).agg((F.min("pos") + 1).alias("place"))
    some = hits.select("query_id").distinct().withColumn("_some", F.lit(True))
    rows = place.join(some, "query_id", "left")
    asked = F.col("expect_id").isNotNull()
    share = lambda test: F.avg(F.when(asked, F.when(test, 1.0).otherwise(0.0)))
    return rows.agg(
        F.count("*").alias("cases"), share(F.col("place") == 1).alias("recall_at_1"), share(F.col("place") <= 5).alias("recall_at_5"), F.avg(F.when(asked, F.coalesce(1.0 / F.col("place"), F.lit(0.0)))).alias("mrr"), F.count_if(~asked & F.coalesce("_some", F.lit(False))).alias("violations")
    )


def overlap(lists: DataFrame) -> DataFrame:
    """(query_id, exact, approximate) -> recall of each and whether the first is missed."""
    share = F.size(F.array_intersect("exact", "approximate")) / F.size("exact")
    return lists.select("query_id", F.when(F.size("exact") > 0, share).otherwise(1.0).alias("recall"), (~F.get("exact", F.lit(0)).eqNullSafe(F.get("approximate", F.lit(0)))).alias("top_missed"))


def currency(cases: DataFrame) -> DataFrame:
    """(current_first, both): how often the fact that holds came first."""
    return cases.agg(F.count("*").alias("cases"), F.round(F.avg(F.when(F.col("current_first"), 1.0).otherwise(0.0)), 4).alias("accuracy"), F.count_if("both").alias("returned_both"))
