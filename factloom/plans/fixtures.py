"""Stand-ins for the store's tables over the supplied ones, in Spark and, with
the same rows, as common table expressions for another engine."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import scratch
from ..operators import postings

NOW = datetime(2025, 6, 1)
NOW_SQL = "TIMESTAMP '2025-06-01 00:00:00'"
OWNER = [("*", "sealed")]
NARROW = [("project:*", "open"), ("user:me", "private")]
NAMESPACES = ["global", "user:me", "project:alpha", "project:beta", "personal:finance", "personal:health", "project:rare"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hours(after: Column) -> Column:
    return F.timestamp_seconds(F.lit(1704067200) + after * 3600)


def _days(start: Column, n: Column | int) -> Column:
    return start + F.make_dt_interval(days=n if isinstance(n, Column) else F.lit(n))


def _pick(k: Column, names: list[str]) -> Column:
    out = F.lit(names[0])
    for n, name in enumerate(names[1:], 1):
        out = F.when(k == n, name).otherwise(out)
    return out


def fx_memory(spark: SparkSession, sf_dir: str, embedding: bool = True) -> DataFrame:
    """Facts. Each has one of the vectors, in turns; without them the join is left out."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang", "source")
    ids = docs.select((F.col("id") - 70).alias("id"), F.lit(True).alias("has_next"))
    k = (F.col("id") % 500) % 7
    replaced = (F.col("id") % 10 == 3) & (F.col("id") % 700 < 630) & F.col("has_next")
    created = _hours(F.col("id"))
    names = _pick(k, NAMESPACES)
    rows = docs.join(ids, "id", "left").select(
        "id",
        "content",
        names.alias("namespace"),
        F.when(k.isin(4, 5) | (F.col("id") % 29 == 0), "private").otherwise("open").alias("sensitivity"),
        F.when(F.col("id") % 11 == 0, F.array("lang", "source", F.lit("preference"))).otherwise(F.array("lang", "source")).alias("tags"),
        F.concat(F.lit("client-"), F.col("id") % 5).alias("source_client"),
        F.when(replaced, F.col("id") + 70).alias("superseded_by"),
        F.when((F.col("id") % 10 == 3) & (F.col("id") % 700 >= 70), F.col("id") - 70).alias("supersedes"),
        created.alias("created_at"),
        F.when(replaced, _hours(F.col("id") + 70)).alias("superseded_at"),
        F.when(F.col("id") % 3 == 0, _days(created, -(F.col("id") % 90).cast("int"))).alias("occurred_at"),
        F.when((F.col("id") % 10 != 3) & (F.col("id") % 17 == 0), _days(created, 400)).alias("occurred_until"),
        (F.col("id") % 13).alias("access_count"),
        F.when(F.col("id") % 13 > 0, _days(created, 1)).alias("last_accessed_at"),
        F.when(F.col("id") % 19 == 0, _days(created, 30)).alias("last_confirmed_at"),
    )
    if not embedding:
        return rows
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    # The count is in a column: within the join's key it fails where this side is broadcast, which waits for no subquery.
    return rows.withColumn("vec_id", F.col("id") % vectors.agg(F.count("*")).scalar()).join(vectors, "vec_id").drop("vec_id")


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts whose vectors lie around 50 of the given ones."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    n, i = vectors.agg(F.count("*")).scalar(), F.col("id")
    centres = vectors.filter("vec_id < 50").select(F.col("vec_id").alias("centre"), F.col("v").alias("c"))
    rows = fx_memory(spark, sf_dir, embedding=False).select("id", "namespace").join(F.broadcast(centres), i % 50 == F.col("centre"))
    return rows.withColumn("vec_id", (i + F.floor(i / n)) % n).join(vectors, "vec_id").select("id", "namespace", F.zip_with("c", "v", lambda c, v: (c + v / 2).cast("float")).alias("embedding"))


_INDEXES: dict[tuple[str, str], postings.Index] = {}


def lexical_index(spark: SparkSession, sf_dir: str) -> postings.Index:
    """The inverted index of the open facts: made once a session and store."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _INDEXES:
        open_facts = fx_memory(spark, sf_dir, embedding=False).filter("sensitivity = 'open' and content is not null").select("id", "content")
        _INDEXES[key] = postings.create(open_facts, scratch(spark, "postings"))
    return _INDEXES[key]


def fx_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls_of(table(spark, sf_dir, "events"))


def tool_calls_of(events: DataFrame) -> DataFrame:
    tools = F.create_map(*[F.lit(x) for pair in {"view": "memory_search", "click": "context_bootstrap", "purchase": "memory_write", "signup": "registry_get", "error": "memory_forget"}.items() for x in pair])
    return events.select(
        F.concat(F.lit("client-"), F.col("user_id") % 8).alias("client"),
        F.element_at(tools, F.col("event_type")).alias("tool"),
        (F.col("value") >= 5).alias("succeeded"),
        F.when(F.col("event_id") % 10 != 0, F.col("event_id") % 3 != 0).alias("unprompted"),
        F.floor(F.col("value") * 10).cast("int").alias("latency_ms"),
        F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("s"), F.col("user_id"), F.lit("-"), F.floor(F.col("event_id") / 50))).alias("session_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def fx_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    speaker = F.when(F.col("role") == "user", "owner_typed").when(F.col("role") == "assistant", "main_model").otherwise("system")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", speaker.alias("speaker"), "text")


def fx_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = nation.filter("n_nationkey % 2 = 0").join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    return joined.select(F.concat(F.lit("project:"), F.lower("r_name")).alias("namespace"), F.lower("n_name").alias("alias"), F.lower("r_name").alias("canonical"), F.lit(None).cast("timestamp").alias("until"))


def fx_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("registry_id"),
        _pick(k % 3, NAMESPACES[:3]).alias("namespace"),
        F.lit("host").alias("kind"),
        F.concat(F.lit("machines.s"), k, F.lit(".os")).alias("key"),
        F.col("s_name").alias("value"),
        F.when(k % 7 == 0, "private").otherwise("open").alias("sensitivity"),
        (1 + k % 4).alias("version"),
        F.when(k % 5 == 0, _hours(k * 24)).alias("review_after"),
    )


def fx_registry_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third key can also be asked for as box<number>."""
    k = F.col("registry_id")
    return fx_registry(spark, sf_dir).filter(k % 3 == 1).select("namespace", "kind", F.concat(F.lit("box"), k).alias("alias_key"), F.col("key").alias("canonical"), F.lit("manual").alias("origin"))


def fx_registry_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    orders, registry = table(spark, sf_dir, "orders"), fx_registry(spark, sf_dir)
    n = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey").alias("n"), F.min("s_suppkey").alias("low"))
    keyed = orders.crossJoin(F.broadcast(n)).withColumn("registry_id", F.col("o_custkey") % (F.col("n") - F.col("low") + 1) + F.col("low"))
    order = W.partitionBy("registry_id").orderBy("o_orderdate", "o_orderkey")
    rows = keyed.select("registry_id", F.col("o_orderpriority").alias("value"), F.col("o_orderdate").cast("timestamp").alias("replaced_at"), F.row_number().over(order).cast("long").alias("version"))
    return rows.join(registry.select("registry_id", "namespace", "kind", "key", "sensitivity"), "registry_id")


def fx_emission(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import content_digest

    return fx_memory(spark, sf_dir, embedding=False).filter("sensitivity = 'open'").select(content_digest("content").alias("content_sha256"), F.col("id").alias("memory_id"), F.lit("memory_search").alias("tool"), _days(F.col("created_at"), 2).alias("first_emitted_at"))


SQL: dict[str, str] = {
    "fx_clustered": """
fx_clustered AS (
  SELECT m.id, m.namespace, list_transform(list_zip(c.embedding, v.embedding), lambda z: CAST(CAST(z[1] AS DOUBLE) + CAST(z[2] AS DOUBLE) / 2 AS FLOAT)) AS embedding
  FROM fx_memory m JOIN embeddings c ON c.vec_id = m.id % 50 JOIN embeddings v ON v.vec_id = (m.id + m.id // (SELECT count(*) FROM embeddings)) % (SELECT count(*) FROM embeddings)
)""",
    "fx_memory": """
fx_memory AS (
  SELECT d.doc_id AS id, d.text AS content, CAST(e.embedding AS DOUBLE[]) AS embedding,
         ['global', 'user:me', 'project:alpha', 'project:beta', 'personal:finance', 'personal:health', 'project:rare'][CAST((d.doc_id % 500) % 7 + 1 AS BIGINT)] AS namespace,
         CASE WHEN (d.doc_id % 500) % 7 IN (4, 5) OR d.doc_id % 29 = 0 THEN 'private' ELSE 'open' END AS sensitivity,
         CASE WHEN d.doc_id % 11 = 0 THEN [d.lang, d.source, 'preference'] ELSE [d.lang, d.source] END AS tags,
         'client-' || (d.doc_id % 5) AS source_client,
         CASE WHEN d.doc_id % 10 = 3 AND d.doc_id % 700 < 630 AND n.doc_id IS NOT NULL THEN d.doc_id + 70 END AS superseded_by,
         CASE WHEN d.doc_id % 10 = 3 AND d.doc_id % 700 >= 70 THEN d.doc_id - 70 END AS supersedes,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(d.doc_id) AS created_at,
         CASE WHEN d.doc_id % 10 = 3 AND d.doc_id % 700 < 630 AND n.doc_id IS NOT NULL THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(d.doc_id + 70) END AS superseded_at,
         CASE WHEN d.doc_id % 3 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(d.doc_id) - to_days(CAST(d.doc_id % 90 AS INTEGER)) END AS occurred_at,
         CASE WHEN d.doc_id % 10 <> 3 AND d.doc_id % 17 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(d.doc_id) + INTERVAL 400 DAY END AS occurred_until,
         d.doc_id % 13 AS access_count,
         CASE WHEN d.doc_id % 13 > 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(d.doc_id) + INTERVAL 1 DAY END AS last_accessed_at,
         CASE WHEN d.doc_id % 19 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(d.doc_id) + INTERVAL 30 DAY END AS last_confirmed_at
  FROM documents d CROSS JOIN (SELECT count(*) AS n FROM embeddings) z JOIN embeddings e ON e.vec_id = d.doc_id % z.n LEFT JOIN documents n ON n.doc_id = d.doc_id + 70
)""",
    "fx_tool_calls": """
fx_tool_calls AS (
  SELECT 'client-' || (user_id % 8) AS client,
         CASE event_type WHEN 'view' THEN 'memory_search' WHEN 'click' THEN 'context_bootstrap' WHEN 'purchase' THEN 'memory_write' WHEN 'signup' THEN 'registry_get' WHEN 'error' THEN 'memory_forget' END AS tool,
         value >= 5 AS succeeded,
         CASE WHEN event_id % 10 <> 0 THEN event_id % 3 <> 0 END AS unprompted,
         CAST(floor(value * 10) AS INTEGER) AS latency_ms,
         CASE WHEN event_id % 4 <> 0 THEN 's' || user_id || '-' || (event_id // 50) END AS session_id,
         ts AS created_at
  FROM events
)""",
    "fx_entries": """
fx_entries AS (
  SELECT conv_id AS session_id, turn, CASE role WHEN 'user' THEN 'owner_typed' WHEN 'assistant' THEN 'main_model' ELSE 'system' END AS speaker, text FROM conversations
)""",
    "fx_alias": """
fx_alias AS (
  SELECT 'project:' || lower(r_name) AS namespace, lower(n_name) AS alias, lower(r_name) AS canonical FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0
)""",
    "fx_registry": """
fx_registry AS (
  SELECT s_suppkey AS registry_id, ['global', 'user:me', 'project:alpha'][CAST(s_suppkey % 3 + 1 AS BIGINT)] AS namespace, 'host' AS kind, 'machines.s' || s_suppkey || '.os' AS key, s_name AS value,
         CASE WHEN s_suppkey % 7 = 0 THEN 'private' ELSE 'open' END AS sensitivity, 1 + s_suppkey % 4 AS version,
         CASE WHEN s_suppkey % 5 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(s_suppkey * 24) END AS review_after
  FROM supplier
)""",
    "fx_registry_alias": """
fx_registry_alias AS (
  SELECT namespace, kind, 'box' || registry_id AS alias_key, key AS canonical, 'manual' AS origin FROM fx_registry WHERE registry_id % 3 = 1
)""",
    "fx_registry_history": """
fx_registry_history AS (
  SELECT h.*, r.namespace, r.kind, r.key, r.sensitivity FROM (
    SELECT o_custkey % (SELECT max(s_suppkey) - min(s_suppkey) + 1 FROM supplier) + (SELECT min(s_suppkey) FROM supplier) AS registry_id,
           o_orderpriority AS value, CAST(o_orderdate AS TIMESTAMP) AS replaced_at,
           row_number() OVER (PARTITION BY o_custkey % (SELECT max(s_suppkey) - min(s_suppkey) + 1 FROM supplier) ORDER BY o_orderdate, o_orderkey) AS version
    FROM orders) h JOIN fx_registry r USING (registry_id)
)""",
    "fx_emission": """
fx_emission AS (
  SELECT sha256(regexp_replace(lower(trim(regexp_replace(content, '\\s+', ' ', 'g'))), '[.!?,;:]+$', '')) AS content_sha256, id AS memory_id, 'memory_search' AS tool, created_at + INTERVAL 2 DAY AS first_emitted_at
  FROM fx_memory WHERE sensitivity = 'open'
)""",
}


def with_fixtures(body: str) -> str:
    """A query over the stand-ins as one statement with their definitions."""
    names: list[str] = []

    def need(text: str) -> None:
        for name, definition in SQL.items():
            if re.search(rf"\b{name}\b", text) and name not in names:
                need(definition.split("AS (", 1)[1])
                if name not in names:
                    names.append(name)

    need(body)
    body = body.strip()
    own = ""
    if match := re.match(r"WITH\s+(?:RECURSIVE\s+)?", body):
        depth, at = 0, match.end()
        for at in range(match.end(), len(body)):  # the main SELECT is the first outside parentheses
            depth += {"(": 1, ")": -1}.get(body[at], 0)
            if depth == 0 and re.match(r"\)\s*SELECT\b", body[at:]):
                break
        own, body = body[match.end() : at + 1], body[at + 1 :].strip()
    parts = [SQL[n].strip() for n in names] + ([own.strip()] if own else [])
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body
