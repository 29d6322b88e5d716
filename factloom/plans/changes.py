"""Queries over state changes, review pages and the ingest path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import credentials, text
from ..operators import alias, duplicates, ingest, listing, mutations, registry, search
from ..sources import clients
from . import fixtures as fx
from .catalog import DISMISSED, QUERIES, dismissed, live, mem, narrow, query, ts
from .fixtures import NARROW, NOW, NOW_SQL

__all__ = ["QUERIES"]

RULES = [("personal:*", "private"), ("project:*", "open")]
POSTED = """p AS (SELECT id, namespace, CASE WHEN id % 3 = 0 THEN 'written' ELSE 'pending' END AS state, CASE id % 2 WHEN 0 THEN 'owner_typed' ELSE 'main_model' END AS speaker, id % 4 = 0 AS auto, id % 5 AS run, created_at FROM fx_memory)"""


def posted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    m = mem(spark, sf)
    p = m.select("id", "namespace", F.when(F.col("id") % 3 == 0, "written").otherwise("pending").alias("state"), F.when(F.col("id") % 2 == 0, "owner_typed").otherwise("main_model").alias("speaker"), (F.col("id") % 4 == 0).alias("auto"), "created_at")
    s = m.select(F.col("id").alias("proposal_id"), (F.col("id") % 5).cast("string").alias("run_id"), F.when(F.col("id") % 7 > 0, F.col("created_at")).alias("observed_at"))
    return p, s


# The grant must reach the level that the namespace's rule gives; without a rule that is open.
VISIBLE = "(starts_with(namespace, 'project:') OR namespace = 'user:me')"


@query(f"WITH {POSTED} SELECT id, state FROM p WHERE {VISIBLE} AND state = 'pending' AND speaker = 'owner_typed' AND NOT auto AND run = 2 ORDER BY created_at DESC, id LIMIT 30")
def s18_proposals_filtered(spark, sf):
    p, s = posted(spark, sf)
    return ingest.visible_page(p, s, NARROW, RULES, state="pending", speaker="owner_typed", auto=False, run_id="2", limit=30).select("id", "state")


@query(f"WITH {POSTED} SELECT id FROM p WHERE {VISIBLE} ORDER BY created_at DESC, id LIMIT 50")
def l13_ingest_proposals_page(spark, sf):
    p, s = posted(spark, sf)
    return ingest.visible_page(p, s, NARROW, RULES).select("id")


def marks(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.table(spark, sf, "documents")
    return d.select(F.concat(F.lit("f"), "doc_id").alias("file_path"), (F.col("doc_id") * 10).alias("byte_offset"), F.lit("h").alias("prefix_sha256"), F.when(F.col("doc_id") % 9 == 0, "unreadable").alias("skip_reason"), F.lit(NOW).alias("updated_at"))


@query("SELECT 'f' || doc_id AS file_path, 'unreadable' AS skip_reason FROM documents WHERE doc_id % 9 = 0")
def s19_watermarks_skipped(spark, sf):
    return ingest.watermark_listing(marks(spark, sf), skipped_only=True).select("file_path", "skip_reason")


@query("SELECT 'f' || doc_id AS file_path, greatest(doc_id * 10, least(doc_id * 7 + 900, CASE WHEN doc_id % 6 = 0 THEN doc_id * 8 ELSE 1000000000 END)) AS byte_offset FROM documents")
def m15_advance_watermarks(spark, sf):
    m = marks(spark, sf)
    n = F.substring("file_path", 2, 20).cast("long")
    to = m.select("file_path", (n * 7 + 900).alias("byte_offset"), F.lit("new").alias("prefix_sha256"))
    holds = m.filter(n % 6 == 0).select("file_path", (n * 8).alias("hold_at"))
    return ingest.advance_watermarks(m, to, holds, NOW).select("file_path", "byte_offset")


@query(f"WITH {POSTED} SELECT p.id, row_number() OVER (ORDER BY CASE WHEN p.id % 7 > 0 THEN created_at END ASC NULLS LAST, p.id) AS n FROM p WHERE state = 'pending'")
def m14_approval_order(spark, sf):
    from pyspark.sql import Window as W

    p, s = posted(spark, sf)
    order = W.orderBy(F.col("observed_at").asc_nulls_last(), "id")
    return ingest.approval_order(p.filter("state = 'pending'"), s).select("id", F.row_number().over(order).cast("long").alias("n"))


@query(
    f"""SELECT a.id AS older_id, b.id AS newer_id FROM fx_memory a JOIN fx_memory b ON a.namespace = b.namespace AND (a.created_at, a.id) < (b.created_at, b.id)
WHERE {live('a')} AND {live('b')} AND list_cosine_similarity(a.embedding, b.embedding) >= 0.35 AND {narrow('a')} AND {narrow('b')} AND NOT EXISTS (SELECT 1 FROM {DISMISSED} d WHERE d.lo_id = least(a.id, b.id) AND d.hi_id = greatest(a.id, b.id))
ORDER BY round(list_cosine_similarity(a.embedding, b.embedding), 9) DESC, a.created_at, a.id, b.id LIMIT 5 OFFSET 3"""
)
def l05_conflicts_page(spark, sf):
    found = duplicates.conflicts(mem(spark, sf, True), NARROW, NOW, 0.35, dismissed(spark, sf), contents=False)
    page = found.orderBy(F.round("similarity", 9).desc(), "older_at", "older_id", "newer_id").offset(3).limit(5)
    return page.select("older_id", "newer_id")


@query("SELECT key, value, version, strftime(replaced_at, '%Y-%m-%d %H:%M:%S') AS replaced_at FROM fx_registry_history WHERE registry_id = 5 ORDER BY fx_registry_history.replaced_at DESC, version DESC LIMIT 5")
def l12_registry_history_page(spark, sf):
    ns = fx.fx_registry(spark, sf).filter("registry_id = 5").first()["namespace"]
    return registry.history(fx.fx_registry_history(spark, sf), fx.fx_registry_alias(spark, sf), ns, "host", "machines.s5.os", limit=5).select("key", "value", "version", ts("replaced_at"))


@query("SELECT namespace, alias, canonical FROM fx_alias WHERE namespace = 'project:asia'")
def g08_alias_listing(spark, sf):
    return alias.listing(fx.fx_alias(spark, sf), "project:asia").select("namespace", "alias", "canonical")


@query("WITH n AS (SELECT id, superseded_by FROM fx_memory WHERE id % 10 = 3) SELECT m.id, CASE WHEN m.superseded_by % 700 BETWEEN 140 AND 209 AND m.superseded_by % 10 = 3 THEN g.superseded_by ELSE m.superseded_by END AS superseded_by FROM fx_memory m LEFT JOIN n g ON g.id = m.superseded_by WHERE NOT (m.id % 10 = 3 AND m.id % 700 BETWEEN 140 AND 209)")
def m05_delete_and_splice(spark, sf):
    m = mem(spark, sf)
    gone = m.filter("id % 10 = 3 and id % 700 between 140 and 209").select("id")
    return mutations.delete(m, gone).select("id", "superseded_by")


@query("SELECT lo, hi FROM (SELECT DISTINCT least(id, id * 7 % 100) AS lo, greatest(id, id * 7 % 100) AS hi FROM fx_memory WHERE id <> id * 7 % 100 UNION SELECT id, id + 500 FROM fx_memory WHERE id % 4 = 0)")
def m08_dismiss_pairs(spark, sf):
    pairs = mem(spark, sf).select(F.col("id").alias("a"), (F.col("id") * 7 % 100).alias("b"))
    return mutations.dismiss(dismissed(spark, sf), pairs, "owner", NOW).select(F.col("lo_id").alias("lo"), F.col("hi_id").alias("hi"))


@query(f"SELECT id, strftime(CASE WHEN id % 19 = 0 AND id % 2 = 1 THEN last_confirmed_at WHEN id % 2 = 0 THEN {NOW_SQL} END, '%Y-%m-%d %H:%M:%S') AS last_confirmed_at FROM fx_memory")
def m06_confirm(spark, sf):
    m = mem(spark, sf)
    return mutations.confirm(m, m.filter("id % 2 = 0").select("id"), NOW).select("id", ts("last_confirmed_at"))


@query("SELECT DISTINCT norm, keep_id FROM (SELECT lower(trim(regexp_replace(content, '\\s+', ' ', 'g'))) AS t, md5(namespace || chr(31) || lower(trim(regexp_replace(content, '\\s+', ' ', 'g')))) AS norm, CASE WHEN count(occurred_at) OVER w > 0 THEN first_value(id) OVER (PARTITION BY namespace, lower(trim(regexp_replace(content, '\\s+', ' ', 'g'))) ORDER BY occurred_at DESC NULLS LAST, created_at DESC, id DESC) ELSE min(id) OVER w END AS keep_id FROM fx_memory WINDOW w AS (PARTITION BY namespace, lower(trim(regexp_replace(content, '\\s+', ' ', 'g')))))")
def m17_survivors(spark, sf):
    m = mem(spark, sf).select(F.md5(text.duplicate_key("namespace", "content")).alias("norm"), "id", "occurred_at", "created_at")
    return duplicates.survivors(m).select("norm", "keep_id")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'removed' ELSE 'kept' END AS link FROM documents")
def m24_links_released(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("memory_id"))
    alive = mem(spark, sf).filter("id % 5 <> 0")
    return mutations.release(d, "memory_id", alive).select("doc_id", F.when(F.col("memory_id").isNull(), "removed").otherwise("kept").alias("link"))


@query("SELECT client, count(*) + 1 AS calls FROM fx_tool_calls GROUP BY client")
def m25_record_calls(spark, sf):
    from ..operators.telemetry import record

    c = fx.fx_tool_calls(spark, sf)
    return record(c, c.dropDuplicates(["client"])).groupBy("client").agg(F.count("*").alias("calls"))


@query("SELECT doc_id AS n, CASE doc_id % 5 WHEN 0 THEN 'connection_string_password' WHEN 2 THEN 'high_entropy_token' WHEN 3 THEN 'hex_credential' WHEN 4 THEN 'jwt' END AS rule FROM documents")
def x15_to_x19_credential_rules(spark, sf):
    i = F.col("doc_id")
    header = F.regexp_replace(F.base64(F.encode(F.concat(F.lit('{"alg":"HS256","kid":"'), i, F.lit('"}')), "utf-8")), "=+$", "")
    token = F.concat(F.lit("jwt "), header, F.lit(".eyJzdWIiOiJ4In0."), F.lit("s" * 43))
    secret = F.when(i % 5 == 0, F.concat(F.lit("use postgres://u:pw"), i, F.lit("@h/db"))).when(i % 5 == 1, "use postgres://u:${PW}@h/db").when(i % 5 == 2, "k aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1eF3").when(i % 5 == 3, "bearer " + "0123456789abcdef" * 3).otherwise(token)
    content = F.concat_ws(" " * 60, F.regexp_replace("text", "[^a-z ]", " "), secret)  # no word stands near
    return fx.table(spark, sf, "documents").select(i.alias("n"), credentials.finding(content)["rule"].alias("rule"))


@query("SELECT doc_id AS n, CASE doc_id % 3 WHEN 0 THEN 'my-app-' || doc_id WHEN 1 THEN 'atlas-v1.' || doc_id || '_b' END AS slug FROM documents")
def x25_project_slug(spark, sf):
    n = F.col("doc_id")
    raw = F.when(n % 3 == 0, F.concat(F.lit("/home/me/My App "), n, F.lit("/"))).when(n % 3 == 1, F.concat(F.lit("Atlas v1."), n, F.lit("_b"))).otherwise("//")
    return fx.table(spark, sf, "documents").select(n.alias("n"), text.project_slug(raw).alias("slug"))


@query(
    """WITH l AS (SELECT conv_id, turn, length(concat_ws(': ', role, text)) AS chars FROM conversations),
p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) AS n, least(2000, chars - k * 2000) AS size FROM (SELECT *, unnest(range(0, (chars + 1999) // 2000)) AS k FROM l)),
c AS (SELECT conv_id, n, 0::BIGINT AS chunk, size FROM p WHERE n = 1
  UNION ALL SELECT p.conv_id, p.n, c.chunk + CASE WHEN c.size + 1 + p.size > 2000 THEN 1 ELSE 0 END, CASE WHEN c.size + 1 + p.size > 2000 THEN p.size ELSE c.size + 1 + p.size END FROM c JOIN p ON p.conv_id = c.conv_id AND p.n = c.n + 1)
SELECT conv_id, chunk, max(size) AS chars FROM c GROUP BY conv_id, chunk"""
)
def x29_chunked_sessions(spark, sf):
    lines = fx.table(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws(": ", "role", "text").alias("text"))
    return ingest.pack(lines, "conv_id", "turn", budget=2000).select("conv_id", "chunk", F.length("text").alias("chars"))


@query("SELECT doc_id AS n, CASE doc_id % 2 WHEN 0 THEN 'abc ' || doc_id ELSE 'ab c ' || lower(lang) END AS folded FROM documents WHERE lang IS NOT NULL")
def x43_folded_names(spark, sf):
    n = F.col("doc_id")
    raw = F.when(n % 2 == 0, F.concat(F.lit("Ａｂｃ  "), n)).otherwise(F.concat(F.lit("a\u200bb  C "), F.upper("lang")))
    return fx.table(spark, sf, "documents").filter("lang is not null").select(n.alias("n"), clients.folded(raw).alias("folded"))


@query("SELECT table_name AS \"table\", count(*) AS n FROM (SELECT 'memory' AS table_name FROM fx_memory WHERE namespace = 'user:me' UNION ALL SELECT 'registry' FROM fx_registry WHERE namespace = 'user:me') GROUP BY 1")
def u04_union_of_tables(spark, sf):
    counted = listing.rows_by_table({"memory": mem(spark, sf), "registry": fx.fx_registry(spark, sf)})
    return counted.filter("namespace = 'user:me'").select("table", "n")


@query("SELECT id, namespace FROM fx_memory m WHERE starts_with(namespace, 'project:') AND sensitivity = 'private'")
def f18_not_admitted(spark, sf):
    return search.admitted(mem(spark, sf).filter("namespace like 'project:%'"), [(n, "open") for n in fx.NAMESPACES if n.startswith("project:")]).select("id", "namespace")
