"""Queries over the write paths, decisions and joins of the ingest path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import alias, decisions, duplicates, ingest, mutations, registry
from . import fixtures as fx
from .catalog import QUERIES, dismissed, live, mem, narrow, query, ts
from .changes import RULES, VISIBLE
from .fixtures import NARROW, NOW, NOW_SQL

__all__ = ["QUERIES"]


def texts(memory: DataFrame) -> DataFrame:
    """Facts with ids as texts, as a store that makes ids has them."""
    return memory.withColumns({c: F.col(c).cast("string") for c in ("id", "superseded_by", "supersedes")})


# ---- Writing ----

FACTS = f"""f AS (SELECT id, namespace, content, CASE id % 4 WHEN 0 THEN 'fresh' WHEN 1 THEN 'known' WHEN 2 THEN 'bad' ELSE 'leaky' END AS case_ FROM fx_memory m WHERE id % 4 <> 1 OR {live()})"""


def facts(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.predicates import live as is_live

    n = F.col("id") % 4
    rows = mem(spark, sf).filter((n != 1) | is_live(NOW))
    content = F.when(n == 1, F.col("content")).when(n == 3, F.concat(F.lit("use postgres://u:pw"), "id", F.lit("@h/db"))).otherwise(F.concat(F.lit("fresh fact "), "id"))
    name = F.when(n == 2, F.concat(F.lit("Bad Name "), "id")).when(n == 1, F.col("namespace")).otherwise("user:me")
    return rows.select(content.alias("content"), name.alias("namespace"), F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("sensitivity"), F.lit(None).cast("timestamp").alias("occurred_at"), "source_client")


@query(f"WITH {FACTS} SELECT CASE case_ WHEN 'fresh' THEN 'written' WHEN 'known' THEN 'confirmed' WHEN 'bad' THEN 'refused_namespace' ELSE 'refused_credential' END AS outcome, count(*) AS n FROM f GROUP BY 1")
def m01_write_outcomes(spark, sf):
    _, outcomes = mutations.write(texts(mem(spark, sf)), facts(spark, sf), NOW)
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT namespace, count(*) AS n FROM (SELECT namespace FROM fx_memory UNION ALL SELECT 'user:me' FROM fx_memory WHERE id % 4 = 0) GROUP BY namespace")
def m02_state_after_write(spark, sf):
    after, _ = mutations.write(texts(mem(spark, sf)), facts(spark, sf), NOW)
    return after.groupBy("namespace").agg(F.count("*").alias("n"))


@query(
    """SELECT namespace, key, value, version FROM (SELECT namespace, key, CASE WHEN registry_id % 4 = 0 AND sensitivity = 'open' THEN 'set ' || registry_id ELSE value END AS value, CASE WHEN registry_id % 4 = 0 AND sensitivity = 'open' THEN version + 1 ELSE version END AS version FROM fx_registry)
UNION ALL SELECT namespace, 'machines.n' || registry_id || '.os', 'set ' || registry_id, 1 FROM fx_registry WHERE registry_id % 4 = 1"""
)
def m10_registry_set(spark, sf):
    after, _, _ = _registry_set(spark, sf)
    return after.select("namespace", "key", "value", "version")


@query("SELECT reason, count(*) AS n FROM (SELECT CASE registry_id % 4 WHEN 0 THEN 'above_ceiling' WHEN 2 THEN 'key' ELSE 'credential' END AS reason FROM fx_registry WHERE registry_id % 4 IN (2, 3) OR registry_id % 4 = 0 AND sensitivity <> 'open') GROUP BY reason")
def m10_registry_refused(spark, sf):
    return _registry_set(spark, sf)[2].groupBy("reason").agg(F.count("*").alias("n"))


def _registry_set(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    r = fx.fx_registry(spark, sf)
    k = F.col("registry_id")
    key = F.when(k % 4 == 1, F.concat(F.lit("Machines.N"), k, F.lit(".OS"))).when(k % 4 == 2, F.concat(F.lit("nowhere"), k)).otherwise(F.col("key"))
    value = F.when(k % 4 == 3, F.concat(F.lit("postgres://u:pw"), k, F.lit("@h/db"))).otherwise(F.concat(F.lit("set "), k))
    entries = r.select("namespace", F.lit("Hosts").alias("kind"), key.alias("key"), value.alias("value"), F.lit("open").alias("sensitivity"))
    past = fx.fx_registry_history(spark, sf).select("namespace", "kind", "key", "value", "sensitivity", "version", "replaced_at")
    return registry.set_entries(r, past, entries, NOW, "open")


@query("SELECT namespace, alias_key, canonical, origin FROM fx_registry_alias UNION ALL SELECT namespace, 'box' || registry_id, 'elsewhere', 'rejected-write' FROM fx_registry WHERE registry_id % 2 = 0 AND registry_id % 3 <> 1")
def m11_registry_alias_add(spark, sf):
    new = fx.fx_registry(spark, sf).filter("registry_id % 2 = 0").select("namespace", "kind", F.concat(F.lit("box"), "registry_id").alias("alias_key"), F.lit("elsewhere").alias("canonical"), F.lit("rejected-write").alias("origin"))
    return registry.add_alias(fx.fx_registry_alias(spark, sf), new).select("namespace", "alias_key", "canonical", "origin")


@query(
    """SELECT namespace, alias, canonical FROM fx_alias
UNION ALL SELECT 'project:' || lower(r_name), lower(n_name), lower(r_name) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 1
UNION ALL SELECT namespace, 'old ' || alias, canonical FROM fx_alias"""
)
def m12_alias_put(spark, sf):
    known = fx.fx_alias(spark, sf).withColumn("origin", F.lit("manual"))
    nation, region = fx.table(spark, sf, "nation"), fx.table(spark, sf, "region")
    named = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.concat(F.lit("project:"), F.lower("r_name")).alias("namespace"), F.concat(F.lit(" "), "n_name").alias("alias"), F.col("r_name").alias("canonical"))
    even = named.filter("n_nationkey % 2 = 0")
    new = (
        named.filter("n_nationkey % 2 = 1").select("namespace", "alias", "canonical", F.lit("manual").alias("origin"))
        .unionAll(even.select("namespace", "alias", F.lit("guess"), F.lit("derived")))  # never replaces one made by hand
        .unionAll(even.select("namespace", F.concat(F.lit("old"), "alias"), "alias", F.lit("manual")))  # followed one hop
        .unionAll(even.select("namespace", "canonical", "alias", F.lit("manual")).dropDuplicates(["namespace"]))  # would point at itself
    )
    after, _ = alias.put(known, new)
    return after.select("namespace", "alias", "canonical")


POSTS = f"""p AS (SELECT id AS fact_id, namespace, created_at + INTERVAL 2 DAY + INTERVAL 60 SECOND AS observed_at, id % 3 AS k,
  CASE WHEN id % 3 = 0 THEN sha256(regexp_replace(lower(trim(regexp_replace(content, '\\s+', ' ', 'g'))), '[.!?,;:]+$', '')) ELSE 'posted ' || id END AS digest FROM fx_memory),
n AS (SELECT *, row_number() OVER (PARTITION BY digest, namespace ORDER BY observed_at, fact_id) AS nth,
  EXISTS (SELECT 1 FROM fx_emission e JOIN fx_memory m ON m.id = e.memory_id WHERE e.content_sha256 = p.digest AND e.first_emitted_at BETWEEN p.observed_at - INTERVAL 90 DAY AND p.observed_at + INTERVAL 300 SECOND AND {narrow()}) AS echo FROM p)"""


@query(f"WITH {POSTS} SELECT fact_id, CASE WHEN NOT {VISIBLE} THEN 'refused_grant' WHEN echo THEN 'echo' WHEN k = 1 THEN 'reinforced' WHEN nth > 1 THEN 'duplicate' ELSE 'proposed' END AS outcome FROM n")
def m13_ingest_post(spark, sf):
    k = F.col("id") % 3
    said = F.when(k == 0, F.col("content")).otherwise(F.concat(F.lit("posted "), "id"))
    at = F.col("created_at") + F.make_dt_interval(days=F.lit(2), secs=F.lit(60))
    rows = mem(spark, sf).select(F.col("id").alias("fact_id"), said.alias("content"), "namespace", F.lit("owner_typed").alias("speaker"), said.alias("span_text"), at.alias("observed_at"))
    before = rows.filter("fact_id % 3 = 1").select(text.content_digest("content").alias("fingerprint"), "namespace")
    return ingest.post(rows, before, fx.fx_emission(spark, sf), mem(spark, sf), NARROW, RULES, NOW).select("fact_id", "outcome")


# ---- Deciding ----

FINDINGS = f"""q AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'contradiction' WHEN id % 11 = 0 THEN 'stale' ELSE 'merge' END AS kind, CASE id % 3 WHEN 0 THEN 'applied' WHEN 1 THEN 'rejected' ELSE 'pending' END AS state,
  CASE (id // 5) % 4 WHEN 0 THEN 'apply' WHEN 1 THEN 'reject' WHEN 2 THEN 'resolve' ELSE 'unreject' END AS verb FROM fx_memory WHERE id % 5 = 0),
s AS (SELECT q.id, min(CASE WHEN m.superseded_by IS NOT NULL THEN 'retired' WHEN m.id % 8 = 1 THEN 'changed' END) AS became,
  bool_or(m.id <> q.id AND m.superseded_at IS NULL AND m.occurred_until IS NOT NULL AND m.occurred_until <= {NOW_SQL}) AS ended, bool_or(m.id <> q.id AND coalesce(k.occurred_at < m.occurred_at, false)) AS inverted
  FROM q JOIN fx_memory m ON m.id BETWEEN q.id AND q.id + 2 JOIN fx_memory k ON k.id = q.id GROUP BY q.id),
o AS (SELECT q.*, CASE WHEN verb = 'unreject' AND state <> 'rejected' THEN 'not_rejected' WHEN verb <> 'unreject' AND state <> 'pending' THEN 'decided' WHEN verb = 'apply' AND kind = 'contradiction' THEN 'nothing_to_apply'
  WHEN verb = 'resolve' AND kind NOT IN ('contradiction', 'stale') THEN 'names_survivor' WHEN verb IN ('apply', 'resolve') AND became IS NOT NULL THEN 'member_' || became
  WHEN (verb = 'apply' AND kind = 'merge' OR verb = 'resolve') AND ended THEN 'expired' WHEN (verb = 'apply' AND kind = 'merge' OR verb = 'resolve') AND inverted THEN 'inversion' END AS reason FROM q LEFT JOIN s USING (id))"""


def _findings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = mem(spark, sf)
    i = F.col("id")
    kind = F.when(i % 7 == 0, "contradiction").when(i % 11 == 0, "stale").otherwise("merge")
    state = F.when(i % 3 == 0, "applied").when(i % 3 == 1, "rejected").otherwise("pending")
    p = m.filter("id % 5 = 0").select("id", kind.alias("kind"), state.alias("state"), F.when(kind == "merge", i).alias("keep_id"), F.lit(None).cast("timestamp").alias("decided_at"))
    own = (F.floor(i / 5) * 5).cast("long")
    members = m.filter("id % 5 < 3").select(own.alias("proposal_id"), i.alias("memory_id"), F.when(i % 8 == 1, F.lit("other")).otherwise(F.col("content")).alias("content"), F.when((i == own) & (own % 11 != 0), "keep").otherwise("retire").alias("disposition"))
    turn = F.floor(i / 5) % 4
    verb = F.when(turn == 0, "apply").when(turn == 1, "reject").when(turn == 2, "resolve").otherwise("unreject")
    return decisions.decide_findings(p, members, m, p.select(i.alias("proposal_id"), verb.alias("verb"), i.alias("keep_id")), NOW)


@query(f"WITH {FINDINGS} SELECT id AS proposal_id, verb, reason FROM o")
def m19_finding_outcomes(spark, sf):
    return _findings(spark, sf)[2]


@query(f"WITH {FINDINGS} SELECT id, CASE WHEN reason IS NOT NULL THEN state WHEN verb IN ('apply', 'resolve') THEN 'applied' WHEN verb = 'reject' THEN 'rejected' ELSE 'pending' END AS state FROM o")
def m19_findings_after(spark, sf):
    return _findings(spark, sf)[0].select("id", "state")


@query(
    f"""WITH {FINDINGS} SELECT m.id, coalesce(m.superseded_by, CASE WHEN o.id IS NOT NULL AND m.id <> o.id AND (o.kind <> 'stale' OR o.verb = 'resolve') THEN o.id END) AS superseded_by
FROM fx_memory m LEFT JOIN o ON o.id = m.id // 5 * 5 AND m.id % 5 < 3 AND o.reason IS NULL AND o.verb IN ('apply', 'resolve') WHERE NOT coalesce(o.kind = 'stale' AND o.verb = 'apply', false)"""
)
def m19_facts_after(spark, sf):
    return _findings(spark, sf)[1].select("id", "superseded_by")


ITEMS = f"""i AS (SELECT id AS a, CASE WHEN (id // 20) % 5 <> 2 THEN id + 7 END AS b, ['supersede', 'keep_both', 'confirm', 'delete', 'apply'][CAST((id // 20) % 5 + 1 AS BIGINT)] AS verdict FROM fx_memory WHERE id % 20 = 1),
r AS (SELECT i.*, CASE WHEN verdict = 'apply' THEN 'verdict' WHEN verdict <> 'confirm' AND y.id IS NULL THEN 'missing'
  WHEN verdict = 'supersede' AND (x.superseded_by IS NOT NULL OR y.superseded_by IS NOT NULL) THEN 'already_superseded' WHEN verdict = 'supersede' AND (coalesce(x.occurred_until <= {NOW_SQL}, false) OR coalesce(y.occurred_until <= {NOW_SQL}, false)) THEN 'expired'
  WHEN verdict = 'supersede' AND coalesce(y.occurred_at < x.occurred_at, false) THEN 'inversion' END AS reason FROM i JOIN fx_memory x ON x.id = i.a LEFT JOIN fx_memory y ON y.id = i.b)"""


def _items(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = texts(mem(spark, sf))
    n = F.col("id").cast("long")
    turn = (F.floor(n / 20) % 5).cast("int")
    verdict = F.element_at(F.array(*map(F.lit, ["supersede", "keep_both", "confirm", "delete", "apply"])), turn + 1)
    asked = m.filter(n % 20 == 1).select(F.col("id").alias("key"), F.when(turn == 2, "stale").otherwise("conflict").alias("source"), verdict.alias("verdict"), F.col("id").alias("a"), F.when(turn != 2, (n + 7).cast("string")).alias("b"), F.when(turn == 3, F.col("id")).alias("keep"), F.lit(None).cast("string").alias("content"))
    ledger = dismissed(spark, sf).withColumns({c: F.col(c).cast("string") for c in ("lo_id", "hi_id")})
    return decisions.decide_items(m, ledger, asked, NOW, may_delete=True)


@query(f"WITH {ITEMS} SELECT CAST(a AS VARCHAR) AS key, verdict, reason FROM r")
def m21_review_outcomes(spark, sf):
    return _items(spark, sf)[2].select("key", "verdict", "reason")


@query(
    f"""WITH {ITEMS} SELECT CAST(m.id AS VARCHAR) AS id, CAST(CASE WHEN r.verdict = 'supersede' THEN r.b ELSE m.superseded_by END AS VARCHAR) AS superseded_by,
strftime(CASE WHEN r.verdict = 'confirm' THEN {NOW_SQL} ELSE m.last_confirmed_at END, '%Y-%m-%d %H:%M:%S') AS last_confirmed_at
FROM fx_memory m LEFT JOIN r ON r.a = m.id AND r.reason IS NULL WHERE NOT coalesce(r.verdict = 'delete', false)"""
)
def m21_review_state_after(spark, sf):
    return _items(spark, sf)[0].select("id", "superseded_by", ts("last_confirmed_at"))


@query(
    f"""WITH d AS (SELECT t.tag, namespace, occurred_at, max(id) AS older_id, min(id) AS first_id FROM fx_memory m, (VALUES ('preference'), ('en')) t(tag) WHERE {live()} AND occurred_at IS NOT NULL AND list_contains(tags, t.tag) AND {narrow()} GROUP BY ALL)
SELECT tag, namespace, older_id, newer_id FROM (SELECT *, lead(first_id) OVER (PARTITION BY tag, namespace ORDER BY occurred_at) AS newer_id FROM d) WHERE newer_id IS NOT NULL"""
)
def m20_supersession_proposals(spark, sf):
    arities = spark.createDataFrame([("preference", "single"), ("en", "single"), ("web", "many")], "tag string, arity string")
    return duplicates.supersession_proposals(mem(spark, sf), arities, NARROW, NOW)


@query("SELECT CAST(CASE WHEN id % 3 = 2 THEN id + 1000000 ELSE id END AS VARCHAR) AS old_id, id % 3 = 0 AS present, id % 3 = 1 AS renamed FROM fx_memory")
def m22_archive_merge(spark, sf):
    m = texts(mem(spark, sf))
    n = F.col("id").cast("long")
    archive = m.withColumn("content", F.when(n % 3 == 1, F.concat(F.lit("changed "), "id")).otherwise(F.col("content"))).withColumn("id", F.when(n % 3 == 2, (n + 1_000_000).cast("string")).otherwise(F.col("id")))
    _, ids = mutations.merge_archive(m, archive)
    return ids.select("old_id", "present", (F.col("old_id") != F.col("new_id")).alias("renamed"))


@query("SELECT id, id % 2 = 0 OR (id % 3 <> 0) AS readable FROM fx_memory")
def m23_plaintext_cleared(spark, sf):
    m = mem(spark, sf)
    p = m.select("id", F.col("id").alias("memory_id"), F.when(F.col("id") % 2 == 0, "pending").otherwise("written").alias("state"), "content", F.lit("quote").alias("quote"))
    return ingest.clear_plaintext(p, m.filter("id % 3 <> 0")).select("id", F.col("quote").isNotNull().alias("readable"))


def _linked(spark, sf):
    return mem(spark, sf).select("id", F.when(F.col("id") % 4 != 3, F.col("id")).alias("memory_id"), F.coalesce("content", F.lit("words")).alias("content"), F.lit("quote").alias("quote"))


def _sealed_facts(spark, sf):
    return mem(spark, sf).select("id", F.when(F.col("id") % 3 != 0, F.coalesce("content", F.lit("words"))).alias("content"))


@query("SELECT id, quote, content = '' AS empty FROM (SELECT doc_id AS id, CASE WHEN (doc_id % 4 = 3 AND doc_id % 3 = 0) OR (doc_id % 4 <> 3 AND doc_id % 5 = 0) THEN '' ELSE coalesce(text, 'words') END AS content, CASE WHEN (doc_id % 4 = 3 AND doc_id % 3 = 0) OR (doc_id % 4 <> 3 AND doc_id % 5 = 0) THEN NULL ELSE 'quote' END AS quote FROM documents)")
def m23_links_that_change(spark, sf):
    """What had no link gets one, and of the others each fifth loses it."""
    before = _linked(spark, sf)
    after = before.withColumn("memory_id", F.when(F.col("memory_id").isNull(), F.col("id")).when(F.col("id") % 5 != 0, F.col("memory_id")))
    return ingest.relinked(before, after, _sealed_facts(spark, sf)).select("id", "quote", (F.col("content") == "").alias("empty"))


@query("SELECT doc_id AS id, CASE WHEN NOT (doc_id % 4 <> 3 AND doc_id % 3 = 0) THEN 'quote' END AS quote, (doc_id % 4 <> 3 AND doc_id % 3 = 0) OR coalesce(text, 'words') = '' AS empty FROM documents")
def m23_facts_sealed_later(spark, sf):
    before = mem(spark, sf).select("id", F.coalesce("content", F.lit("words")).alias("content"))
    return ingest.sealed_later(_linked(spark, sf), before, _sealed_facts(spark, sf)).select("id", "quote", (F.col("content") == "").alias("empty"))


# ---- Joins of the ingest path ----


@query("SELECT u.conv_id AS file_path, u.turn, CASE WHEN u.turn % 3 = 1 THEN 'use' END AS tool_name FROM conversations u WHERE u.turn % 3 = 1")
def j21_tool_results(spark, sf):
    c = fx.table(spark, sf, "conversations").select(F.col("conv_id").alias("file_path"), "turn", F.concat(F.lit("t"), "turn").alias("tool_use_id"))
    uses = c.filter("turn % 3 <> 0").select("file_path", "tool_use_id", F.when(F.col("turn") % 3 == 1, F.col("turn") * 100).otherwise(F.col("turn") * 100 + 60).alias("byte_start"), F.lit("use").alias("name"))
    found, _ = ingest.join_tool_results(uses, c.withColumn("byte_start", F.col("turn") * 100 + 50))
    return found.select("file_path", "turn", "tool_name")


@query("SELECT doc_id AS fact, doc_id % 4 <> 0 AS known FROM documents")
def j22_span_resolve(spark, sf):
    d = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("fact"), F.col("doc_id").alias("source_span_id"))
    known, unknown = ingest.resolve_spans(d, d.filter("fact % 4 <> 0").select(F.col("fact").alias("id"), F.lit("owner_typed").alias("speaker")))
    return known.select("fact", F.lit(True).alias("known")).unionAll(unknown.select("fact", F.lit(False)))


@query("SELECT conv_id AS file_path, min(turn * 1000) AS hold_at FROM conversations WHERE (turn // 2) % 2 = 1 GROUP BY conv_id")
def j23_hold_back(spark, sf):
    s = fx.table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").alias("file_path"), (F.col("turn") * 1000).alias("byte_start"), F.concat_ws("-", "conv_id", F.floor(F.col("turn") / 2)).alias("chunk_id"), "turn")
    chunks = s.groupBy("chunk_id").agg(F.collect_list("id").alias("span_ids"))
    taken = s.filter(F.floor(F.col("turn") / 2) % 2 == 0).select("chunk_id").distinct()
    return ingest.hold_back(chunks, s.select("id", "file_path", "byte_start"), taken)
