"""Queries over the store's own file formats and over streams. Their inputs are
made from the supplied tables and written to the shared folder first."""

from __future__ import annotations

from datetime import date
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import live
from ..functions.staging import scratch
from ..functions.text import content_digest
from ..operators import ingest
from ..sources import archive, byte_lines, clients, dump, evaluation, files, transcripts
from ..streaming import calls
from . import fixtures as fx
from .catalog import QUERIES, mem, query, ts
from .catalog import live as live_sql
from .fixtures import NOW


__all__ = ["QUERIES"]


def _texts(rows: DataFrame, name: str) -> str:
    path = scratch(rows.sparkSession, name)
    rows.write.text(path)
    return path


def _lines(rows: DataFrame, name: str) -> DataFrame:
    return files.lines(rows.sparkSession, _texts(rows, name), pattern="part-*")


LINES = """l AS (SELECT doc_id, to_json({'i': doc_id, 't': text}) AS line FROM documents),
o AS (SELECT doc_id, line, strlen(line) + 1 AS bytes, CAST(sum(strlen(line) + 1) OVER (ORDER BY doc_id) AS BIGINT) AS byte_end FROM l)"""


#: Bytes of text, about, of one segment of a log, and the document up to which one was read.
SEGMENT, READ = 64 << 20, 100


def _log(docs: DataFrame, name: str) -> str:
    """A log of a JSON line a document, by number: one file, or as many segments
    as keep each to one task's share, in the order of their names. Documents
    below ``READ`` are in the first one, as what was read is its beginning."""
    rows = docs.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("i"), F.col("text").alias("t")), {"ignoreNullFields": "false"}).alias("value"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return _texts(rows.repartitionByRange(size // SEGMENT + 1, F.greatest("doc_id", F.lit(READ - 1))).sortWithinPartitions("doc_id").select("value"), name)


def _placed(read: DataFrame, path: str) -> DataFrame:
    """Lines of segments with their places in the whole log. The driver holds a
    number for each segment."""
    segments = sorted((address, size) for address, size, _ in byte_lines.listed(path, "part-*"))
    before = list(accumulate((size for _, size in segments), initial=0))
    starts = read.sparkSession.createDataFrame([(address, at) for (address, _), at in zip(segments, before)], "file_path string, before long")
    return read.join(F.broadcast(starts), "file_path").withColumns({c: F.col(c) + F.col("before") for c in ("byte_start", "byte_end")}).drop("before")


@query(f"WITH {LINES} SELECT doc_id, byte_end - bytes AS byte_start, byte_end, md5(line) AS text FROM o")
def s07_lines_with_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """One log in ranges of 100,000 bytes: a line has its own place in it."""
    path = _log(fx.table(spark, sf, "documents"), "s07")
    read = _placed(files.lines(spark, path, pattern="part-*", range_bytes=100_000), path)
    return read.select(F.get_json_object("text", "$.i").cast("long").alias("doc_id"), "byte_start", "byte_end", F.md5("text").alias("text"))


@query(f"WITH {LINES}, h AS (SELECT max(byte_end) AS reached FROM o WHERE doc_id < 100) SELECT 'grown' AS file, doc_id, byte_end - bytes AS byte_start FROM o, h WHERE byte_end > reached UNION ALL SELECT 'changed', doc_id, byte_end - bytes - (SELECT sum(bytes) FROM o WHERE doc_id = 0) FROM o WHERE doc_id > 0")
def t05_only_new_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """What was read up to document 100 is not read again where it still begins
    a log; a log that begins otherwise is read from 0."""
    docs = fx.table(spark, sf, "documents")
    mark = files.reached(files.lines(spark, _log(docs.filter(F.col("doc_id") < READ), "t05"), pattern="part-*"))
    out = []
    for name, rows in (("grown", docs), ("changed", docs.filter("doc_id > 0"))):
        path = _log(rows, "t05")
        here = files.discover(spark, path, "part-*").agg(F.min("path").alias("file_path"))
        marks = here.join(mark.drop("file_path"))
        read = _placed(files.lines(spark, path, marks, "part-*", range_bytes=100_000), path)
        out.append(read.select(F.lit(name).alias("file"), F.get_json_object("text", "$.i").cast("long").alias("doc_id"), "byte_start"))
    return out[0].unionAll(out[1])


@query("SELECT sum(strlen(n_name) + 1)::BIGINT AS length FROM nation")
def s08_discover_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.table(spark, sf, "nation").select("n_name")
    path = _texts(rows.withColumnRenamed("n_name", "value").coalesce(1), "s08")
    return files.discover(spark, path, "part-*").select("length")


@query("SELECT rule, count(*) AS n FROM (SELECT CASE (conv_id + turn) % 6 WHEN 0 THEN 'meta_user' WHEN 1 THEN 'command_text' WHEN 2 THEN 'system' WHEN 3 THEN 'attachment' END AS rule FROM conversations) WHERE rule IS NOT NULL GROUP BY rule")
def s09_typed_transcript(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("conv_id") + F.col("turn")) % 6
    kind = F.when(k == 2, "summary").when(k == 3, "attachment").when(k == 4, "assistant").otherwise("user")
    said = F.when(k == 1, F.concat(F.lit("<command-name>"), F.col("text"))).otherwise(F.concat(F.lit("said "), F.col("text")))
    entry = F.to_json(F.struct(kind.alias("type"), F.concat_ws("-", "conv_id", "turn").alias("uuid"), F.when(k == 0, True).alias("isMeta"), F.struct(said.alias("content")).alias("message")))
    return transcripts.counters(transcripts.typed_entries(_lines(fx.table(spark, sf, "conversations").select(entry.alias("value")), "s09")))


@query("SELECT coalesce(CASE (conv_id + turn) % 5 WHEN 0 THEN 'owner_typed' WHEN 1 THEN 'main_model' END, CASE (conv_id + turn) % 5 WHEN 2 THEN 'duplicate_agent_message' WHEN 3 THEN 'developer' WHEN 4 THEN 'unknown' END) AS what, count(*) AS n FROM conversations GROUP BY 1")
def s10_event_transcript(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("conv_id") + F.col("turn")) % 5
    kind = F.when(k.isin(0, 2), "event_msg").when(k.isin(1, 3), "response_item").otherwise("novelty")
    item = F.when(k == 0, "user_message").when(k == 2, "agent_message").otherwise("message")
    payload = F.struct(item.alias("type"), F.when(k == 3, "developer").otherwise("assistant").alias("role"), F.col("text").alias("message"), F.array(F.struct("text")).alias("content"))
    entries = transcripts.event_entries(_lines(fx.table(spark, sf, "conversations").select(F.to_json(F.struct(kind.alias("type"), payload.alias("payload"))).alias("value")), "s10"))
    return entries.groupBy(F.coalesce("speaker", "rule").alias("what")).agg(F.count("*").alias("n"))


@query(
    """WITH d AS (SELECT doc_id, doc_id % 4 AS k FROM documents)
SELECT CASE WHEN doc_id < 200 THEN 'HEALTH' ELSE 'PROJECTS' END AS section, CASE WHEN k = 3 THEN 'inferred' ELSE 'stated' END AS confidence, count(*) AS n, count(*) FILTER (WHERE k IN (1, 3)) AS dated, count(*) FILTER (WHERE k = 2) AS future_dated FROM d GROUP BY 1, 2"""
)
def s11_memory_dump(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.table(spark, sf, "documents")
    k = F.col("doc_id") % 4
    day = F.when(k == 0, "unknown").when(k == 2, "2031-01-01").otherwise("2024-05-06")
    line = F.concat(F.lit("["), day, F.lit("] "), F.when(k == 3, "(inferred)").otherwise("(stated)"), F.lit(" - fact "), F.col("doc_id"))
    rows = d.select(F.col("doc_id").alias("n"), line.alias("value")).union(spark.createDataFrame([(-1, "HEALTH"), (1 << 60, "COMPLETE")], "n long, value string"))
    rows = rows.union(spark.createDataFrame([(199, "PROJECTS")], "n long, value string"))
    order = rows.orderBy("n", F.length("value").desc()).select("value")
    parsed = dump.parse(dump.read(spark, _texts(order.coalesce(1), "s11")).filter("text <> ''"), date(2025, 6, 1))
    return parsed.filter("kind = 'entry' and not dropped").groupBy("section", "confidence").agg(F.count("*").alias("n"), F.count("occurred_at").alias("dated"), F.count_if("future_dated").alias("future_dated"))


ARCHIVED = {"memory": "id long, namespace string, content string, superseded_by long", "registry": "namespace string, kind string, key string, value string"}


@query("SELECT 'memory' AS section, CAST(id AS VARCHAR) AS key, namespace, md5(content) AS value, superseded_by AS next FROM fx_memory UNION ALL SELECT 'registry', key, namespace, md5(value), NULL FROM fx_registry")
def s12_archive_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every record as it comes back, from members of 300."""
    tables = {"memory": mem(spark, sf).select("id", "namespace", "content", "superseded_by"), "registry": fx.fx_registry(spark, sf).select("namespace", "kind", "key", "value")}
    path = scratch(spark, "s12")
    archive.write(tables, path, "2025-06-01T00:00:00Z", keys={"registry": ["namespace", "kind", "key"]}, member_rows=300)
    back = archive.read(spark, path, ARCHIVED)
    facts = back["memory"].select(F.lit("memory").alias("section"), F.col("id").cast("string").alias("key"), "namespace", F.md5("content").alias("value"), F.col("superseded_by").alias("next"))
    return facts.unionAll(back["registry"].select(F.lit("registry"), "key", "namespace", F.md5("value"), F.lit(None).cast("long")))


@query(f"SELECT count(*) AS notes, count(DISTINCT doc_id) AS files, true AS same_bytes FROM documents d JOIN fx_memory m ON m.id = d.doc_id WHERE {live_sql()}")
def s14_vault_files(spark: SparkSession, sf: str) -> DataFrame:
    """The vault as files, against its manifest and its notes."""
    notes, base = archive.vault(mem(spark, sf).filter(live(NOW))), scratch(spark, "s14")
    manifest = archive.write_vault(notes, base)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(f"{base}/vault")
    there = read.select(F.regexp_replace("path", "^.*/(?=vault/memory/)", "").alias("path"), "length", F.sha2("content", 256).alias("found"))
    both = manifest.join(there, "path", "left").join(notes.select("path", F.sha2("contents", 256).alias("wanted")), "path", "full")
    return both.agg(F.count("bytes").alias("notes"), F.count("length").alias("files"), F.bool_and((F.col("bytes") == F.col("length")) & (F.col("sha256") == F.col("wanted")) & (F.col("found") == F.col("wanted"))).alias("same_bytes"))


@query()
def s14_vault_notes(spark: SparkSession, sf: str) -> DataFrame:
    """A note for every fact: what was replaced stays, says so, and links both ways."""
    return archive.vault(mem(spark, sf)).select("path", F.md5("contents").alias("contents"))


@query("SELECT count(*) AS questions, CAST(count(*) * 2 AS BIGINT) AS sessions, count(*) AS gold FROM (SELECT conv_id FROM conversations GROUP BY conv_id)")
def s15_question_set(spark: SparkSession, sf: str) -> DataFrame:
    turns = fx.table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("role", F.col("text").alias("content"))).alias("t"))
    i = F.col("conv_id").cast("string")
    q = turns.select(F.struct(i.alias("question_id"), F.lit("single").alias("question_type"), F.lit("what?").alias("question"), F.array(i, F.concat(i, F.lit("x"))).alias("haystack_session_ids"), F.array(F.lit("2023/05/20 (Sat) 02:21"), F.lit("2023/05/21 (Sun) 02:21")).alias("haystack_dates"), F.array(i).alias("answer_session_ids"), F.array("t", "t").alias("haystack_sessions")).alias("q"))
    path = scratch(spark, "s15")
    q.select("q.*").write.json(path)
    df = spark.read.schema(evaluation.QUESTION).json(path)
    s = evaluation.sessions(df)
    return df.agg(F.count("*").alias("questions")).crossJoin(F.broadcast(s.agg(F.count("*").alias("sessions"), F.count_if("gold").alias("gold"))))


@query("SELECT CASE WHEN doc_id % 3 < 2 THEN 'good' ELSE 'refused' END AS verdict, count(*) AS n, CAST(sum(CASE WHEN doc_id % 3 = 0 THEN doc_id END) AS BIGINT) AS expected FROM documents WHERE regexp_matches(text, '[a-z]') GROUP BY 1")
def s16_golden_cases(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    case = F.to_json(F.struct(F.col("text").alias("question"), F.when(i % 3 != 1, i.cast("string")).alias("expect_id"), F.when(i % 3 > 0, "none").alias("expect")))
    good, refused = evaluation.cases(spark, _texts(fx.table(spark, sf, "documents").filter("text rlike '[a-z]'").select(case.alias("value")), "s16"))
    counted = lambda df, name, ids: df.agg(F.count("*").alias("n"), F.sum(ids).cast("long").alias("expected")).select(F.lit(name).alias("verdict"), "n", "expected")
    return counted(good, "good", F.col("expect_id").cast("long")).unionAll(counted(refused, "refused", F.lit(None).cast("long")))


UUID = "00000000-0000-0000-0000-000000000001"


def _fence_lines(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.col("turn")
    mark = F.when(turn == 1, F.lit(f"{ingest.FENCE_BEGIN}{UUID}")).when(turn == 2, F.lit(f"{ingest.FENCE_END}{UUID}")).otherwise(F.col("text"))
    return fx.table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("file_path"), (turn * 1000).alias("byte_start"), mark.alias("text"))


@query("SELECT CAST(conv_id AS VARCHAR) AS file_path, count(*) FILTER (WHERE turn IN (1, 2)) AS fenced, count(*) FILTER (WHERE turn NOT IN (1, 2) AND NOT (NOT two AND one AND turn > 2)) AS kept FROM (SELECT *, bool_or(turn = 1) OVER (PARTITION BY conv_id) AS one, bool_or(turn = 2) OVER (PARTITION BY conv_id) AS two FROM conversations) GROUP BY conv_id")
def x41_fences(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.fenced(_fence_lines(spark, sf)).groupBy("file_path").agg(F.count_if("fenced").alias("fenced"), F.count_if(~F.col("fenced")).alias("kept"))


@query("SELECT doc_id, CASE WHEN contains(text, 'the and') THEN 'memory_context' END AS token FROM documents")
def x42_backstop(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "documents").select("doc_id", ingest.backstop("text", {"memory_context": "the and"}).alias("token"))


@query("""SELECT doc_id AS client_id, CASE WHEN doc_id % 2 = 0 THEN 'Tab ' ELSE 'TAB ' END || (doc_id // 2) ||
  CASE WHEN n = 1 THEN '' WHEN (doc_id // 2) % 3 = 0 THEN ' (' || (2023 + doc_id % 2) || ')' WHEN (doc_id // 2) % 3 = 1 THEN ' (2024-0' || (1 + doc_id % 2) || ')' ELSE ' #' || (1 + doc_id % 2) END AS label
FROM (SELECT doc_id, count(*) OVER (PARTITION BY doc_id // 2) AS n FROM documents)""")
def l15_client_names(spark: SparkSession, sf: str) -> DataFrame:
    n, pair = F.col("doc_id"), F.floor(F.col("doc_id") / 2)
    day = F.when(pair % 3 == 0, F.make_date(2023 + (n % 2).cast("int"), F.lit(1), F.lit(1))).when(pair % 3 == 1, F.make_date(F.lit(2024), 1 + (n % 2).cast("int"), F.lit(1))).otherwise(F.make_date(F.lit(2024), F.lit(1), F.lit(1)))
    rows = fx.table(spark, sf, "documents").select(n.alias("client_id"), F.concat(F.when(n % 2 == 0, "Tab ").otherwise("TAB "), pair).alias("name"), day.cast("timestamp").alias("consented_at"))
    return clients.name_clients(rows).select("client_id", "label")


# ---- Streams ----


def _events(spark: SparkSession, sf: str) -> DataFrame:
    schema = fx.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    path = f"{sf}/events.parquet"
    probe = spark._jvm.org.apache.hadoop.fs.Path(path)
    if probe.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(probe).isFile():
        stream, path = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet"), sf
    return fx.tool_calls_of(stream.parquet(path))


def _drained(df: DataFrame, mode: str, name: str) -> DataFrame:
    """The stream run over all there is, into a table of the shared folder."""
    spark = df.sparkSession
    out = scratch(spark, name)
    if mode == "complete":
        write = df.writeStream.outputMode("complete").foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(out))
    else:
        write = df.writeStream.outputMode(mode).format("parquet").option("path", out)
    write.option("checkpointLocation", scratch(spark, f"{name}-offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@query("SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S') AS hour, tool, count(*) AS calls, count(*) FILTER (WHERE NOT succeeded) AS failures FROM fx_tool_calls GROUP BY 1, 2")
def t01_hourly_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _drained(calls.hourly(_events(spark, sf)), "complete", "t01").withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT client, bucket, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS calls FROM (SELECT client, date_trunc('hour', created_at) AS hour, coalesce(session_id, 'hour:' || strftime(created_at, '%Y-%m-%d %H')) AS bucket FROM fx_tool_calls) GROUP BY client, bucket, hour")
def t02_session_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _drained(calls.sessions(_events(spark, sf)), "complete", "t02").select("client", "bucket", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "calls")


@query("SELECT strftime(until, '%Y-%m-%d %H:%M:%S') AS until, client, count(*) AS calls FROM (SELECT client, unnest(list_transform(range(1, 25), lambda i: date_trunc('hour', created_at) + to_hours(CAST(i AS INTEGER)))) AS until FROM fx_tool_calls) GROUP BY 1, 2")
def t03_sliding_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _drained(calls.sliding(_events(spark, sf)), "complete", "t03").select(ts("until"), "client", "calls")


@query(
    """SELECT e.memory_id, strftime(e.first_emitted_at, '%Y-%m-%d %H:%M:%S') AS first_emitted_at, o.probe_id
FROM fx_emission e JOIN (SELECT id AS probe_id, sha256(regexp_replace(lower(trim(regexp_replace(content, '\\s+', ' ', 'g'))), '[.!?,;:]+$', '')) AS hash, created_at + INTERVAL 30 DAY AS observed_at FROM fx_memory) o ON e.content_sha256 = o.hash
WHERE e.first_emitted_at <= o.observed_at + INTERVAL 300 SECOND AND e.first_emitted_at >= o.observed_at - INTERVAL 90 DAY"""
)
def t07_echo_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Emissions and what was said after, both as streams."""
    said = mem(spark, sf).select(F.col("id").alias("probe_id"), content_digest("content").alias("content_sha256"), (F.col("created_at") + F.make_dt_interval(days=F.lit(30))).alias("observed_at"))
    sides = []
    for name, rows in (("shown", fx.fx_emission(spark, sf)), ("said", said)):
        path = scratch(spark, f"t07-{name}")
        rows.write.parquet(path)
        sides.append(spark.readStream.schema(rows.schema).parquet(path))
    return _drained(calls.echoes(*sides), "append", "t07").select("memory_id", ts("first_emitted_at"), "probe_id")


@query("SELECT count(DISTINCT client || tool) AS n FROM fx_tool_calls WHERE tool IS NOT NULL")
def t08_first_seen_stream(spark: SparkSession, sf: str) -> DataFrame:
    facts = _events(spark, sf).filter("tool is not null").select(F.concat("client", "tool").alias("content_sha256"), F.col("created_at").alias("observed_at"))
    return _drained(calls.first_seen(facts, "3650 days"), "append", "t08").agg(F.count("*").alias("n"))


@query("SELECT CAST(conv_id AS VARCHAR) AS file_path, turn * 1000 AS byte_start FROM (SELECT *, bool_or(turn = 1) OVER (PARTITION BY conv_id) AS one, bool_or(turn = 2) OVER (PARTITION BY conv_id) AS two FROM conversations) WHERE turn NOT IN (1, 2) AND NOT (NOT two AND one AND turn > 2)")
def t09_fence_stream(spark: SparkSession, sf: str) -> DataFrame:
    lines = _fence_lines(spark, sf)
    path = scratch(spark, "t09-lines")
    lines.write.parquet(path)
    return _drained(calls.fences(spark.readStream.schema(lines.schema).parquet(path)), "append", "t09").select("file_path", "byte_start")


@query("SELECT strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS through FROM fx_tool_calls")
def t04_watermark_stream(spark: SparkSession, sf: str) -> DataFrame:
    table = scratch(spark, "t04")
    stream = _events(spark, sf).writeStream.foreachBatch(calls.advance(table)).option("checkpointLocation", scratch(spark, "t04-offsets"))
    stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(table).agg(F.max("through").alias("through")).select(ts("through"))
