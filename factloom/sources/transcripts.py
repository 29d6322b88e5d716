"""Two transcript formats, classified into (speaker, rule) by SQL conditions
in order: the first that holds decides. A line that is no JSON is counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ingest import is_memory_tool

# Kinds of entries and beginnings of texts that are no conversation.
SYSTEM_TYPES = ["system", "summary", "mode", "permission-mode", "bridge-session", "ai-title", "pr-link", "last-prompt", "queue-operation", "started", "result"]
COMMAND_PREFIXES = ["<command-name>", "<local-command-stdout>", "<command-message>", "<task-notification>", "<local-command-caveat>"]
CONTINUED = "This session is being continued from a previous"


def _j(path: str, of: str | Column = "text") -> Column:
    return F.get_json_object(F.col(of) if isinstance(of, str) else of, path)


ITEMS = "array<struct<type:string,text:string,id:string,name:string,tool_use_id:string,content:string>>"


def typed_entries(lines: DataFrame, agent_file: Column | None = None) -> DataFrame:
    """Format A, one typed entry a line -> file_path, byte_start, byte_end, id,
    at, cwd, session_id, speaker, rule, body, tool_use_id. Entries with a rule
    are left out of the conversation; tool results give one row each."""
    agent = F.lit(False) if agent_file is None else agent_file
    body = _j("$.message.content")
    rows = lines.filter("not oversized").withColumns(
        {"kind": _j("$.type"), "id": _j("$.uuid"), "at": F.try_to_timestamp(_j("$.timestamp")), "cwd": _j("$.cwd"), "session_id": _j("$.sessionId"), "side": F.coalesce(_j("$.isSidechain") == "true", F.lit(False)), "raw": body, "items": F.when(F.startswith(body, F.lit("[")), F.from_json(body, ITEMS))}
    )
    texts = F.array_join(F.transform(F.filter("items", lambda i: i.type == "text"), lambda i: i.text), "\n")
    results = F.filter("items", lambda i: i.type == "tool_result")
    rows = rows.withColumns({"agent": agent, "said": F.when(F.col("items").isNotNull(), texts).otherwise(F.col("raw")), "results": results, "all_text": F.forall("items", lambda i: i.type == "text")})
    head = F.ltrim("said")
    user, assistant = F.col("kind") == "user", F.col("kind") == "assistant"
    asked = F.coalesce(_j("$.promptSource"), F.lit("user")) != "user"
    command = F.lit(False)
    for p in COMMAND_PREFIXES:
        command = command | F.startswith(head, F.lit(p))
    yes = lambda p: F.coalesce(_j(p) == "true", F.lit(False))
    typed = user & ~F.col("agent") & ~F.col("side")
    rule = (
        F.when(F.col("kind").isNull(), "unknown")
        .when(F.col("kind") == "attachment", "attachment")
        .when(user & F.col("raw").isNull(), "unknown")
        .when(user & (F.size("results") > 0), None)
        .when(user & F.col("items").isNotNull() & ~F.col("all_text"), "mixed_content")
        .when(typed & yes("$.isMeta"), "meta_user")
        .when(typed & (yes("$.isCompactSummary") | F.startswith(head, F.lit(CONTINUED))), "compact_summary")
        .when(typed & asked, "prompt_source_not_user")
        .when(typed & command, "command_text")
        .when(typed & F.startswith(head, F.lit("<system-reminder>")), "system_reminder_in_user")
        .when(user | assistant, None)
        .when(F.col("kind").isin(*SYSTEM_TYPES) | F.startswith("kind", F.lit("file-history")), "system")
        .otherwise("unknown")
    )
    speaker = F.when(user & (F.size("results") > 0), "tool_returned").when(assistant & (F.col("side") | F.col("agent")), "subagent").when(assistant, "main_model").when(user & F.col("agent"), "main_model").when(user & F.col("side"), "subagent").when(user, "owner_typed")
    rows = rows.withColumns({"rule": rule, "speaker": F.when(rule.isNull(), speaker)})
    one = F.when(F.col("rule").isNull() & user & (F.size("results") > 0), F.transform("results", lambda r: F.struct(r.tool_use_id.alias("tool_use_id"), F.coalesce(r.content, F.lit("")).alias("body")))).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("tool_use_id"), F.col("said").alias("body"))))
    keep = ["file_path", "byte_start", "byte_end", "id", "at", "cwd", "session_id", "speaker", "rule"]
    return rows.select(*keep, F.explode(one).alias("e")).select(*keep, "e.body", "e.tool_use_id")


def tool_uses(lines: DataFrame) -> DataFrame:
    """(file_path, byte_start, tool_use_id, name) of the calls that assistants make in format A."""
    items = F.from_json(_j("$.message.content"), ITEMS)
    use = F.filter(items, lambda i: (i.type == "tool_use") & i.id.isNotNull() & i.name.isNotNull())
    rows = lines.filter((_j("$.type") == "assistant") & F.startswith(_j("$.message.content"), F.lit("[")))
    return rows.select("file_path", "byte_start", F.explode(use).alias("u")).select("file_path", "byte_start", F.col("u.id").alias("tool_use_id"), F.col("u.name").alias("name"))


def event_entries(lines: DataFrame) -> DataFrame:
    """Format B, events with a payload -> file_path, byte_start, byte_end, id,
    at, speaker, rule, body, tool_use_id (the call)."""
    kind, item, role = _j("$.type"), _j("$.payload.type"), _j("$.payload.role")
    content = F.from_json(_j("$.payload.content"), "array<struct<text:string>>")
    said = F.array_join(F.transform(content, lambda c: c.text), "\n")
    call = item.isin("function_call", "custom_tool_call")
    output = item.isin("function_call_output", "custom_tool_call_output")
    response = kind == "response_item"
    own = is_memory_tool(_j("$.payload.name"))
    rule = (
        F.when(kind.isNull(), "unknown")
        .when(kind.isin("session_meta", "turn_context", "token_count", "compacted"), "system")
        .when((kind == "event_msg") & (item == "user_message"), None)
        .when((kind == "event_msg") & (item == "agent_message"), "duplicate_agent_message")
        .when(kind == "event_msg", "system")
        .when(response & (item == "message") & (role == "developer"), "developer")
        .when(response & (item == "message") & (role == "assistant"), None)
        .when(response & (item == "message") & (role == "user") & F.contains(said, F.lit("<environment_context>")), "environment_context")
        .when(response & call & F.coalesce(own, F.lit(False)), "memory_tool")
        .when(response & output, None)
        .when(response, "system")
        .otherwise("unknown")
    )
    speaker = F.when(kind == "event_msg", "owner_typed").when(output, "tool_returned").otherwise("main_model")
    body = F.when(kind == "event_msg", _j("$.payload.message")).when(output, _j("$.payload.output")).otherwise(said)
    return lines.filter("not oversized").select("file_path", "byte_start", "byte_end", _j("$.payload.id").alias("id"), F.try_to_timestamp(_j("$.timestamp")).alias("at"), F.when(rule.isNull(), speaker).alias("speaker"), rule.alias("rule"), body.alias("body"), F.when(output, _j("$.payload.call_id")).alias("tool_use_id"))


def event_calls(lines: DataFrame) -> DataFrame:
    """(file_path, byte_start, tool_use_id, name) of the calls in format B."""
    rows = lines.filter((_j("$.type") == "response_item") & _j("$.payload.type").isin("function_call", "custom_tool_call"))
    return rows.select("file_path", "byte_start", _j("$.payload.call_id").alias("tool_use_id"), _j("$.payload.name").alias("name"))


def counters(entries: DataFrame) -> DataFrame:
    """How many entries each rule left out."""
    return entries.filter("rule is not null").groupBy("rule").agg(F.count("*").alias("n"))
