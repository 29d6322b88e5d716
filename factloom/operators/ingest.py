"""From transcripts to proposals: runs of speakers, fences, chunks, echoes,
outcomes and watermarks."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import credentials, guards
from ..functions.predicates import Grant, any_of, readable
from ..functions.text import content_digest, qualifies_for_auto
from .policy import first_rule_level, visible_at_level

# How near in time an echo lies, speakers by strength, and sizes.
ECHO_SLACK, ECHO_DAYS = 300, 90
SPEAKERS = ["owner_typed", "owner_pasted", "main_model", "subagent", "tool_returned", "system"]
SPAN_CHARS, CHUNK_CHARS = 4000, 24000
JOIN = "\n\n"
# Markers are the deployment's own; these are the defaults.
FENCE_BEGIN, FENCE_RUN, FENCE_END = "memory-ingest-begin:", "memory-ingest-run:", "memory-ingest-end:"
MEMORY_TOOLS = ("mcp__memory__",)
BACKSTOPS = {"memory_context": "<memory-context"}


def strongest_speaker(speaker: str) -> Column:
    rank = F.lit(0)
    for k, name in enumerate(SPEAKERS):
        rank = F.when(F.col(speaker) == name, len(SPEAKERS) - k).otherwise(rank)
    return F.max_by(speaker, rank)


def is_memory_tool(name: str | Column, prefixes: Sequence[str] = MEMORY_TOOLS) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return any_of(F.startswith(c, F.lit(p)) for p in prefixes)


def backstop(text: str | Column, tokens: dict[str, str] = BACKSTOPS) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    out = F.lit(None).cast("string")
    for name, token in reversed(tokens.items()):
        out = F.when(F.contains(c, F.lit(token)), name).otherwise(out)
    return out


def islands(entries: DataFrame, session: str = "session_id", order: str = "turn", by: Sequence[str] = ("speaker",)) -> DataFrame:
    """entries with ``island``: the number of the run of one speaker."""
    w = W.partitionBy(session).orderBy(order)
    new = any_of(~F.col(c).eqNullSafe(F.lag(c).over(w)) for c in by) | (F.row_number().over(w) == 1)
    return entries.withColumn("island", F.sum(new.cast("long")).over(w))


def spans(entries: DataFrame, cap: int = SPAN_CHARS, session: str = "session_id", order: str = "turn") -> DataFrame:
    """Runs of one speaker cut where they would pass the cap, joined by a blank
    line; a longer entry is cut into windows of the cap. Which entry begins a
    span depends on all before it, so a session is read in order by one task;
    sessions are many and small against the table."""
    kinds = {c: entries.schema[c].dataType.simpleString() for c in (session, order)}

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        out, group, chars = [], [], 0

        def flush() -> None:
            whole = JOIN.join(t for _, _, t in group)
            for at in range(0, max(1, len(whole)), cap):
                out.append((pdf[session].iloc[0], len(out), group[0][1], group[0][0], group[-1][0], whole[at : at + cap]))

        for turn, speaker, text in pdf.sort_values(order)[[order, "speaker", "text"]].itertuples(index=False):
            if not isinstance(text, str) or not text.strip():
                continue
            added = len(text) + (len(JOIN) if group else 0)
            if group and (speaker != group[-1][1] or chars + added > cap):
                flush()
                group, chars, added = [], 0, len(text)
            group.append((turn, speaker, text))
            chars += added
        if group:
            flush()
        return pd.DataFrame(out, columns=["session_id", "span", "speaker", "first", "last", "text"])

    return entries.groupBy(session).applyInPandas(cut, f"session_id {kinds[session]}, span long, speaker string, first {kinds[order]}, last {kinds[order]}, text string")


def pack(parts: DataFrame, group: str, order: str, text: str = "text", budget: int = CHUNK_CHARS, joiner: str = "\n") -> DataFrame:
    """(group, chunk, text): parts of a group joined in order into chunks of at
    most a budget of characters, each as full as order allows."""
    kind = parts.schema[group].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chunks: list[list[str]] = []
        size = 0
        for piece in pdf.sort_values(order)[text]:
            for at in range(0, len(piece), budget):
                p = piece[at : at + budget]
                if not chunks or size + len(joiner) + len(p) > budget:
                    chunks.append([])
                    size = -len(joiner)
                chunks[-1].append(p)
                size += len(joiner) + len(p)
        return pd.DataFrame([(pdf[group].iloc[0], k, joiner.join(c)) for k, c in enumerate(chunks)], columns=["g", "chunk", "text"])

    return parts.groupBy(group).applyInPandas(run, f"g {kind}, chunk long, text string").withColumnRenamed("g", group)


def render_turns(turns: str = "turns") -> Column:
    """``role: content`` lines of an array of (role, content)."""
    lines = F.transform(F.filter(turns, lambda t: F.trim(t.content) != ""), lambda t: F.when(F.trim(t.role) == "", F.trim(t.content)).otherwise(F.concat(F.trim(t.role), F.lit(": "), F.trim(t.content))))
    return F.array_join(lines, "\n")


_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")


class Fence:
    """Between a begin (or run) marker with a uuid and the end marker with the
    same one, lines are the pipeline's own output and no source."""

    def __init__(self, opened: str | None = None, since: int | None = None, markers: tuple[str, str, str] = (FENCE_BEGIN, FENCE_RUN, FENCE_END)) -> None:
        self.opened, self.since, self.markers = opened, since, markers

    @staticmethod
    def _uuid(line: str, marker: str) -> str | None:
        """Its uuid in lower case, '' for a marker without one, None without a marker."""
        at = line.find(marker)
        if at < 0:
            return None
        m = _UUID.match(line, at + len(marker))
        return m[0].lower() if m else ""

    def observe(self, line: str, offset: int) -> tuple[bool, str | None]:
        """(whether the line is fenced, what is odd about it)."""
        begin, run, end = (self._uuid(line, m) for m in self.markers)
        begin = run if begin is None else begin
        if self.opened is None:
            if begin:
                self.opened, self.since = begin, offset
                return True, None
            return False, "begin_no_uuid" if begin == "" else "end_no_uuid" if end == "" else None
        odd = None
        if end == self.opened:
            self.opened = self.since = None
        elif end is not None:
            odd = "close_mismatch"
        return True, odd


def fenced(lines: DataFrame, file: str = "file_path", offset: str = "byte_start", text: str = "text") -> DataFrame:
    """lines with ``fenced``, ``odd`` and ``open_since`` (of the file, where a
    fence is never closed). A file is read in order by one task."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields) + ", fenced boolean, odd string, open_since long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(offset)
        fence = Fence()
        seen = [fence.observe(t or "", int(o)) for t, o in zip(pdf[text], pdf[offset], strict=True)]
        return pdf.assign(fenced=[a for a, _ in seen], odd=[b for _, b in seen], open_since=pd.Series([fence.since] * len(pdf), index=pdf.index, dtype="Int64"))

    return lines.groupBy(file).applyInPandas(run, ddl)


def join_tool_results(uses: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(joined, lost): each result with the name of its use, which stands
    before it in the same file; results without one are not kept."""
    named = uses.select("file_path", "tool_use_id", F.col("byte_start").alias("_use"), F.col("name").alias("tool_name"))
    on = ["file_path", "tool_use_id"]
    both = results.join(named, on, "left").withColumn("_ok", F.col("_use") < F.col("byte_start"))
    best = W.partitionBy("file_path", "byte_start", "tool_use_id").orderBy(F.col("_ok").desc_nulls_last(), F.col("_use").desc())
    one = both.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n", "_use")
    return one.filter("_ok").drop("_ok"), one.filter(~F.coalesce("_ok", F.lit(False))).drop("_ok", "tool_name")


def resolve_spans(facts: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts with their spans, facts whose span is unknown)."""
    both = facts.join(known.withColumnRenamed("id", "source_span_id"), "source_span_id", "left").withColumn("_known", F.col("speaker").isNotNull())
    return both.filter("_known").drop("_known"), facts.join(known.select(F.col("id").alias("source_span_id")), "source_span_id", "left_anti")


def hold_back(chunks: DataFrame, known: DataFrame, extracted: DataFrame) -> DataFrame:
    """(file_path, hold_at): the first byte of what no extraction took."""
    left = chunks.join(extracted, "chunk_id", "left_anti").select(F.explode("span_ids").alias("id"))
    return left.join(known, "id").groupBy("file_path").agg(F.min("byte_start").alias("hold_at"))


def emissions_matching(emissions: DataFrame, probes: DataFrame, memory: DataFrame, grants: Sequence[Grant], slack: int = ECHO_SLACK, days: int = ECHO_DAYS) -> DataFrame:
    """Probes (content_sha256, observed_at, …) with what the store itself had
    shown in the window before, as far as the caller may read it."""
    seen = memory.filter(readable(grants)).select(F.col("id").alias("memory_id"), "namespace", "sensitivity")
    near = emissions.join(probes, "content_sha256").filter((F.col("first_emitted_at") <= F.col("observed_at") + F.make_dt_interval(secs=F.lit(slack))) & (F.col("first_emitted_at") >= F.col("observed_at") - F.make_dt_interval(days=F.lit(days))))
    return near.join(seen, "memory_id").distinct()


def echoes(emissions: DataFrame, probes: DataFrame, memory: DataFrame, grants: Sequence[Grant], digest: str = "content_sha256", slack: int = ECHO_SLACK, days: int = ECHO_DAYS) -> DataFrame:
    """probes (a digest, observed_at, …) with ``echo``: whether ``emissions_matching``
    has any row for them. Which one does not matter, so copies make no pairs: time is
    cut into stretches as long as the window, a window lies in two of them, and of a
    digest's emissions the last of the one and the first of the other decide.

    The join is null-safe, and nulls are told apart after it, as a filter of nulls
    would take each digest once more ahead of it."""
    day, length = 86_400_000_000, (days * 86_400 + slack) * 1_000_000
    begin = lambda t: t - F.pmod(t, F.lit(length))
    seen = memory.filter(readable(grants)).select(F.col("id").alias("memory_id"))
    shown = emissions.join(seen, "memory_id", "left_semi").select(F.col("content_sha256").alias("_digest"), F.unix_micros("first_emitted_at").alias("_t"))
    t, none = F.col("_t"), F.lit(None).cast("long")
    as_last = F.struct(begin(t).alias("_begin"), t.alias("_last"), none.alias("_first"))
    as_first = F.struct((begin(t) - length).alias("_begin"), none.alias("_last"), t.alias("_first"))
    near = shown.select("_digest", F.inline(F.array(as_last, as_first))).groupBy("_digest", "_begin").agg(F.max("_last").alias("_last"), F.min("_first").alias("_first"))
    since = F.unix_micros("observed_at") - days * day
    both = probes.withColumns({"_since": since, "_at": begin(since)}).join(near, F.col(digest).eqNullSafe(F.col("_digest")) & F.col("_at").eqNullSafe(F.col("_begin")), "left")
    echo = F.col(digest).isNotNull() & ((F.col("_last") >= F.col("_since")) | (F.col("_first") <= F.col("_since") + length))
    return both.withColumn("echo", F.coalesce(echo, F.lit(False))).drop("_since", "_at", "_digest", "_begin", "_last", "_first")


def record_emissions(emissions: DataFrame, shown: DataFrame) -> DataFrame:
    """shown (content_sha256, memory_id, tool, session_id, emitted_at): counts
    go up, the last time moves, a known session stays."""
    key = ["content_sha256", "memory_id", "tool"]
    new = shown.groupBy(*key).agg(F.min("emitted_at").alias("_first"), F.max("emitted_at").alias("_last"), F.count("*").alias("_n"), F.max("session_id").alias("_session"))
    both = emissions.join(new, key, "full")
    return both.select(
        *key,
        F.coalesce("session_id", "_session").alias("session_id"),
        F.coalesce("first_emitted_at", "_first").alias("first_emitted_at"),
        F.greatest("last_emitted_at", "_last").alias("last_emitted_at"),
        (F.coalesce("emit_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("emit_count"),
    )


def post(facts: DataFrame, proposals: DataFrame, emissions: DataFrame, memory: DataFrame, grants: Sequence[Grant], rules: Sequence[tuple[str, str]], now: datetime) -> DataFrame:
    """facts (fact_id, content, namespace, speaker, span_text, observed_at) with
    ``outcome``: refused_namespace, refused_grant, refused_credential, echo,
    reinforced (proposed before), duplicate (of a fact in this batch), or
    proposed; and ``auto``."""
    ns = guards.namespace("namespace")
    rows = facts.withColumns({"namespace": F.coalesce(ns, F.col("namespace")), "_ns_ok": F.coalesce(ns.isNotNull() & guards.writable(ns), F.lit(False)), "fingerprint": content_digest("content")})
    level = first_rule_level("namespace", rules)
    granted = visible_at_level(grants, level)
    read = F.when(F.col("_ns_ok") & granted & (level == "open"), F.col("content"))  # all others are refused before, or stored above the open
    rows = rows.withColumn("_cred", credentials.finding(read).isNotNull())
    before = proposals.select(F.col("fingerprint").alias("_print"), F.col("namespace").alias("_of")).distinct().withColumn("_before", F.lit(True))
    first = W.partitionBy("fingerprint", "namespace").orderBy(F.col("observed_at").asc_nulls_last(), "fact_id")
    told = echoes(emissions, rows, memory, grants, "fingerprint")
    known = F.col("fingerprint").eqNullSafe(F.col("_print")) & F.col("namespace").eqNullSafe(F.col("_of"))
    flagged = told.join(before, known, "left").withColumn("_nth", F.row_number().over(first))
    outcome = (
        F.when(~F.col("_ns_ok"), "refused_namespace").when(~granted, "refused_grant").when(F.col("_cred"), "refused_credential").when(F.col("echo"), "echo").when(F.col("_before") & F.col("fingerprint").isNotNull(), "reinforced").when(F.col("_nth") > 1, "duplicate").otherwise("proposed")
    )
    return flagged.withColumns({"outcome": outcome, "auto": qualifies_for_auto("speaker", "content", "span_text")}).drop("_ns_ok", "_cred", "echo", "_print", "_of", "_before", "_nth")


def approval_order(proposals: DataFrame, sources: DataFrame) -> DataFrame:
    """Proposals by their earliest observation, undated ones last."""
    seen = sources.groupBy("proposal_id").agg(F.min("observed_at").alias("observed_at"))
    return proposals.join(seen, proposals.id == seen.proposal_id, "left").drop("proposal_id").orderBy(F.col("observed_at").asc_nulls_last(), "id")


def visible_page(proposals: DataFrame, sources: DataFrame, grants: Sequence[Grant], rules: Sequence[tuple[str, str]], *, state: str | None = None, auto: bool | None = None, speaker: str | None = None, run_id: str | None = None, limit: int = 50) -> DataFrame:
    """The newest proposals that the caller could read once they were facts."""
    rows = proposals.filter(visible_at_level(grants, first_rule_level("namespace", rules)))
    for column, wanted in (("state", state), ("auto", auto), ("speaker", speaker)):
        rows = rows if wanted is None else rows.filter(F.col(column) == wanted)
    if run_id is not None:
        rows = rows.join(sources.filter(F.col("run_id") == run_id).select(F.col("proposal_id").alias("id")), "id", "left_semi")
    return rows.orderBy(F.col("created_at").desc(), "id").limit(limit)


def advance_watermarks(marks: DataFrame, reached: DataFrame, holds: DataFrame, now: datetime) -> DataFrame:
    """Offsets never go back, stop before what is held, and the hash goes with
    the offset that wins. reached: (file_path, byte_offset, prefix_sha256)."""
    limited = reached.join(holds, "file_path", "left").select("file_path", F.least("byte_offset", "hold_at").alias("_to"), F.col("prefix_sha256").alias("_hash"), (F.col("hold_at") < F.col("byte_offset")).alias("_held"))
    both = marks.join(limited, "file_path", "full")
    moves = F.col("_to") > F.coalesce("byte_offset", F.lit(-1))
    out = {"byte_offset": F.greatest("byte_offset", "_to"), "prefix_sha256": F.when(moves & ~F.coalesce("_held", F.lit(False)), F.col("_hash")).otherwise(F.col("prefix_sha256")), "updated_at": F.when(moves, F.lit(now)).otherwise(F.col("updated_at"))}
    return both.withColumns(out).select(*marks.columns)


def set_skip(marks: DataFrame, skips: DataFrame) -> DataFrame:
    """skips (file_path, reason): the first reason given stays."""
    both = marks.join(skips.groupBy("file_path").agg(F.min("reason").alias("_why")), "file_path", "left")
    return both.withColumn("skip_reason", F.coalesce("skip_reason", "_why")).select(*marks.columns)


def clear_skip(marks: DataFrame, files: DataFrame) -> DataFrame:
    cleared = marks.join(files.select("file_path").withColumn("_clear", F.lit(True)), "file_path", "left")
    return cleared.withColumn("skip_reason", F.when(F.col("_clear"), None).otherwise(F.col("skip_reason"))).select(*marks.columns)


def watermark_listing(marks: DataFrame, skipped_only: bool = False) -> DataFrame:
    return (marks.filter("skip_reason is not null") if skipped_only else marks).orderBy("file_path")


def clear_plaintext(proposals: DataFrame, memory: DataFrame) -> DataFrame:
    """A proposal keeps its words only while it waits, or while its fact is in
    the clear: content and quote go once it is decided and its fact is gone or sealed."""
    facts = memory.select(F.col("id").alias("memory_id"), F.col("content").isNotNull().alias("_clear"))
    rows = _of_facts(proposals, facts)
    drop = F.col("state").isin("written", "rejected") & ~F.coalesce("_clear", F.lit(False))
    return rows.withColumns({c: F.when(drop, None).otherwise(F.col(c)) for c in ("content", "quote")}).select(*proposals.columns)


def _of_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows with the columns of their fact, of facts (memory_id, …). Rows without
    a link pass by the join: the nulls of its key would meet in one task."""
    linked = rows.filter("memory_id is not null").join(facts, "memory_id", "left")
    return linked.unionByName(rows.filter("memory_id is null"), allowMissingColumns=True)


def _cleared(rows: DataFrame, gone: Column, columns: list[str]) -> DataFrame:
    return rows.withColumns({"content": F.when(gone, "").otherwise(F.col("content")), "quote": F.when(gone, None).otherwise(F.col("quote"))}).select(*columns)


def relinked(before: DataFrame, after: DataFrame, memory: DataFrame) -> DataFrame:
    """Proposals after a change of their links: the words of one go that now
    points at a sealed fact (one without content), or that lost its link."""
    was = before.select("id", F.col("memory_id").alias("_was"))
    sealed = memory.filter("content is null").select(F.col("id").alias("memory_id"), F.lit(True).alias("_sealed"))
    rows = _of_facts(after.join(was, "id", "left"), sealed)
    onto = F.col("memory_id").isNotNull() & ~F.col("memory_id").eqNullSafe(F.col("_was")) & F.coalesce("_sealed", F.lit(False))
    return _cleared(rows, onto | (F.col("_was").isNotNull() & F.col("memory_id").isNull()), after.columns)


def sealed_later(proposals: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Proposals after facts were sealed: the words of those go whose fact had
    its content before and has none now."""
    held = before.filter("content is not null").select("id")
    now = after.filter("content is null").join(held, "id", "left_semi").select(F.col("id").alias("memory_id"), F.lit(True).alias("_sealed"))
    return _cleared(_of_facts(proposals, now), F.coalesce("_sealed", F.lit(False)), proposals.columns)
