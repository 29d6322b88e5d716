"""What was decided about findings and about items under review, as batches.

Each decision is checked against the store as it is now, before anything is
changed; what can't be done is returned with the reason, and a decision is done
whole or not at all. Two decisions of one batch that touch a fact would depend
on their order, so the one with the smaller key is taken and the other refused; it can be asked
for again with the next batch, as can one whose rival was itself refused so.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import expired, sensitivity_rank
from ..functions.staging import written
from ..functions.text import inverted
from . import mutations
from .duplicates import live_members
from .review import VERDICTS

# Kinds of findings that name no survivor, and the one that deletes.
OPEN_KINDS, DELETING = ("contradiction", "stale"), "stale"


def _first_claim(rows: DataFrame, key: str, row: str) -> DataFrame:
    """(key): those one of whose facts a smaller key of the batch has too."""
    least = rows.groupBy(row).agg(F.min(key).alias("_least"))
    return rows.join(least, row).filter(F.col(key) > F.col("_least")).select(key).distinct()


def decide_findings(proposals: DataFrame, members: DataFrame, memory: DataFrame, decisions: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(proposals, memory, outcomes). proposals: id, kind, state, keep_id,
    decided_at, …; members: proposal_id, memory_id, content as it was seen,
    disposition (keep or retire); decisions: proposal_id, verb, keep_id, one
    row a proposal.

    apply needs a survivor among the finding's own members to keep, or a stale
    finding, whose facts are deleted; resolve names the survivor of a finding
    that has none. Nothing is done if a member is gone, retired, changed or over,
    or true later than what would replace it; reject closes, and unreject reopens what was rejected.
    """
    p = proposals.select(F.col("id").alias("proposal_id"), "kind", "state", F.col("keep_id").alias("_kept"))
    asked = decisions.select("proposal_id", "verb", "keep_id").join(p, "proposal_id", "left")
    applies, resolves = F.col("verb") == "apply", F.col("verb") == "resolve"
    keep = F.when(resolves, F.col("keep_id")).otherwise(F.col("_kept"))
    asked = asked.withColumn("_keep", keep)
    starts = memory.select(F.col("id").alias("memory_id"), F.col("occurred_at").alias("_start"), expired(now).alias("_expired"))
    kept = memory.select(F.col("id").alias("_keep"), F.col("occurred_at").alias("_next"))
    now_members = live_members(members, memory).join(asked.select("proposal_id", "_keep", "verb"), "proposal_id").join(starts, "memory_id", "left").join(kept, "_keep", "left")
    leaves = F.coalesce(F.col("memory_id") != F.col("_keep"), F.lit(False)) & ((F.col("verb") == "resolve") | (F.col("disposition") == "retire"))
    own = now_members.groupBy("proposal_id").agg(
        F.min("became").alias("_became"),
        F.coalesce(F.max((F.col("memory_id") == F.col("_keep")) & ((F.col("disposition") == "keep") | (F.col("verb") == "resolve"))), F.lit(False)).alias("_keeps"),
        F.coalesce(F.max(leaves & F.col("_expired")), F.lit(False)).alias("_ended"),
        F.coalesce(F.max(leaves & inverted(F.col("_start"), F.col("_next"))), F.lit(False)).alias("_inverted"),
    )
    shut = F.col("kind").isin(*OPEN_KINDS)
    reason = (
        F.when(F.col("kind").isNull(), "missing")
        .when(~F.col("verb").isin("apply", "resolve", "reject", "unreject"), "verb")
        .when((F.col("verb") == "unreject") & (F.col("state") != "rejected"), "not_rejected")
        .when((F.col("verb") != "unreject") & (F.col("state") != "pending"), "decided")
        .when(applies & (F.col("kind") == "contradiction"), "nothing_to_apply")
        .when(resolves & ~shut, "names_survivor")
        .when((applies | resolves) & F.col("_became").isNotNull(), F.concat(F.lit("member_"), "_became"))
        .when(((applies & ~shut) | resolves) & ~F.coalesce("_keeps", F.lit(False)), "survivor")
        .when(((applies & ~shut) | resolves) & F.col("_ended"), "expired")
        .when(((applies & ~shut) | resolves) & F.col("_inverted"), "inversion")
    )
    judged = asked.join(own, "proposal_id", "left").withColumn("reason", reason)
    moves = now_members.join(judged.filter("reason is null and verb in ('apply', 'resolve')").select("proposal_id", "kind"), "proposal_id")
    clash = _first_claim(moves.select("proposal_id", "memory_id"), "proposal_id", "memory_id").withColumn("_clash", F.lit(True))
    judged = written(judged.join(clash, "proposal_id", "left").withColumn("reason", F.when(F.col("reason").isNull() & F.col("_clash"), "claimed").otherwise(F.col("reason"))).select("proposal_id", "verb", "kind", "_keep", "reason"), "findings-judged")
    done = judged.filter("reason is null")
    mine = members.join(done.filter("verb in ('apply', 'resolve')"), "proposal_id")
    retired = F.when(F.col("verb") == "resolve", F.col("memory_id") != F.col("_keep")).otherwise((F.col("disposition") == "retire") & ~F.col("memory_id").eqNullSafe(F.col("_keep")))
    out = mine.filter(retired)
    deletes = (F.col("kind") == DELETING) & (F.col("verb") == "apply")
    after, _ = mutations.supersede(memory, out.filter(~deletes).select(F.col("memory_id").alias("old"), F.col("_keep").alias("new")), now)
    after = mutations.delete(written(after, "findings-linked"), out.filter(deletes).select(F.col("memory_id").alias("id")))
    to = F.when(F.col("_verb").isin("apply", "resolve"), "applied").when(F.col("_verb") == "reject", "rejected").when(F.col("_verb") == "unreject", "pending")
    rows = proposals.join(done.select(F.col("proposal_id").alias("id"), F.col("verb").alias("_verb")), "id", "left")
    at = F.when(F.col("_verb") == "unreject", None).when(F.col("_verb").isNotNull(), F.lit(now)).otherwise(F.col("decided_at"))
    state = rows.withColumns({"state": F.coalesce(to, F.col("state")), "decided_at": at}).select(*proposals.columns)
    return state, after, judged.select("proposal_id", "verb", "reason")


def _fits(source: str, verdict: str) -> Column:
    pairs = [(s, v) for s, vs in VERDICTS.items() for v in vs] + [("conflict", "delete"), ("stale", "delete")]
    told = F.struct(F.col(source).alias("s"), F.col(verdict).alias("v"))
    return told.isin(*[F.struct(F.lit(s).alias("s"), F.lit(v).alias("v")) for s, v in pairs if s != "proposal"])


def decide_items(memory: DataFrame, ledger: DataFrame, decisions: DataFrame, now: datetime, may_delete: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memory, ledger, outcomes) for conflicts and stale facts. decisions: key,
    source, verdict, a, b (null for a stale fact), keep, content, one row a key.

    supersede keeps the newer fact unless ``keep`` names one; merge writes
    ``content`` at the stricter level, with the newer one's start if that is a
    day old, and retires both; keep_both writes the pair to the ledger; delete
    takes the fact in ``keep``; confirm stamps it. What a merge would close in
    against valid time is refused whole. Ids are texts, as a merge makes one.
    """
    cols = ["namespace", "sensitivity", "occurred_at", "created_at", "superseded_by"]
    side = lambda x: memory.select(F.col("id").alias(x), F.struct(*cols, expired(now).alias("expired")).alias(f"_{x}"))
    rows = decisions.join(side("a"), "a", "left").join(side("b"), "b", "left")
    pair = F.col("source") == "conflict"
    b_newer = F.coalesce(F.struct(F.col("_b.created_at"), F.col("b")) > F.struct(F.col("_a.created_at"), F.col("a")), F.lit(False))
    rows = rows.withColumns({"_newer": F.when(b_newer, F.col("b")).otherwise(F.col("a")), "_new": F.when(b_newer, F.col("_b")).otherwise(F.col("_a")), "_old": F.when(b_newer, F.col("_a")).otherwise(F.col("_b"))})
    keep = F.when(F.col("verdict") == "supersede", F.coalesce("keep", "_newer")).when((F.col("verdict") == "delete") & ~pair, F.coalesce("keep", "a")).otherwise(F.col("keep"))
    rows = rows.withColumn("_keep", keep).withColumn("_gone", F.when(F.col("_keep") == F.col("a"), F.col("b")).otherwise(F.col("a")))
    verdict = F.col("verdict")
    retires = verdict.isin("supersede", "merge")
    start = F.when(F.col("_new.occurred_at") <= F.lit(now) - F.make_dt_interval(days=F.lit(1)), F.col("_new.occurred_at"))
    from_, to = F.when(F.col("_keep") == F.col("_newer"), F.col("_old.occurred_at")).otherwise(F.col("_new.occurred_at")), F.when(F.col("_keep") == F.col("_newer"), F.col("_new.occurred_at")).otherwise(F.col("_old.occurred_at"))
    reason = (
        F.when(~F.coalesce(_fits("source", "verdict"), F.lit(False)), "verdict")
        .when((verdict == "delete") & F.lit(not may_delete), "not_allowed")
        .when(F.col("_a").isNull() | (pair & F.col("_b").isNull()) | (pair & (F.col("a") == F.col("b"))), "missing")
        .when(verdict.isin("supersede", "delete") & ~F.coalesce(F.col("_keep").isin(F.col("a")) | (F.col("_keep") == F.col("b")), F.lit(False)), "not_of_item")
        .when((verdict == "merge") & (F.coalesce(F.trim("content"), F.lit("")) == ""), "content")
        .when((verdict == "merge") & pair & (F.col("_a.namespace") != F.col("_b.namespace")), "namespaces")
        .when(retires & (F.col("_a.superseded_by").isNotNull() | F.coalesce(F.col("_b.superseded_by").isNotNull(), F.lit(False))), "already_superseded")
        .when(retires & (F.col("_a.expired") | F.coalesce(F.col("_b.expired"), F.lit(False))), "expired")
        .when((verdict == "supersede") & inverted(from_, to), "inversion")
        .when((verdict == "merge") & pair & inverted(F.col("_old.occurred_at"), start), "inversion")
    )
    judged = rows.withColumn("reason", reason).withColumn("_start", start)
    touched = judged.filter("reason is null").select("key", F.explode(F.array_compact(F.array("a", "b"))).alias("id"))
    clash = _first_claim(touched, "key", "id").withColumn("_clash", F.lit(True))
    raised = sensitivity_rank(F.col("_b.sensitivity")) > sensitivity_rank(F.col("_a.sensitivity"))
    level = F.when(F.col("_b").isNotNull() & raised, F.col("_b.sensitivity")).otherwise(F.col("_a.sensitivity"))
    final = judged.join(clash, "key", "left").withColumn("reason", F.when(F.col("reason").isNull() & F.col("_clash"), "claimed").otherwise(F.col("reason")))
    final = final.withColumns({"_ns": F.col("_a.namespace"), "_level": level, "_made": F.when(verdict == "merge", mutations.fact_id(F.col("_a.namespace"), F.trim("content"), F.lit(now)))})
    final = written(final.select("key", "source", "verdict", "a", "b", "content", "_keep", "_gone", "_start", "_ns", "_level", "_made", "reason"), "items-judged")
    done = final.filter("reason is null")
    new = done.filter("verdict = 'merge'").groupBy(F.col("_made").alias("id")).agg(F.min(F.trim("content")).alias("content"), F.min("_ns").alias("namespace"), F.max_by("_level", sensitivity_rank(F.col("_level"))).alias("sensitivity"), F.min("_start").alias("occurred_at")).withColumns({"created_at": F.lit(now), "access_count": F.lit(0).cast("long")})
    after = mutations.insert(memory, new.select(*[c for c in memory.columns if c in new.columns]))
    merged = done.filter("verdict = 'merge'").select(F.explode(F.array_compact(F.array("a", "b"))).alias("old"), F.col("_made").alias("new"))
    links = done.filter("verdict = 'supersede'").select(F.col("_gone").alias("old"), F.col("_keep").alias("new")).unionByName(merged)
    after, _ = mutations.supersede(written(after, "items-merged"), links, now)
    after = mutations.confirm(after, done.filter("verdict = 'confirm'").select(F.col("a").alias("id")), now)
    after = mutations.delete(written(after, "items-linked"), done.filter("verdict = 'delete'").select(F.col("_keep").alias("id")))
    kept = mutations.dismiss(ledger, done.filter("verdict = 'keep_both'").select("a", "b"), "owner", now)
    return after, kept, final.select("key", "verdict", "reason", F.col("_made").alias("written_id"))
