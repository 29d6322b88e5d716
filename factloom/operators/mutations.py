"""State changes as functions from tables to tables: (state, change) -> state.

Parquet has no updates in place; a change is one join and one rewrite, and
many changes of one kind are one batch. What can't be done is returned, with
the reason, beside the new state.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import credentials, guards
from ..functions.predicates import expired, live
from ..functions.staging import written
from ..functions.text import content_digest, duplicate_key, inverted, normal_tags, supersession_end
from .chains import heads

COLLAPSE_AT, REPORT_AT = 0.97, 0.90


def fact_id(namespace: str | Column, content: str | Column, created_at: str | Column) -> Column:
    """An id that is the same when a batch is written again."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    h = F.sha2(F.concat_ws("\x1f", c(namespace), content_digest(content), c(created_at).cast("string")), 256)
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def insert(memory: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose id is not there yet."""
    return memory.unionByName(rows.join(memory.select("id"), "id", "left_anti"), allowMissingColumns=True)


def supersede(memory: DataFrame, links: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """links (old, new) -> (memory, refused). Refused: a fact by itself, one
    that is missing, replaced already, or expired; a successor that became
    true before it; and what would close a cycle. Of several successors of one
    fact the smallest is taken. An end that was known stays."""
    own = links.filter("old = new").select("old", "new", F.lit("self").alias("reason"))
    one = links.filter("old <> new").groupBy("old").agg(F.min("new").alias("new"))
    again = links.filter("old <> new").join(one, ["old", "new"], "left_anti").select("old", "new", F.lit("second_successor").alias("reason")).unionByName(own)
    o = memory.select(F.col("id").alias("old"), F.col("superseded_by").alias("_by"), F.col("occurred_at").alias("_start"), expired(now).alias("_expired"))
    n = memory.select(F.col("id").alias("new"), F.col("occurred_at").alias("_n_start"), F.col("created_at").alias("_n_made"))
    far = heads(memory).select(F.col("id").alias("new"), F.col("head").alias("_head"))
    checked = one.join(o, "old", "left").join(n, "new", "left").join(far, "new", "left")
    reason = (
        F.when(F.col("_expired").isNull() | F.col("_n_made").isNull(), "missing")
        .when(F.col("_by").isNotNull(), "already_superseded")
        .when(F.col("_expired"), "expired")
        .when(F.col("_head") == F.col("old"), "cycle")
        .when(inverted(F.col("_start"), F.col("_n_start")), "inversion")
    )
    judged = checked.withColumn("reason", reason)
    good = judged.filter("reason is null").select(F.col("old").alias("id"), F.col("new").alias("_new"), supersession_end(F.col("_start"), F.col("_n_start"), F.col("_n_made")).alias("_until"))
    rows = memory.join(good, "id", "left")
    hit = F.col("_new").isNotNull()
    after = rows.withColumns({"superseded_by": F.coalesce("superseded_by", "_new"), "superseded_at": F.when(hit, F.lit(now)).otherwise(F.col("superseded_at")), "occurred_until": F.when(hit, F.coalesce("occurred_until", "_until")).otherwise(F.col("occurred_until"))})
    back = good.groupBy(F.col("_new").alias("id")).agg(F.min(F.col("id")).alias("_old"))
    linked = after.drop("_new", "_until").join(back, "id", "left").withColumn("supersedes", F.coalesce("supersedes", "_old"))
    return linked.select(*memory.columns), judged.filter("reason is not null").select("old", "new", "reason").unionByName(again)


def expire(memory: DataFrame, ids: DataFrame, now: datetime) -> DataFrame:
    """Ends facts that have neither a successor nor an end."""
    rows = memory.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    hit = F.col("_hit") & F.col("superseded_by").isNull() & F.col("occurred_until").isNull()
    return rows.withColumn("occurred_until", F.when(hit, F.lit(now)).otherwise(F.col("occurred_until"))).select(*memory.columns)


def unexpire(memory: DataFrame, closed: DataFrame) -> DataFrame:
    """closed (id, occurred_until): reopens a fact only if that is still the end."""
    rows = memory.join(closed.select("id", F.col("occurred_until").alias("_end")).distinct(), "id", "left")
    hit = F.col("superseded_by").isNull() & (F.col("occurred_until") == F.col("_end"))
    return rows.withColumn("occurred_until", F.when(hit, None).otherwise(F.col("occurred_until"))).select(*memory.columns)


def delete(memory: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the facts. The neighbours of a deleted one are joined to each
    other, over runs of deleted ones too; what only deleted ones replaced holds
    again (its link, stamp and the end that the link wrote are cleared)."""
    gone = ids.select("id").distinct()
    kept = memory.join(gone, "id", "left_anti")
    # From a deleted fact to the next that stays: hops are doubled, for runs of up to 64.
    step = written(memory.join(gone, "id", "left_semi").select(F.col("id").alias("g"), F.col("superseded_by").alias("to")), "splice")
    for _ in range(6):
        onward = step.select(F.col("g").alias("to"), F.col("to").alias("far"), F.lit(True).alias("more"))
        next_ = written(step.join(onward, "to", "left").select("g", F.when(F.col("more"), F.col("far")).otherwise(F.col("to")).alias("to")), "splice")
        if next_.exceptAll(step).isEmpty():
            break
        step = next_
    alive = memory.select(F.col("id").alias("to")).join(gone.withColumnRenamed("id", "to"), "to", "left_anti")
    over = step.join(alive.withColumn("_alive", F.lit(True)), "to", "left").select(F.col("g").alias("superseded_by"), F.when(F.col("_alive"), F.col("to")).alias("_to"), F.lit(True).alias("_cut"))
    rows = kept.join(over, "superseded_by", "left")
    cut, free = F.coalesce("_cut", F.lit(False)), F.coalesce("_cut", F.lit(False)) & F.col("_to").isNull()
    clear = {c: F.when(free, None).otherwise(F.col(c)) for c in ("superseded_at", "occurred_until")}
    linked = rows.withColumns({**clear, "superseded_by": F.when(cut, F.col("_to")).otherwise(F.col("superseded_by"))}).select(*memory.columns)
    mirror = linked.filter("superseded_by is not null").groupBy(F.col("superseded_by").alias("id")).agg(F.min("id").alias("_old"))
    broken = linked.join(gone.select(F.col("id").alias("supersedes"), F.lit(True).alias("_lost")), "supersedes", "left").join(mirror, "id", "left")
    return broken.withColumn("supersedes", F.when(F.col("_lost"), F.col("_old")).otherwise(F.col("supersedes"))).select(*memory.columns)


def confirm(memory: DataFrame, ids: DataFrame, now: datetime) -> DataFrame:
    rows = memory.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return rows.withColumn("last_confirmed_at", F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("last_confirmed_at"))).select(*memory.columns)


def touch(memory: DataFrame, hits: DataFrame, now: datetime) -> DataFrame:
    """One more access for each hit; a fact hit often is counted before the join."""
    counted = hits.groupBy("id").agg(F.count("*").alias("_n"))
    rows = memory.join(counted, "id", "left")
    return rows.withColumns({"access_count": F.col("access_count") + F.coalesce("_n", F.lit(0)), "last_accessed_at": F.when(F.col("_n").isNotNull(), F.lit(now)).otherwise(F.col("last_accessed_at"))}).select(*memory.columns)


def fill_start(memory: DataFrame, dates: DataFrame) -> DataFrame:
    """dates (id, occurred_at) for facts that have none."""
    rows = memory.join(dates.groupBy("id").agg(F.min("occurred_at").alias("_at")), "id", "left")
    return rows.withColumn("occurred_at", F.coalesce("occurred_at", "_at")).select(*memory.columns)


def backfill_start(memory: DataFrame, observations: DataFrame) -> DataFrame:
    """The earliest observation (memory_id, observed_at) as the start of facts without one."""
    return fill_start(memory, observations.select(F.col("memory_id").alias("id"), F.col("observed_at").alias("occurred_at")))


def dismiss(ledger: DataFrame, pairs: DataFrame, by: str, now: datetime) -> DataFrame:
    """pairs (a, b) in any order; one row for a pair, the first one."""
    new = pairs.select(F.least("a", "b").alias("lo_id"), F.greatest("a", "b").alias("hi_id")).filter("lo_id <> hi_id").distinct()
    fresh = new.join(ledger.select("lo_id", "hi_id"), ["lo_id", "hi_id"], "left_anti").withColumns({"dismissed_by": F.lit(by), "dismissed_at": F.lit(now)})
    return ledger.unionByName(fresh, allowMissingColumns=True)


def undismiss(ledger: DataFrame, pairs: DataFrame) -> DataFrame:
    return ledger.join(pairs.select(F.least("a", "b").alias("lo_id"), F.greatest("a", "b").alias("hi_id")), ["lo_id", "hi_id"], "left_anti")


def cascade(table: DataFrame, column: str, memory: DataFrame) -> DataFrame:
    """Rows whose fact is gone go too."""
    return table.join(memory.select(F.col("id").alias(column)), column, "left_semi").select(*table.columns)


def release(table: DataFrame, column: str, memory: DataFrame) -> DataFrame:
    """Links to facts that are gone become null."""
    here = memory.select(F.col("id").alias(column), F.lit(True).alias("_here"))
    return table.join(here, column, "left").withColumn(column, F.when(F.col("_here"), F.col(column))).select(*table.columns)


def write(memory: DataFrame, facts: DataFrame, now: datetime, *, default_level: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """facts (content, namespace, tags, sensitivity, occurred_at, source_client)
    -> (memory, outcomes). A batch is taken in the order of (created_at, id):
    a fact with the text of a live one, or of one earlier in the batch, in its
    namespace confirms that one; refused are bad namespaces, empty texts,
    credentials at the open level, and starts less than a day old that the
    text does not state."""
    ns = guards.namespace("namespace")
    level = F.coalesce(F.col("sensitivity"), default_level if default_level is not None else F.lit("open"))
    stated = F.array_contains(guards.stated_dates("content"), F.to_date("occurred_at"))
    early = F.col("occurred_at").isNull() | (F.col("occurred_at") <= F.lit(now) - F.make_dt_interval(days=F.lit(1))) | stated
    rows = facts.withColumns({"content": F.trim("content"), "sensitivity": level, "tags": normal_tags("tags"), "created_at": F.lit(now)})
    reason = F.when(F.coalesce(F.col("content"), F.lit("")) == "", "empty").when(ns.isNull() | ~guards.writable(ns), "namespace").when((level == "open") & credentials.finding("content").isNotNull(), "credential").when(~F.coalesce(early, F.lit(False)), "date")
    judged = rows.withColumn("reason", reason).withColumn("namespace", F.coalesce(ns, F.col("namespace")))
    keyed = judged.withColumns({"_key": F.sha2(duplicate_key("namespace", "content"), 256), "id": fact_id("namespace", "content", "created_at")})
    known = memory.filter(live(now) & F.col("content").isNotNull()).select(F.sha2(duplicate_key("namespace", "content"), 256).alias("_key"), F.col("id").alias("_known")).groupBy("_key").agg(F.min("_known").alias("_known"))
    nth = F.row_number().over(W.partitionBy("_key", F.col("reason").isNull()).orderBy("occurred_at", "id"))
    both = keyed.withColumn("_nth", nth).join(known, "_key", "left")
    outcome = F.when(F.col("reason").isNotNull(), F.concat(F.lit("refused_"), "reason")).when(F.col("_known").isNotNull() | (F.col("_nth") > 1), "confirmed").otherwise("written")
    done = both.withColumn("outcome", outcome)
    new = done.filter("outcome = 'written'").withColumn("access_count", F.lit(0).cast("long"))
    after = insert(memory, new.select(*[c for c in memory.columns if c in new.columns]))
    again = done.filter("outcome = 'confirmed'").select(F.coalesce(F.col("_known").cast("string"), F.col("id")).alias("id"))
    return confirm(after, again, now), done.select("id", "namespace", "content", "outcome", F.col("_known").alias("same_as"))


def collapse(new: DataFrame, pairs: DataFrame, at: float = COLLAPSE_AT, report: float = REPORT_AT) -> DataFrame:
    """pairs (a: new id, b: stored id, similarity, a_content, b_content) ->
    what becomes of each new fact: collapsed into its nearest, or written with
    possible conflicts. Near in meaning is not the same if digits, identifiers
    or negations differ."""
    why = guards.collapse_blocks("a_content", "b_content")
    near = pairs.filter(F.col("similarity") >= report).withColumn("block", why)
    into = F.max_by(F.when((F.col("similarity") >= at) & F.col("block").isNull(), F.col("b")), F.when((F.col("similarity") >= at) & F.col("block").isNull(), F.struct("similarity", "b")))
    return new.select("id").join(near.groupBy(F.col("a").alias("id")).agg(into.alias("into"), F.array_sort(F.collect_set("b")).alias("possible_conflicts")), "id", "left").withColumn("outcome", F.when(F.col("into").isNotNull(), "collapsed").otherwise("written"))


def merge_archive(memory: DataFrame, archive: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memory, id_map): facts of an archive under new ids where theirs are
    taken by other facts; links follow the new ids, and links out of the
    archive are cleared."""
    taken = memory.select("id", F.sha2(duplicate_key("namespace", "content"), 256).alias("_have"))
    keyed = archive.withColumn("_key", F.sha2(duplicate_key("namespace", "content"), 256))
    meets = keyed.join(taken, "id", "left")
    same = F.col("_have").eqNullSafe(F.col("_key"))
    fresh = F.when(F.col("_have").isNull() | same, F.col("id")).otherwise(fact_id("namespace", "content", "created_at"))
    mapped = meets.select(F.col("id").alias("old_id"), fresh.alias("new_id"), (F.col("_have").isNotNull() & same).alias("present"))
    rows = archive.join(mapped.withColumnRenamed("old_id", "id"), "id").filter(~F.col("present"))
    for c in ("supersedes", "superseded_by"):
        rows = rows.join(mapped.select(F.col("old_id").alias(c), F.col("new_id").alias(f"_{c}")), c, "left").withColumn(c, F.col(f"_{c}")).drop(f"_{c}")
    return memory.unionByName(rows.withColumn("id", F.col("new_id")).drop("new_id", "present"), allowMissingColumns=True), mapped
