"""Mixing sources to target weights by entropy balancing.

The mix gives each document a rate, the expected number of its copies. Among
all rates whose tokens meet the sources' targets and that stay within the copy
limit, the rates nearest in relative entropy to the base rate are wanted, each
document counting alike. Its convex dual has one multiplier per source, the
rates are exponentially tilted by it, ``min(limit, base * exp(lambda * size))``,
and the multipliers are found by Newton's method on the logarithm of the
tokens, kept inside a bracket. An iteration is one distributed aggregation of
tokens and slopes by source; the multipliers live in a table, one row a
source, and only the number of unsolved sources comes to the driver. As a rate
hangs on source and size alone, the sums are made over the counts of each
(source, size).

Rates become whole copies by carrying the rounding error on: the documents of
a source are dealt to cells by a hash, a cell takes its documents from the
longest to the shortest, and each gets the copies (its rate rounded down or
up) that bring the tokens taken so far nearest to the tokens due so far. What
is left over at a cell's end is less than one of its shortest documents.

Equal rows (id, source, text) are counted before anything is dealt and then
numbered, so that a row of any number of copies is spread over the cells, and
which way a row is rounded depends on its content and number only: reruns
agree, however the rows are partitioned. Sums are made in decimals, whose
order of adding does not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ._shared import WORD, anchored, drop_written, fresh, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
LIMIT = 2.0
#: Documents in a cell, about; a cell is one sort in one task.
CELL = 2000
ITERATIONS = 200
TOLERANCE = 1e-10
#: Copies of one row that are numbered at once.
RUN = 1 << 16
EXACT = "decimal(38,15)"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """A text that is equal for equal sources only and sorts as they do by code
    point, null last."""
    return F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source.cast("string")))


def numbered(sources: DataFrame) -> DataFrame:
    """sources with ``place``, 0 upwards in the order of ``key``. Each partition
    of a range sort numbers its own; only the partitions' counts meet."""
    spark = sources.sparkSession
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranged = written(sources.repartitionByRange("key").sortWithinPartitions("key").select("*", F.spark_partition_id().alias("part"), inside.alias("inside")), "mix-order")
    before, offsets = 0, []
    for part, n in sorted(map(tuple, ranged.groupBy("part").count().collect())):  # at most spark.sql.shuffle.partitions rows
        offsets.append((part, before))
        before += n
    parts, sums = zip(*offsets, strict=True) if offsets else ((), ())
    table = spark.createDataFrame(pa.table({"part": pa.array(parts, pa.int32()), "before": pa.array(sums, pa.int64())}))
    return ranged.join(F.broadcast(table), "part").select(*sources.columns, (F.col("before") + F.col("inside")).alias("place"))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(key, size, …) -> also (place, weight, full, goal). The wanted sum is
    shared by weight; what a source's limit cuts off is shared anew among the
    others by weight, until none is above. The level (tokens for a weight of 1)
    only rises, and each step is one aggregation."""
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % len(weights) + 1).cast("int"))
    table = written(numbered(sources).withColumn("weight", weight), "mix-sources")
    level, n_full = 0.0, -1
    full = F.lit(False)
    while True:
        full = (F.col("size") <= 0) | (F.lit(level) * F.col("weight") > F.lit(limit) * F.col("size"))
        sums = table.agg(
            F.sum(F.col("size").cast(EXACT)).alias("total"),
            F.sum(F.when(full, F.col("size")).otherwise(0).cast(EXACT)).alias("cut"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight")).cast(EXACT)).alias("open"),
            F.sum(full.cast("long")).alias("n"),
        ).first()
        if not sums.open or sums.n == n_full:
            return table.withColumns({"full": full, "goal": F.when(full, F.lit(limit) * F.col("size")).otherwise(F.lit(level) * F.col("weight"))})
        n_full = sums.n
        level = (share * float(sums.total) - limit * float(sums.cut)) / float(sums.open)


def _tilted(base: float, limit: float) -> Column:
    """The rate of a size under a source's multiplier ``m``, in units of ``scale`` tokens."""
    return F.lit(base) * F.exp(F.least(F.col("m") * F.col("size") / F.col("scale"), F.lit(math.log(limit / base))))


def newton(sizes: DataFrame, sources: DataFrame, base: float, limit: float) -> DataFrame:
    """(key, size, n), (key, goal, scale, full, …) -> sources with the multiplier ``m``.

    A source whose goal is all that its limit allows has no finite multiplier;
    its rates are the limit.
    """
    low, high = -1e300, 1e300

    def kept(state: DataFrame) -> tuple[DataFrame, int]:
        """The state, written, and its number of unsolved sources."""
        seen = Observation()
        table = written(state.observe(seen, F.count_if("open").alias("n")), "mix-state")
        return table, seen.get["n"]

    state, unsolved = kept(sources.select("*", F.lit(0.0).alias("m"), F.lit(low).alias("low"), F.lit(high).alias("high"), (~F.col("full") & (F.col("goal") < F.lit(limit * (1 - 1e-12)) * F.col("size"))).alias("open")))
    for _ in range(ITERATIONS):
        if not unsolved:
            break
        rate, free = _tilted(base, limit), F.col("m") * F.col("size") / F.col("scale") < math.log(limit / base)
        tokens = F.col("n") * F.col("size") * rate
        slope = F.when(free, tokens * F.col("size") / F.col("scale")).otherwise(0.0)
        sums = sizes.join(state.filter("open").select("key", "m", "scale"), "key").groupBy("key").agg(F.sum(tokens.cast(EXACT)).cast("double").alias("tokens"), F.sum(slope.cast(EXACT)).cast("double").alias("slope"))
        gap = F.log("tokens") - F.log("goal")
        lower, upper = F.when(gap < 0, F.col("m")).otherwise(F.col("low")), F.when(gap < 0, F.col("high")).otherwise(F.col("m"))
        reach = F.greatest(F.lit(2.0), F.abs("m"))
        step = F.when(F.col("slope") > 0, F.greatest(-reach, F.least(reach, gap * F.col("tokens") / F.col("slope")))).otherwise(F.when(gap < 0, -reach).otherwise(reach))
        there = F.coalesce(F.abs(gap) < TOLERANCE, F.lit(False))
        met = state.join(sums, "key", "left").select(*sources.columns, "open", "m", lower.alias("low"), upper.alias("high"), step.alias("step"), there.alias("there"))
        aim = F.col("m") - F.col("step")
        inside = (aim > F.col("low")) & (aim < F.col("high"))
        middle = (F.col("low") + F.col("high")) / 2
        moved = F.when(~F.col("open") | F.col("there"), F.col("m")).when(inside, aim).otherwise(middle)
        still = F.col("open") & ~F.col("there") & (moved != F.col("m"))  # a bracket of neighbouring numbers can't be halved
        before = state
        state, unsolved = kept(met.select(*sources.columns, moved.alias("m"), "low", "high", still.alias("open")))
        drop_written(before.sparkSession, before)
    return state.select(*sources.columns, "m")


def plan(rows: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """(key, size) -> (key, size, n, place, weight, full, goal, scale, m), one row a source."""
    sizes = written(rows.groupBy("key", "size").agg(F.count("*").alias("n")), "mix-histogram")
    total = written(sizes.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("size"), F.sum("n").alias("n")), "mix-totals")
    scaled = targets(total, weights, share, limit).withColumn("scale", F.greatest(F.col("size") / F.col("n"), F.lit(1e-9)))
    return newton(sizes.filter("size > 0"), scaled, share, limit)


def narrow(docs: DataFrame, source_col: str = "source", *more: Column) -> DataFrame:
    """(doc_id, key, size, h, more): h is a hash of the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(F.col(source_col)).alias("key"), words_in(F.col("text")).alias("size"), F.xxhash64("text").alias("h"), *more)


def dealt(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(doc_id, key, size, h) -> also (nth, source_size, target, rate, cell,
    phase), one row per row; nth numbers equal rows from 1."""
    sources = plan(rows, weights, share, limit).select("key", F.col("size").alias("source_size"), F.col("goal").alias("target"), "full", "scale", "m", F.greatest(F.lit(1), F.ceil(F.col("n") / CELL)).alias("cells"))
    equal = rows.groupBy("doc_id", "key", "size", "h").agg(F.count("*").alias("times"))
    # In two steps, so that no array is longer than a run.
    runs = equal.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / RUN))).alias("run"))
    first = F.col("run") * RUN + 1
    each = runs.select("doc_id", "key", "size", "h", F.explode(F.sequence(first, F.least(first + RUN - 1, F.col("times")))).alias("nth"))
    rate = F.when(F.col("size") <= 0, 0.0).when(F.col("full"), F.lit(float(limit))).otherwise(_tilted(share, limit))
    cell = F.pmod(F.xxhash64("doc_id", "h", "nth"), F.col("cells"))
    phase = F.pmod(F.xxhash64("doc_id", "h", "nth", F.lit(9)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return each.join(sources, "key").select("doc_id", "key", "size", "h", "nth", "source_size", "target", rate.alias("rate"), cell.alias("cell"), phase.alias("phase"))


def _copies(cell: pa.Table) -> pa.Table:
    ties = [("size", "descending"), ("phase", "descending"), ("doc_id", "ascending"), ("h", "ascending"), ("nth", "ascending")]
    cell = cell.sort_by(ties)
    due = 0.0
    copies = []
    phases = cell["phase"].to_pylist() if len(cell) >= 16 else [0.5] * len(cell)
    for size, rate, phase in zip(cell["size"].to_pylist(), cell["rate"].to_pylist(), phases, strict=True):
        due += rate * size
        low = math.floor(rate + 1e-9)
        n = min(max(math.floor(due / size + phase), low), math.ceil(rate - 1e-9)) if size else 0
        copies.append(n)
        due -= n * size
    return cell.drop_columns(["cell", "phase"]).append_column("copies", pa.array(np.array(copies, np.int64)))


def rounded(rated: DataFrame) -> DataFrame:
    """What ``dealt`` gives -> (doc_id, key, size, h, nth, source_size, target, rate, copies, taken)."""
    done = rated.groupBy("key", "cell").applyInArrow(_copies, "doc_id long, key string, size long, h long, nth long, source_size long, target double, rate double, copies long")
    return done.withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(doc_id, size, source_size, target, rate, copies, taken), one row per
    input row.

    A null text has size 0, is never taken and counts in no target; a text of
    any length is counted whole; a null source is a source, the last; a null
    id is dealt like any other; repeated rows are documents of their own; an
    empty table gives no rows; other columns are ignored.
    """
    rows = written(narrow(docs, source_col), "mix-sizes")
    return rounded(dealt(rows, weights, share, limit)).select("doc_id", "size", "source_size", "target", "rate", "copies", "taken")


def taken(docs: DataFrame, source_col: str = "source") -> tuple[DataFrame, list[str]]:
    """The rows of docs that the mix takes, with all their columns and four
    more, whose names follow: size, target, copies and taken. Rows equal in id,
    source and text have copies of their own each."""
    names = fresh(docs, "size", "target", "copies", "taken")
    own, file, place = anchored(docs, "mix-documents")
    rows = written(narrow(own, source_col, F.col(file).alias("file"), F.col(place).alias("place")), "mix-sizes")
    same = ["doc_id", "key", "size", "h"]
    nth = F.row_number().over(Window.partitionBy(*same).orderBy("file", "place")).cast("long")
    mixed = rounded(dealt(rows)).filter("copies > 0").select(*[F.col(c).alias(f"m_{c}") for c in (*same, "nth")], *[F.col(c).alias(f"chosen_{k}") for k, c in enumerate(("size", "target", "copies", "taken"))])
    match = [F.col(c).eqNullSafe(F.col(f"m_{c}")) if c == "doc_id" else F.col(c) == F.col(f"m_{c}") for c in (*same, "nth")]
    chosen_file, chosen_place, *chosen_names = fresh(own, "chosen_file", "chosen_place", *names)
    chosen = rows.select(*same, "file", "place", nth.alias("nth")).join(mixed, match).select("file", "place", *[f"chosen_{k}" for k in range(len(names))])
    chosen = written(chosen.toDF(chosen_file, chosen_place, *chosen_names), "mix-chosen")
    # The list grows with the corpus, so it is never a broadcast.
    met = own.join(chosen.hint("merge"), (F.col(file) == F.col(chosen_file)) & (F.col(place) == F.col(chosen_place)))
    return met.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(c).alias(n) for c, n in zip(chosen_names, names, strict=True)]), names


def op9(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
