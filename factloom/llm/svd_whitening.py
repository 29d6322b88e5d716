"""Embedding whitening by hierarchical singular value decompositions.

Each partition of the distinct vectors keeps a summary: how many there are,
their exact sums, and all singular values times the right singular vectors of
the centred block. Two summaries merge without loss: one under the other, with
one row more that corrects for the difference of their means, and a new
decomposition of the stack. A tree of merges leads to one summary, whose
singular values and vectors are those of the whole centred matrix; its
covariance is never formed.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop_written, written

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
#: Summaries merged by one task of the tree.
FAN_IN = 16
#: Entries of a block that is decomposed at once.
BLOCK = 1 << 20
SUMMARY = "node long, n long, sums array<bigint>, factor array<double>"
RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Summary:
    n: int
    sums: np.ndarray  # exact
    factor: np.ndarray  # singular values times right singular vectors, by row

    @property
    def centre(self) -> np.ndarray:
        """The mean less ``OFFSET``, without cancellation."""
        return (self.sums - self.n * OFFSET) / self.n


def decompose(stack: np.ndarray) -> np.ndarray:
    _, s, vt = np.linalg.svd(stack, full_matrices=False)
    return s[:, None] * vt


def summary_of(x: np.ndarray) -> Summary:
    """x: integers, a vector a row, at least one."""
    sums = x.sum(axis=0)
    return Summary(len(x), sums, decompose((x - OFFSET) - (sums - len(x) * OFFSET) / len(x)))


def merge(a: Summary, b: Summary) -> Summary:
    n = a.n + b.n
    correction = math.sqrt(a.n / n * b.n) * (a.centre - b.centre)
    return Summary(n, a.sums + b.sums, decompose(np.vstack([a.factor, b.factor, correction])))


def merged(parts: Iterable[Summary]) -> Summary | None:
    total = None
    for part in parts:
        total = part if total is None else merge(total, part)
    return total


def quantised(batch: pa.RecordBatch, width: int | None = None) -> tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray]]]:
    """Of a batch (id, vector): the rows that remain, and (places, integers)
    of each width among them. Vectors that are null or empty or hold an entry
    that is null or not finite go, and those of other than the given width."""
    vectors = batch.column(1)
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    flat = vectors.flatten()
    good = np.isfinite(pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False))
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~good)])
    keep = (lengths > 0) & (bad[ends] == bad[ends - lengths])
    if width is not None:
        keep &= lengths == width
    batch, lengths = batch.filter(pa.array(keep)), lengths[keep]
    values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x, starts = np.floor(SCALE * values).astype(np.int64) + OFFSET, np.cumsum(lengths) - lengths
    out = []
    for w in np.unique(lengths):
        at = np.flatnonzero(lengths == w)
        out.append((at, x[starts[at][:, None] + np.arange(w)]))
    return batch, out


def fit_list(rows: DataFrame, vector: str) -> DataFrame:
    """(x), each distinct vector of integers once, written; of vectors of
    unlike widths those of the width that most distinct ones have."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in quantised(batch)[1]:
                yield pa.RecordBatch.from_arrays([_lists(x)], ["x"])

    every = rows.select(F.lit(0).alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "x array<bigint>")
    distinct = written(every.distinct(), "whitening-fit")
    widths = distinct.groupBy(F.size("x").alias("width")).count().orderBy(F.col("count").desc(), F.col("width").desc()).head(2)
    return distinct.filter(F.size("x") == widths[0].width) if len(widths) > 1 else distinct


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _row(node: int, s: Summary) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"node": [node], "n": [s.n], "sums": [s.sums], "factor": [s.factor.ravel()]}, pa.schema([("node", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("factor", pa.list_(pa.float64()))]))


def _summaries(table: pa.Table) -> list[Summary]:
    table = table.sort_by("node")
    return [Summary(r["n"], np.array(r["sums"], np.int64), np.array(r["factor"]).reshape(-1, len(r["sums"]))) for r in table.to_pylist()]


def fit(distinct: DataFrame) -> Summary | None:
    """The summary of all vectors, None without any. The driver sees this one:
    as many numbers as the width squared."""

    def leaves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch.column(0)) if batch.num_rows else np.zeros((0, 1), np.int64)
            step = max(1, BLOCK // max(1, x.shape[1]))
            total = merged(filter(None, [total, *(summary_of(x[i : i + step]) for i in range(0, len(x), step))]))
        if total is not None:
            yield _row(TaskContext.get().partitionId(), total)

    def branch(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_row(group["node"][0].as_py() // FAN_IN, merged(_summaries(group)))])

    level = written(distinct.mapInArrow(leaves, SUMMARY), "whitening-summaries")
    last = level.agg(F.max("node")).first()[0]
    if last is None:
        return None
    while last:
        level = level.groupBy(F.expr(f"node div {FAN_IN}").alias("up")).applyInArrow(branch, SUMMARY)
        last //= FAN_IN
    return _summaries(level.toArrow())[0]


@dataclass
class Whitening:
    summary: Summary
    vectors: np.ndarray  # a component a column, over its standard deviation
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        s = self.summary
        return ((s.n * (x - OFFSET) - (s.sums - s.n * OFFSET)) / s.n) @ self.vectors


def whitening(s: Summary, components: int = COMPONENTS) -> Whitening:
    """Components of eigenvalue zero, in double precision, are none."""
    _, values, vt = np.linalg.svd(s.factor, full_matrices=False)
    rank = int((values > values[0] * max(s.n, len(s.sums)) * np.finfo(float).eps).sum()) if values[0] > 0 else 0
    k = min(components, rank)
    vt = vt[:k] * np.sign(vt[np.arange(k), np.abs(vt[:k]).argmax(axis=1)])[:, None]
    return Whitening(s, (vt / (values[:k, None] / math.sqrt(s.n))).T, values[:k] ** 2 / max((values**2).sum(), np.finfo(float).tiny))


def identity_error(distinct: DataFrame, w: Whitening) -> float:
    """The largest entry of |covariance of the whitened fit list - identity|."""
    k = len(w.explained)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            if batch.num_rows:
                z = w.project(_matrix(batch.column(0)))
                total += np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])
        yield pa.RecordBatch.from_pydict({"sums": [total]})

    parts = distinct.mapInArrow(run, "sums array<double>").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("total"))
    total = np.array([r.total for r in parts.orderBy("pos").collect()]) / w.summary.n
    return float(np.abs(total[k:].reshape(k, k) - np.outer(total[:k], total[:k]) - np.eye(k)).max(initial=0)) if k and len(total) else 0.0


def deviations(x: np.ndarray, s: Summary) -> np.ndarray:
    """The exact sum over dimensions of (n x - S)^2 of each row; one beyond 64
    bits is an error."""
    apart = s.n * (x - OFFSET) - (s.sums - s.n * OFFSET)
    if len(apart) and (apart.astype(float) ** 2).sum(axis=1).max() >= 2.0**63:
        raise OverflowError("a deviation does not fit in 64 bits")
    return (apart * apart).sum(axis=1)


def whiten(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row
    for each remaining row and each component.

    Dropped are vectors that are null, empty, or hold a null, NaN or infinite
    entry, and, where widths differ, those not of the width that most distinct
    vectors have (the larger at a tie). Repeated vectors count once in the fit
    and are rows of their own in the result, as are repeated and null ids.
    Components without variance don't exist: where all vectors are equal, or
    none is left, there are no rows. Of equal eigenvalues the vectors are any
    basis, the same for all rows. Other columns are ignored.
    """
    spark = rows.sparkSession
    distinct = fit_list(rows, vector)
    s = fit(distinct)
    kind = rows.select(id_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {RESULT}"
    if s is None:
        return spark.createDataFrame([], schema)
    w = whitening(s, components)
    k, error = len(w.explained), identity_error(distinct, w)
    drop_written(spark, distinct)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, parts = quantised(batch, len(s.sums))
            for at, x in parts if k else []:
                many = lambda a: pa.array(np.repeat(a, k))
                columns = [kept.column(0).take(many(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), many(np.full(len(at), s.n)), many(deviations(x, s))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(w.project(x).ravel()), pa.array(np.tile(w.explained, len(at))), many(np.full(len(at), error))], [id_col, *(c.split()[0] for c in RESULT.split(", "))])

    return rows.select(id_col, F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, schema)
