"""Cells of vectors around centres, and how near to a probe a cell's vectors can be.

A vector is at home with the centre of the largest product. Two bounds hold for
the cosine of a probe with all that are at home with a centre:

* they lie on that centre's side of the plane between it and any other one: a
  probe that is a beyond the plane has a cosine of at most sqrt(1 - a * a);
* they are at most as far from the centre as the furthest of them, by angle.

Centres are found in a bounded sample; they decide how much is left out, never
what is found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from .staging import written

#: Rows for each cell, up to the most cells; rows that centres are found in, and rounds of it.
PER_CELL, MOST_CELLS, SAMPLE, ROUNDS = 4_096, 128, 4_096, 4
#: Rows that are placed at once, and room for rounding in the bounds.
PLACED, SLACK = 16_384, 1e-6


def unit(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of length 1, and the places of those that have a length."""
    flat = column.combine_chunks()
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))
    length = np.sqrt((x * x).sum(axis=1))
    kept = np.flatnonzero((length > 0) & np.isfinite(length))
    return x[kept] / length[kept, None], kept


def centres(x: np.ndarray, many: int) -> np.ndarray:
    """Rows far from each other, moved to the middle of what is at home with them."""
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < min(many, len(x)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(ROUNDS):
        sums = np.zeros_like(c)
        np.add.at(sums, (x @ c.T).argmax(axis=1), x)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        c = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), c)
    return c


def beyond(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(probe, centre): the most that the planes leave for a cosine."""
    apart = np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(axis=2), 0))
    per = np.divide(1.0, apart, out=np.zeros_like(apart), where=apart > 1e-6)
    out = np.ones((len(q), len(c)))
    for at in range(0, len(q), 512):
        s = q[at : at + 512] @ c.T
        for k in range(len(c)):
            a = np.clip(((s - s[:, [k]]) * per[k]).max(axis=1), 0, 1)
            out[at : at + 512, k] = np.sqrt(1 - a * a)
    return out


def bounds(q: np.ndarray, c: np.ndarray, cells: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """(probe, k): the most that a cosine with a vector of cells[k] can be where
    lows[k] is the least product of its vectors with their centre."""
    turn = np.arccos(np.clip(q @ c.T, -1, 1))[:, cells] - np.arccos(np.clip(lows, -1, 1))
    return np.minimum(np.cos(np.maximum(turn, 0)), beyond(q, c)[:, cells]) + SLACK


def found(rows: DataFrame, by: str, vector: str, n: int, many: int) -> DataFrame:
    """(centres): one row, the centres of rows as bytes."""

    def choose(table: pa.Table) -> pa.Table:
        x, _ = unit(table[vector])
        return pa.table({"centres": pa.array([centres(x, many).tobytes()] if len(x) else [], pa.binary())})

    some = rows.filter(F.pmod(F.xxhash64(by), F.lit(max(1, n // (2 * SAMPLE)))) == 0).orderBy(by).limit(SAMPLE).select(vector)
    return written(some.groupBy().applyInArrow(choose, "centres binary"), "cells-centres")


def dealt(rows: DataFrame, by: str, n: int, guide: DataFrame) -> PandasCogroupedOps:
    """Rows in parts, each part beside the guide's one row."""
    parts = max(1, -(-n // PLACED))
    left = rows.withColumn("p", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    return left.groupBy("p").cogroup(guide.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).groupBy("p"))


def matrix(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(-1, width)


def placed(rows: DataFrame, by: str, vector: str, n: int, guide: DataFrame) -> DataFrame:
    """Rows that have a length, with their cell and the product with its centre."""
    columns = rows.columns

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x, kept = unit(left[vector])
        if not len(x) or not right.num_rows:
            x, kept, s = x[:0], kept[:0], np.zeros((0, 1))
        else:
            s = x @ matrix(right["centres"][0].as_py(), x.shape[1]).T
        cell = s.argmax(axis=1)
        out = left.select(columns).take(pa.array(kept))
        return out.append_column("cell", pa.array(cell.astype(np.int32))).append_column("near", pa.array(s[np.arange(len(s)), cell].astype(float)))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return dealt(rows, by, n, guide).applyInArrow(run, f"{kinds}, cell int, near double")
