"""Vectors: cosine in doubles, top-k, the hash embedder."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import cells
from .cells import unit as _unit
from .staging import stored, written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def similarity_to(probe: Sequence[float], embedding: str | Column = "embedding") -> Column:
    """Cosine with a literal vector, whose norm is known to the plan."""
    e = F.col(embedding) if isinstance(embedding, str) else embedding
    vector = F.array(*[F.lit(float(x)) for x in probe])
    length = float(np.sqrt(np.square(np.asarray(probe, float)).sum()))
    return dot(e, vector) / (norm(e) * F.lit(length))


DIMENSIONS = 768
_TOKEN = re.compile(r"[a-z0-9']+")


@lru_cache(maxsize=1 << 17)
def _place(piece: str, dim: int) -> tuple[int, float]:
    h = hashlib.sha256(piece.encode()).digest()
    return int.from_bytes(h[:4], "big") % dim, 1.0 if h[4] % 2 == 0 else -1.0


def embed_text(text: str | None, dim: int = DIMENSIONS) -> np.ndarray:
    """Hash embedding: each token's SHA-256 names a bucket and a sign; the
    first four letters of a longer token name another, at half weight with the
    token's sign; the sum has length 1. A text without tokens is the first axis."""
    sums = [0.0] * dim
    lower = (text or "").encode("ascii", "replace").decode().lower()  # other letters part tokens
    for token in _TOKEN.findall(lower):
        bucket, sign = _place(token, dim)
        sums[bucket] += sign
        if len(token) > 4:
            sums[_place(token[:4], dim)[0]] += sign / 2
    v = np.array(sums, np.float32)
    length = np.sqrt(np.float32((v * v).sum()))
    if not length:
        v[0] = length = 1
    return v / length


def embed(df: DataFrame, text: str = "content", out: str = "embedding", dim: int = DIMENSIONS, embedder=embed_text) -> DataFrame:
    """df with a vector of each text, by any function text -> vector."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: embedder(t, dim).tolist())

    return df.withColumn(out, run(F.col(text)))


#: Probes and rows that one task compares, and rows of one matrix product.
PROBES, ROWS, TILE = 8_192, 32_768, 2_048
#: Products of matrices differ by less from the sums that decide.
SLACK = 1e-9


def _best(q: np.ndarray, x: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probe, row, similarity): of each probe the rows that can be among its k
    nearest, by one tile of products after the other; least is what they have
    at any rate."""
    least = least.copy()
    probe, row, sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for at in range(0, len(x), TILE):
        tile = x[at : at + TILE]
        new_probe, new_row, new_sim = [probe], [row], [sim]
        for first in range(0, len(q), TILE):
            s = q[first : first + TILE] @ tile.T
            floor = least[first : first + TILE]
            if at == 0 and s.shape[1] > k:
                floor = np.maximum(floor, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
            i, j = np.nonzero(s >= floor[:, None] - SLACK)
            new_probe.append(i + first)
            new_row.append(j + at)
            for some in range(0, len(i), 8 * TILE):  # a pair's sum is the same in any tile
                new_sim.append((q[i[some : some + 8 * TILE] + first] * tile[j[some : some + 8 * TILE]]).sum(axis=1))
        probe, row, sim = map(np.concatenate, (new_probe, new_row, new_sim))
        order = np.lexsort((row, -sim, probe))
        probe, row, sim = probe[order], row[order], sim[order]
        starts = np.searchsorted(probe, np.arange(len(q)))
        nth = np.arange(len(probe)) - starts[probe]
        full = probe[nth == k - 1]
        least[full] = np.maximum(least[full], sim[nth == k - 1])
        probe, row, sim = probe[nth < k], row[nth < k], sim[nth < k]
    return probe, row, sim


def _least(q: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """What the k-th nearest of x has at least; -2 where there are fewer."""
    out = np.full(len(q), -2.0)
    if len(x) >= k:
        for at in range(0, len(q), 256):
            out[at : at + 256] = np.partition(q[at : at + 256] @ x.T, len(x) - k, axis=1)[:, len(x) - k] - SLACK
    return out


def nearest(df: DataFrame, probes: DataFrame, k: int, embedding: str = "embedding") -> DataFrame:
    """probes (probe_id, vector) -> (probe_id, id, similarity, rank): the k
    nearest of df to each, exactly. Rows lie in cells; a probe meets a block of
    its own cell first, whose k-th nearest says which cells can hold nearer
    ones, and then all blocks of those. Where vectors have no clusters that is
    all of them, which is quadratic. A task has a block of the probes and one of
    the rows and keeps its own best k of each probe. Equal vectors are one until
    then, of its k smallest ids."""
    id_type, probe_type = df.schema["id"].dataType.simpleString(), probes.schema["probe_id"].dataType.simpleString()
    rows = stored(df.filter(F.col(embedding).isNotNull()).select("id", F.col(embedding).alias("e")), "nearest-rows")
    asked = stored(probes.filter("vector is not null").select("probe_id", "vector"), "nearest-probes")
    n, probe_count = rows().count(), asked().count()
    centres = cells.found(rows(), "id", "e", n, max(1, min(cells.MOST_CELLS, n // cells.PER_CELL)))
    of = lambda column, parts: F.pmod(F.xxhash64(column), parts).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    placed = stored(cells.placed(rows(), "id", "e", n, centres), "nearest-placed")
    sizes = stored(placed().groupBy("cell").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("parts"), F.min("near").alias("low")), "nearest-cells")
    known = written(centres.crossJoin(F.broadcast(sizes().agg(F.array_sort(F.collect_list(F.struct("cell", "low"))).alias("cells")))), "nearest-guide")
    block = lambda: placed().select("id", "e", "cell").join(F.broadcast(sizes().select("cell", "parts")), "cell").withColumn("part", of("id", F.col("parts"))).drop("parts")

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        """A probe's own cell, and the most that a cosine can be in each of the cells."""
        q, kept = _unit(left["vector"])
        there = right["cells"][0].as_py() if right.num_rows else []
        if not len(q) or not there:
            q, kept, most, home = q[:0], kept[:0], np.zeros((0, 0)), np.zeros(0, np.int32)
        else:
            c = cells.matrix(right["centres"][0].as_py(), q.shape[1])
            at, lows = np.array([x["cell"] for x in there], np.int32), np.array([x["low"] for x in there])
            most, home = cells.bounds(q, c, at, lows), at[(q @ c[at].T).argmax(axis=1)]
        ends = np.arange(len(q) + 1, dtype=np.int32) * most.shape[1]
        out = left.select(["probe_id", "vector"]).take(pa.array(kept))
        return out.append_column("cell", pa.array(home.astype(np.int32))).append_column("most", pa.ListArray.from_arrays(pa.array(ends), pa.array(most.ravel())))

    homes = cells.dealt(asked(), "probe_id", probe_count, known).applyInArrow(place, f"probe_id {probe_type}, vector {probes.schema['vector'].dataType.simpleString()}, cell int, most array<double>")
    first = homes.join(F.broadcast(sizes().select("cell", "parts")), "cell").withColumn("part", of("probe_id", F.col("parts"))).drop("parts")

    def begin(asked: pa.Table, rows: pa.Table) -> pa.Table:
        (q, _), (x, _) = _unit(asked["vector"]), _unit(rows["e"])
        least = _least(q, x, k)
        return asked.select(["probe_id", "vector", "most"]).append_column("least", pa.array(least))

    begun = first.groupBy("cell", "part").cogroup(block().groupBy("cell", "part")).applyInArrow(begin, f"probe_id {probe_type}, vector {probes.schema['vector'].dataType.simpleString()}, most array<double>, least double")
    there = F.broadcast(sizes().agg(F.array_sort(F.collect_list(F.struct("cell", "parts"))).alias("there")))
    open_cells = F.filter(F.arrays_zip("there", "most"), lambda x: x["most"] >= F.col("least"))
    visits = stored(begun.crossJoin(there).select("probe_id", "vector", "least", F.explode(open_cells).alias("to")).select("probe_id", "vector", "least", F.col("to.there.cell").alias("cell"), F.col("to.there.parts").alias("parts")), "nearest-visits")
    pieces = stored(visits().groupBy("cell").agg(F.ceil(F.count("*") / PROBES).cast("int").alias("pieces")), "nearest-pieces")
    left = visits().withColumn("part", each("parts")).join(F.broadcast(pieces()), "cell").withColumn("piece", of("probe_id", F.col("pieces"))).drop("parts", "pieces")
    right = block().join(F.broadcast(pieces()), "cell").withColumn("piece", each("pieces")).drop("pieces")

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        (q, queries), (x, places) = _unit(asked["vector"]), _unit(rows["e"])
        least = asked["least"].to_numpy()[queries] if len(queries) else np.zeros(0)
        x = np.ascontiguousarray(x)
        _, first, node = np.unique(x.view(f"V{x.shape[1] * x.itemsize}").ravel() if len(x) else x.ravel(), return_index=True, return_inverse=True)
        by_id = np.argsort(first)  # of nodes equally near that of the smallest id comes first
        first, node = first[by_id], np.argsort(by_id)[node.ravel()]
        members = np.argsort(node, kind="stable")
        starts = np.searchsorted(node[members], np.arange(len(first) + 1))
        probe, near, sim = _best(q, x[first], k, least)
        count = np.minimum(starts[near + 1] - starts[near], k)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        found = members[np.repeat(starts[near], count) + nth]
        probe, sim = np.repeat(probe, count), np.repeat(sim, count)
        order = np.lexsort((found, -sim, probe))
        probe, found, sim = probe[order], found[order], sim[order]
        kept = np.arange(len(probe)) - np.searchsorted(probe, np.arange(len(q)))[probe] < k
        return pa.table({"probe_id": asked["probe_id"].take(pa.array(queries[probe[kept]])), "id": rows["id"].take(pa.array(places[found[kept]])), "similarity": pa.array(sim[kept])})

    by = ("cell", "part", "piece")
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, f"probe_id {probe_type}, id {id_type}, similarity double")
    order = W.partitionBy("probe_id").orderBy(F.col("similarity").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
