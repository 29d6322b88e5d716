"""Approximate neighbours: a small-world graph for each shard of the vectors.

Equal vectors are one node, whatever number of rows has them, and a node's key
is a hash of its vector; so a vector that very many rows share is one row of
one shard. Nodes are dealt to shards of about ``SHARD_NODES`` in the order of the
cells that they lie in (``functions.cells``), each shard's graph is built in one
task and stored as one row. A search walks the graph of the probe's own cell
first; what it finds there says which other shards can hold nearer nodes, and it
walks those. Nothing that a walk of every shard would find is left out; where
vectors have no clusters, every shard is walked.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cells, small_world
from ..functions.staging import scratch, stored

SHARD_NODES = 16_384
#: Nodes that a walk keeps at once.
BEAM = 100
#: Parts in which the rows of one vector are put in order first.
PARTS = 64
#: Cells for each shard, probes that walk one graph in a task, and room for single precision.
CELLS, PROBES, SLACK = 4, 16_384, 1e-5
GUIDE = "width int, centres binary, pieces array<struct<shard: int, cell: int, low: double>>"
GRAPH = "shard int, keys array<string>, width int, vectors binary, layers array<binary>, links array<binary>"


@dataclass(frozen=True)
class NeighbourIndex:
    """members: (key, id, shard) of every row; graphs: one row a shard; guide:
    one row, the centres of cells and what each shard has of which cell."""

    members: DataFrame
    graphs: DataFrame
    guide: DataFrame
    shards: int
    nodes: int


def key_of(vector: str) -> Column:
    """128 bits of a vector, as text."""
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), vector)), 16, "0") for seed in (1, 2)])


def create(rows: DataFrame, path: str, embedding: str = "embedding", shard_nodes: int = SHARD_NODES) -> NeighbourIndex:
    """Index all rows (id, embedding) that have a vector, at a path."""
    spark = rows.sparkSession
    keyed = rows.filter(F.col(embedding).isNotNull()).select("id", F.col(embedding).cast("array<float>").alias("e")).withColumn("key", key_of("e"))
    keyed.groupBy("key").agg(F.first("e").alias("e")).write.parquet(f"{path}/found")
    found = spark.read.parquet(f"{path}/found")
    count = found.count()
    shards = max(1, -(-count // shard_nodes))
    centres = cells.found(found, "key", "e", count, min(cells.MOST_CELLS, CELLS * (shards - 1) + 1))
    _dealt(found, count, shards, centres).write.parquet(f"{path}/nodes")
    nodes = spark.read.parquet(f"{path}/nodes")
    keyed.select("key", "id").join(nodes.select("key", "shard"), "key").write.parquet(f"{path}/members")
    pieces = nodes.groupBy("shard", "cell").agg(F.min("near").alias("low")).agg(F.array_sort(F.collect_list(F.struct("shard", "cell", "low"))).alias("pieces"))
    width = F.size("e").alias("width")
    centres.crossJoin(F.broadcast(pieces)).crossJoin(F.broadcast(nodes.select(width).limit(1))).select("width", "centres", "pieces").write.parquet(f"{path}/guide")

    def build(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        vectors = np.stack(table["e"].to_pylist()).astype(np.float32)
        g = small_world.build(vectors)
        packed = lambda arrays: [np.ascontiguousarray(a, np.int32).tobytes() for a in arrays]
        return pa.table({"shard": [key[0].as_py()], "keys": [table["key"].to_pylist()], "width": [vectors.shape[1]], "vectors": [g.vectors.tobytes()], "layers": [packed(g.layers)], "links": [packed(g.links)]}, _GRAPH)

    nodes.select("shard", "key", "e").repartitionByRange(shards, "shard").groupBy("shard").applyInArrow(build, GRAPH).write.parquet(f"{path}/graphs")
    return load(spark, path)


def _dealt(found: DataFrame, count: int, shards: int, centres: DataFrame) -> DataFrame:
    """(key, e, cell, near, shard): nodes by cell, within a cell by a hash, cut
    into shards of one size, about. Vectors without a length are in the first cell."""
    columns = found.columns

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x, kept = cells.unit(left["e"])
        cell, near = np.zeros(left.num_rows, np.int32), np.zeros(left.num_rows)
        if len(x) and right.num_rows:
            s = x @ cells.matrix(right["centres"][0].as_py(), x.shape[1]).T
            cell[kept], near[kept] = s.argmax(axis=1), s.max(axis=1)
        return left.select(columns).append_column("cell", pa.array(cell)).append_column("near", pa.array(near))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    placed = stored(cells.dealt(found, "key", count, centres).applyInArrow(run, f"{kinds}, cell int, near double"), "neighbours-placed")
    sizes = placed().groupBy("cell").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row a cell
    place = F.col("before") + F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1 << 20)) / (1 << 20) * F.col("n")
    shard = F.least(F.floor(place * shards / max(1, count)), F.lit(shards - 1)).cast("int")
    return placed().join(F.broadcast(sizes), "cell").select(*columns, "cell", "near", shard.alias("shard"))


_GRAPH = pa.schema([("shard", pa.int32()), ("keys", pa.list_(pa.string())), ("width", pa.int32()), ("vectors", pa.binary()), ("layers", pa.list_(pa.binary())), ("links", pa.list_(pa.binary()))])


def load(spark: SparkSession, path: str) -> NeighbourIndex:
    nodes = spark.read.parquet(f"{path}/nodes").count()
    graphs = spark.read.schema(GRAPH).parquet(f"{path}/graphs")
    last = graphs.agg(F.max("shard")).first()[0]
    return NeighbourIndex(spark.read.parquet(f"{path}/members"), graphs, spark.read.schema(GUIDE).parquet(f"{path}/guide"), 0 if last is None else last + 1, nodes)


def build(rows: DataFrame, embedding: str = "embedding") -> NeighbourIndex:
    """An index in the folder that driver and executors share."""
    return create(rows, scratch(rows.sparkSession, "neighbours"), embedding)


def _graph(row: dict) -> small_world.Graph:
    ints = lambda b: np.frombuffer(b, np.int32)
    layers = [ints(b) for b in row["layers"]]
    links = [ints(b).reshape(len(nodes), -1) for b, nodes in zip(row["links"], layers, strict=True)]
    return small_world.Graph(np.frombuffer(row["vectors"], np.float32).reshape(-1, row["width"]), layers, links)


def first_members(members: DataFrame, k: int) -> DataFrame:
    """Of each key the k smallest ids, in two steps: no task sorts a large key."""
    part = F.pmod(F.xxhash64("id"), F.lit(PARTS))
    some = members.withColumn("part", part).withColumn("nth", F.row_number().over(W.partitionBy("key", "part").orderBy("id"))).filter(F.col("nth") <= k)
    return some.withColumn("nth", F.row_number().over(W.partitionBy("key").orderBy("id"))).filter(F.col("nth") <= k).select("key", "id")


def nearest(index: NeighbourIndex, probes: DataFrame, k: int, allowed: DataFrame | None = None, beam: int = BEAM) -> DataFrame:
    """probes (probe_id, vector) -> (probe_id, id, similarity, rank, compared):
    the k nearest found of each, in single precision, and how many vectors the
    probe was compared with.

    With ``allowed`` (id) only those rows count, and a walk goes on until it
    has found k of them or seen all.
    """
    members = index.members if allowed is None else index.members.join(allowed.select("id"), "id", "left_semi")
    probe_type, id_type, kind = probes.schema["probe_id"].dataType.simpleString(), members.schema["id"].dataType.simpleString(), probes.schema["vector"].dataType.simpleString()
    if not index.shards:
        return probes.sparkSession.createDataFrame([], f"probe_id {probe_type}, id {id_type}, similarity double, rank int, compared long")
    open_keys = members.select("key", "shard").distinct().groupBy("shard").agg(F.collect_list("key").alias("allowed"))
    graphs = lambda: index.graphs.withColumn("allowed", F.lit(None).cast("array<string>")) if allowed is None else index.graphs.join(open_keys, "shard")
    asked, many = stored(probes.select("probe_id", "vector"), "neighbours-probes"), index.shards

    def route(left: pa.Table, right: pa.Table) -> pa.Table:
        """Where a probe begins, and the most that a cosine can be in each shard."""
        guide = right.slice(0, 1).to_pylist()[0]
        c = cells.matrix(guide["centres"], guide["width"]) if guide["centres"] else np.zeros((0, guide["width"]))
        shards, at, lows = (np.array([x[name] for x in guide["pieces"]]) for name in ("shard", "cell", "low"))
        q, kept = cells.unit(left["vector"])
        most, first = np.full((left.num_rows, many), 2.0), np.zeros(left.num_rows, np.int32)
        if len(q) and len(c):
            by_piece = cells.bounds(q, c, at, lows)
            own = np.full((len(q), many), -2.0)
            for k, shard in enumerate(shards):
                own[:, shard] = np.maximum(own[:, shard], by_piece[:, k])
            most[kept], first[kept] = own, shards[(q @ c[at].T).argmax(axis=1)]
        ends = np.arange(left.num_rows + 1, dtype=np.int32) * many
        out = left.select(["probe_id", "vector"])
        return out.append_column("first", pa.array(first)).append_column("most", pa.ListArray.from_arrays(pa.array(ends), pa.array(most.ravel())))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right["probe_id"]
        if not left.num_rows or not right.num_rows:
            return pa.table({"probe_id": ids.slice(0, 0), "key": pa.array([], pa.string()), "similarity": pa.array([], pa.float64()), "compared": pa.array([], pa.int64())})
        row = left.to_pylist()[0]
        g, keys = _graph(row), np.array(row["keys"], object)
        mask = None if row["allowed"] is None else np.isin(row["keys"], row["allowed"])
        nodes, sims, compared = small_world.search(g, np.stack(right["vector"].to_pylist()), k, beam, mask)
        there = (nodes >= 0) & (sims >= right["least"].to_numpy()[:, None] - SLACK)
        there[:, 0] = True  # a probe without a find still says what it was compared with
        rows, columns = np.nonzero(there)
        found = nodes[rows, columns]
        named = [keys[n] if n >= 0 else None for n in found]
        return pa.table({"probe_id": ids.take(pa.array(rows)), "key": pa.array(named, pa.string()), "similarity": pa.array(sims[rows, columns].astype(float)), "compared": pa.array(np.where(columns == 0, compared[rows], 0))})

    def walked(visits: DataFrame, name: str) -> Callable[[], DataFrame]:
        """visits (shard, probe_id, vector, least); a graph is sent once for so many probes."""
        sent = stored(visits, f"neighbours-{name}")
        pieces = stored(sent().groupBy("shard").agg(F.ceil(F.count("*") / PROBES).cast("int").alias("pieces")), f"neighbours-{name}-pieces")
        left = graphs().join(F.broadcast(pieces()), "shard").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
        left = left.repartition(2 * many, "shard", "piece")  # few rows that take long: not many to a task
        right = sent().join(F.broadcast(pieces()), "shard").withColumn("piece", F.pmod(F.xxhash64("probe_id"), F.col("pieces")).cast("int")).drop("pieces")
        return stored(left.groupBy("shard", "piece").cogroup(right.groupBy("shard", "piece")).applyInArrow(run, f"probe_id {probe_type}, key string, similarity double, compared long"), f"neighbours-{name}-found")

    routed = stored(cells.dealt(asked(), "probe_id", asked().count(), index.guide).applyInArrow(route, f"probe_id {probe_type}, vector {kind}, first int, most array<double>"), "neighbours-routed")
    begun = walked(routed().select(F.col("first").alias("shard"), "probe_id", "vector", F.lit(-2.0).alias("least")), "first")
    least = begun().groupBy("probe_id").agg(F.when(F.count("key") >= k, F.min("similarity")).otherwise(F.lit(-2.0)).alias("least"))
    # A probe without a row here began in a shard without rows that count.
    ahead = routed().join(least, "probe_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0))).select("probe_id", "vector", "least", "first", F.posexplode("most").alias("shard", "most"))
    others = walked(ahead.filter((F.col("shard") != F.col("first")) & (F.col("most") >= F.col("least") - SLACK)).select("shard", "probe_id", "vector", "least"), "others")
    probe = W.partitionBy("probe_id")
    met = begun().unionAll(others())
    best = met.withColumn("compared", F.sum("compared").over(probe)).filter("key is not null").withColumn("nth", F.row_number().over(probe.orderBy(F.col("similarity").desc(), "key"))).filter(F.col("nth") <= k)
    rows = first_members(members.join(best.select("key").distinct(), "key", "left_semi"), k)
    return best.join(rows, "key").withColumn("rank", F.row_number().over(probe.orderBy(F.col("similarity").desc(), "id"))).filter(F.col("rank") <= k).select("probe_id", "id", "similarity", "rank", "compared")
