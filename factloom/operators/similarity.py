"""Exact similarity join of vectors within groups, pruned on the unit sphere.

Equal vectors of a group are one node, whatever number of rows has them. Pivots
cut a group's nodes into cells, each node at home with its nearest pivot; a
cell's nodes are cut by their angle to the pivot into rings and those into
blocks of about ``BLOCK``, in a large group of up to ``MOST_BLOCK``: what is sent
is a group's nodes times its blocks. A node visits only blocks that can hold a partner:

* Nodes at home with c lie on c's side of the plane between c and any other
  pivot. A node that is a beyond that plane has a cosine of at most
  sqrt(1 - a * a) with all of them, so cells with a > sqrt(1 - t * t) are left
  out (for a threshold t above 0; else none is).
* Two nodes whose angles to one pivot differ by more than acos(t) are no pair,
  so rings further off than that are left out.

Both bounds are exact: pruning changes the work, never the result. A block's
visitors are cut into pieces of the same size, and each piece meets the block in
matrix products of at most ``PRODUCTS`` pairs in one task. For pairs of rows a node
brings its rows' ids along, ``ROWS`` at a time, so that no pair is sent for them. Pivots are chosen from at most ``SAMPLE``
nodes a group; that choice decides how much is pruned only.

Rows with a null id or group, without a vector, or whose vector holds a null or
a number that is not finite or has length 0, are in no pair. Vectors of one
group that differ in width are never compared.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.staging import stored
from .neighbours import key_of

#: Nodes of a block, and visitors that meet one at once.
BLOCK = 1024
#: A block for so many of a large group, up to so many nodes and bytes in doubles.
SHARE, MOST_BLOCK, BLOCK_BYTES = 32, 16_384, 16 << 20
#: Pairs that are expanded at once, and rows of one node.
PRODUCTS, ROWS = 1 << 20, 64
#: Pairs of one product, few enough for a core's own cache; above this share of them all are taken in doubles.
TILE, DENSE = 1 << 17, 1 / 16
#: A pivot for so many nodes, up to the most pivots of a group.
PER_PIVOT, MOST_PIVOTS = 16, 256
#: Nodes among which a group's pivots are chosen.
SAMPLE = 2048
#: Nodes of the sample that show what pivots leave open, and the share up to which they are worth it.
TRIED, WORTH = 256, 0.75
#: Nodes placed at once; steps of the angle that rings are made of; parts of a cell's visitors.
PLACED, STEPS, PARTS = 2048, 4096, 32
#: Room for rounding in the bounds.
SLACK = 1e-6

GROUP = ["g", "width"]
CELL = [*GROUP, "cell"]
RING = [*CELL, "ring"]
BLOCKS = [*RING, "part"]


@dataclass(frozen=True)
class Links:
    """members: (g, key, id, asked) of every row with a usable vector; links:
    (g, a, b, similarity), keys of unlike vectors, a < b; work: (g, width,
    cell, ring, part, nodes, visits, pieces), what each block was compared with."""

    members: DataFrame
    links: DataFrame
    work: DataFrame


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Unit vectors in doubles."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(-1, width)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _packed(column: pa.ChunkedArray, width: int, kind: type) -> pa.Array:
    """Vectors as bytes, which are sent on many times, in less time than lists."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
    ends = np.arange(len(column) + 1, dtype=np.int32) * (width * flat.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(ends), pa.py_buffer(flat)])


def _unpacked(column: pa.ChunkedArray, width: int, kind: type) -> np.ndarray:
    """Unit vectors in doubles."""
    x = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _kind(nodes: DataFrame) -> type:
    return np.float32 if nodes.schema["e"].dataType.elementType.simpleString() == "float" else np.float64


def _near(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, q, cosine) of the pairs of rows of x and y at the threshold or above:
    tiles of products in single precision, with room for its rounding, and
    what they leave in doubles."""
    low = np.float32(threshold - (x.shape[1] + 4) * 2.0**-22)
    single_x, single_y, step = x.astype(np.float32), np.ascontiguousarray(y.T.astype(np.float32)), max(1, TILE // max(1, len(y)))
    ps, qs, sims = [], [], []
    for at in range(0, len(x), step):
        s = single_x[at : at + step] @ single_y
        left = np.flatnonzero(s.ravel() >= low)
        if not len(left):
            continue
        p, q = np.divmod(left, len(y))
        sim = (x[at : at + step] @ y.T).ravel()[left] if len(left) > DENSE * s.size else np.einsum("nd,nd->n", x[p + at], y[q])
        kept = sim >= threshold
        ps.append(p[kept] + at)
        qs.append(q[kept])
        sims.append(sim[kept])
    return tuple(np.concatenate(v) if v else np.zeros(0, kind) for v, kind in ((ps, np.int64), (qs, np.int64), (sims, float)))


def _spread(x: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other: each is the one furthest from those before."""
    chosen = [0]
    nearest = x @ x[0]
    while len(chosen) < min(count, len(x)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return x[chosen]


def _pivots(nodes: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """(g, width, n, pivots): one row a group, the pivots' unit vectors as bytes;
    one pivot where most of the sample must visit nearly all cells, as cells
    then only multiply what is sent."""
    first = W.partitionBy(*GROUP).orderBy("key")  # a key is a hash
    sample = nodes.select(*GROUP, "key", "e").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= SAMPLE).drop("n")

    def choose(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        x = _matrix(table["e"], key[1].as_py())
        found = _spread(x, table["wanted"][0].as_py())
        if _reach(x[:TRIED], found, threshold)[2].mean() > WORTH:
            found = found[:1]
        return pa.table({"g": pa.array([key[0].as_py()], table["g"].type), "width": pa.array([key[1].as_py()], pa.int32()), "n": table["size"][:1], "pivots": [found.tobytes()]})

    wanted = F.least(F.lit(MOST_PIVOTS), F.ceil(F.col("n") / PER_PIVOT)).cast("int").alias("wanted")
    g = nodes.schema["g"].dataType.simpleString()
    return sample.join(sizes.select(*GROUP, F.col("n").alias("size"), wanted), GROUP).groupBy(*GROUP).applyInArrow(choose, f"g {g}, width int, n long, pivots binary")


def _reach(x: np.ndarray, pivots: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home, angles to all pivots, cells that can hold a partner)."""
    s = np.clip(x @ pivots.T, -1, 1)
    home = s.argmax(axis=1)
    near = np.ones(s.shape, bool)
    if threshold > 0:
        apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
        per = np.divide(1.0, apart, out=np.zeros_like(apart), where=apart > 1e-6)
        limit = np.sqrt(max(0.0, 1 - threshold * threshold)) + SLACK
        for at in range(0, len(s), 512):
            some = s[at : at + 512]
            for c in range(len(pivots)):
                near[at : at + 512, c] = ((some - some[:, [c]]) * per[c]).max(axis=1) <= limit
    return home, np.arccos(s), near


def _placed(nodes: DataFrame, sizes: DataFrame, pivots: DataFrame, threshold: float) -> DataFrame:
    """nodes, their vectors as bytes, with their cell and angle, and the cells
    from there on that they visit, with the angles there."""
    parts = F.ceil(F.col("n") / PLACED).cast("int")
    dealt = nodes.join(sizes, GROUP).withColumn("p", F.pmod(F.xxhash64("key", "chunk"), parts).cast("int")).drop("n")
    copies = pivots.withColumn("p", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")

    columns, kind = nodes.columns, _kind(nodes)

    def place(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        width = key[1].as_py()
        x = _matrix(left["e"], width) if left.num_rows else np.zeros((0, width))
        home, angles, near = _reach(x, np.frombuffer(right["pivots"][0].as_py(), np.float64).reshape(-1, width), threshold)
        rows = np.arange(len(x))
        near[rows, home] = True
        near &= np.arange(near.shape[1]) >= home[:, None]
        at, cells = np.nonzero(near)
        ends = np.concatenate([[0], np.cumsum(near.sum(axis=1))]).astype(np.int32)
        out = left.select(columns).set_column(columns.index("e"), "e", _packed(left["e"], width, kind))
        out = out.append_column("cell", pa.array(home.astype(np.int32))).append_column("angle", pa.array(angles[rows, home]))
        out = out.append_column("cells", pa.ListArray.from_arrays(ends, pa.array(cells.astype(np.int32))))
        return out.append_column("angles", pa.ListArray.from_arrays(ends, pa.array(angles[at, cells])))

    kinds = ", ".join(f"{f.name} {'binary' if f.name == 'e' else f.dataType.simpleString()}" for f in nodes.schema)
    schema = f"{kinds}, cell int, angle double, cells array<int>, angles array<double>"
    return dealt.groupBy(*GROUP, "p").cogroup(copies.groupBy(*GROUP, "p")).applyInArrow(place, schema)


def _step(angle: str) -> Column:
    return F.floor(F.col(angle) / np.pi * STEPS).cast("int")


def _block() -> Column:
    """Nodes of a block of a group of n."""
    most = F.least(F.lit(MOST_BLOCK), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("width"))))
    return F.greatest(F.lit(BLOCK), F.least(most, F.floor(F.col("n") / SHARE))).cast("int")


def _rings(placed: DataFrame, sizes: DataFrame) -> DataFrame:
    """(cell, step, ring): steps of the angle taken together while they hold
    few nodes. Counts by step meet in a window, never the nodes."""
    steps = placed.groupBy(*CELL, _step("angle").alias("step")).agg(F.count("*").alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.max("asked").alias("asked"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*CELL).orderBy("step").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return steps.withColumn("before", before).join(sizes.select(*GROUP, "block"), GROUP).withColumn("ring", F.floor(F.col("before") / F.col("block")).cast("int")).drop("before")


def links(df: DataFrame, threshold: float, group: str = "namespace", id_col: str = "id", embedding: str = "embedding", asked: Column | None = None) -> Links:
    """All pairs of unlike vectors of one group with a cosine of the threshold
    or more, exactly; only those with an asked row on either side, if told."""
    rows = stored(_usable(df, group, id_col, embedding, asked), "similar-rows")
    nodes = rows().groupBy("g", "key").agg(F.first("e").alias("e"), F.max("asked").alias("asked")).withColumn("chunk", F.lit(0))
    found, work = _met(nodes, threshold)
    return Links(rows().select("g", "key", "id", "asked"), found, work)


def _usable(df: DataFrame, group: str, id_col: str, embedding: str, asked: Column | None, carry: Sequence[str] = ()) -> DataFrame:
    """(g, id, asked, key, e) and x_ with the name of each column carried."""
    e = F.col(embedding)
    usable = F.col(id_col).isNotNull() & F.col(group).isNotNull() & (F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(e, lambda v: v != 0)
    told = F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    own = [F.col(group).alias("g"), F.col(id_col).alias("id"), told.alias("asked"), key_of(embedding).alias("key"), e.alias("e")]
    return df.filter(F.coalesce(usable, F.lit(False))).select(*own, *[F.col(c).alias(f"x_{c}") for c in carry])


def _met(made: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(links, work) of nodes (g, key, chunk, e, asked). Where they have rows m,
    (id, asked, gone, x_...), links are of rows: (g, similarity, a, b, and each
    side's carried columns), without those whose id is among the other's gone."""
    nodes = stored(made.withColumn("width", F.size("e")), "similar-nodes")
    bring = ["m"] if "m" in made.columns else []
    sizes = nodes().groupBy(*GROUP).agg(F.count("*").alias("n")).withColumn("block", _block())
    pivots = stored(_pivots(nodes(), sizes, threshold), "similar-pivots")
    placed = stored(_placed(nodes(), sizes.drop("block"), pivots(), threshold), "similar-placed")

    steps = _rings(placed(), sizes)
    rings = steps.groupBy(*RING).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("asked").alias("any_asked"), F.first("block").alias("block")).withColumn("parts", F.ceil(F.col("n") / F.col("block")).cast("int")).drop("block")
    spots = stored(steps.select(*CELL, "step", "ring").join(rings, RING), "similar-rings")
    rings = spots().select(*RING, "lo", "hi", "parts", "any_asked").distinct()

    def settled() -> DataFrame:
        at = spots().select(*CELL, "step", "ring", "parts")
        return placed().withColumn("step", _step("angle")).join(at, [*CELL, "step"]).withColumn("part", F.pmod(F.xxhash64("key", "chunk"), F.col("parts")).cast("int")).drop("step", "parts")

    homes = settled()
    turn = F.acos(F.lit(float(np.clip(threshold, -1, 1)))) + SLACK
    trips = homes.select(*GROUP, F.col("cell").alias("own_cell"), F.col("ring").alias("own_ring"), F.col("part").alias("own_part"), "key", "chunk", "asked", "e", *bring, F.explode(F.arrays_zip("cells", "angles")).alias("to"))
    trips = trips.select("*", F.col("to.cells").alias("cell"), F.col("to.angles").alias("at"), F.pmod(F.xxhash64("key", "chunk", F.lit(1)), F.lit(PARTS)).cast("int").alias("salt")).drop("to")
    stops = rings.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    met = trips.join(stops, [*CELL, "salt"]).filter((F.col("at") >= F.col("lo") - turn) & (F.col("at") <= F.col("hi") + turn) & (F.col("asked") | F.col("any_asked")))
    own = F.struct("own_cell", "own_ring", "own_part") == F.struct(F.col("cell").alias("own_cell"), F.col("ring").alias("own_ring"), F.col("part").alias("own_part"))
    on = (F.col("cell") != F.col("own_cell")) | (F.col("ring") > F.col("own_ring")) | ((F.col("ring") == F.col("own_ring")) & (F.col("part") >= F.col("own_part")))
    visits = met.filter(on).select(*BLOCKS, "key", "chunk", "asked", "e", *bring, own.alias("own"))

    counts = visits.groupBy(*BLOCKS).agg(F.count("*").alias("visits"))
    work = stored(counts.join(settled().groupBy(*BLOCKS).agg(F.count("*").alias("nodes")), BLOCKS).join(sizes.select(*GROUP, "block"), GROUP).withColumn("pieces", F.ceil(F.col("visits") / F.col("block")).cast("int")).drop("block"), "similar-work")
    pieces = lambda: work().select(*BLOCKS, "pieces")
    sent = [*BLOCKS, "piece", "key", "asked", "e", *bring]
    left = visits.join(pieces(), BLOCKS).withColumn("piece", F.pmod(F.xxhash64("key", "chunk", F.lit(2)), F.col("pieces")).cast("int")).select(*sent, "own", F.lit(True).alias("visits"))
    right = settled().join(pieces(), BLOCKS).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(*sent, F.lit(False).alias("own"), F.lit(False).alias("visits"))
    g = f"g {made.schema['g'].dataType.simpleString()}"
    if not bring:
        schema = f"{g}, similarity double, a string, b string"
    else:
        fields = [f for f in made.schema["m"].dataType.elementType.fields if f.name == "id" or f.name.startswith("x_")]
        schema = f"{g}, similarity double, " + ", ".join(f"{side}{'' if f.name == 'id' else f.name[1:]} {f.dataType.simpleString()}" for side in "ab" for f in fields)
    carried, kind = [f.name for f in fields] if bring else [], _kind(made)

    def multiply(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        visitors, block = table.filter(table["visits"]), table.filter(pc.invert(table["visits"]))
        if not visitors.num_rows or not block.num_rows:
            return
        width = key[1].as_py()
        y, at_once = _unpacked(block["e"], width, kind), max(1, 4 * PRODUCTS // block.num_rows)
        keys = np.asarray(block["key"].to_pylist(), object)
        asked = block["asked"].to_numpy()
        rows = block["m"].combine_chunks() if bring else None
        for at in range(0, visitors.num_rows, at_once):
            some = visitors.slice(at, at_once)
            p, q, s = _near(_unpacked(some["e"], width, kind), y, threshold)
            a, b = np.asarray(some["key"].to_pylist(), object)[p], keys[q]
            keep = (some["asked"].to_numpy()[p] | asked[q]) & (a != b) & (~some["own"].to_numpy()[p] | (a < b))
            p, q, a, b, s = p[keep], q[keep], a[keep], b[keep], s[keep]
            if not len(p):
                continue
            if bring:
                yield from _expanded(key[0], some["m"].combine_chunks(), rows, p, q, s, carried)
            else:
                yield pa.RecordBatch.from_arrays([pa.repeat(key[0], len(p)), pa.array(s), pa.array(np.where(a < b, a, b), pa.string()), pa.array(np.where(a < b, b, a), pa.string())], ["g", "similarity", "a", "b"])

    met_in_blocks = left.unionByName(right).groupBy(*BLOCKS, "piece")
    return met_in_blocks.applyInArrow(multiply, schema), work()


def _expanded(g: pa.Scalar, left: pa.ListArray, right: pa.ListArray, p: np.ndarray, q: np.ndarray, s: np.ndarray, carried: list[str]) -> Iterator[pa.RecordBatch]:
    """The pairs of the rows of nodes p and q, at most about ``PRODUCTS`` at once."""
    (rows, n, first), (others, m, start) = ((x.flatten(), c := x.value_lengths().to_numpy(zero_copy_only=False), np.cumsum(c) - c) for x in (left, right))
    count = n[p].astype(np.int64) * m[q]
    reached = np.cumsum(count)
    cuts = np.unique(np.searchsorted(reached, np.arange(PRODUCTS, reached[-1] + PRODUCTS, PRODUCTS), side="right").clip(1, len(p)))
    for lo, hi in zip([0, *cuts], [*cuts, len(p)]):
        if lo == hi:
            continue
        c = count[lo:hi]
        of = np.repeat(np.arange(lo, hi), c)
        k = np.arange(len(of)) - np.repeat(np.cumsum(c) - c, c)
        a, b = rows.take(pa.array(first[p[of]] + k // m[q[of]])), others.take(pa.array(start[q[of]] + k % m[q[of]]))
        keep = pc.or_(a.field("asked"), b.field("asked")).to_numpy(zero_copy_only=False)
        for x, y in ((a, b), (b, a)):
            gone = x.field("gone")
            sizes = gone.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            if sizes.any():
                at = np.repeat(np.arange(len(sizes)), sizes)
                keep[at[pc.equal(gone.flatten(), y.field("id").take(pa.array(at))).to_numpy(zero_copy_only=False)]] = False
        sides = [side.field(name).filter(pa.array(keep)) for side in (a, b) for name in carried]
        yield pa.RecordBatch.from_arrays([pa.repeat(g, int(keep.sum())), pa.array(s[of][keep]), *sides], ["g", "similarity", *[f"{side}{'' if name == 'id' else name[1:]}" for side in "ab" for name in carried]])


def pairs(df: DataFrame, threshold: float, group: str = "namespace", id_col: str = "id", embedding: str = "embedding", asked: Column | None = None, carry: Sequence[str] = (), without: DataFrame | None = None) -> DataFrame:
    """(group, a, b, similarity) with a < b: all pairs of rows of one group at
    the threshold or above, rows of equal vectors too (their cosine is 1). What
    is asked is quadratic in the copies; ``classes`` is not. Columns to carry
    come as a_ and b_ with their names; pairs of ``without`` (lo, hi) are left
    out, of which an id's own travel with it."""
    kind = df.schema[id_col].dataType.simpleString()
    usable = _usable(df, group, id_col, embedding, asked, carry)
    if without is None:
        usable = usable.withColumn("gone", F.lit(None).cast(f"array<{kind}>"))
    else:
        lo, hi = without.columns
        gone = without.filter(F.col(lo) < F.col(hi)).groupBy(F.col(lo).cast(kind).alias("id")).agg(F.collect_set(F.col(hi).cast(kind)).alias("gone"))
        usable = usable.join(gone, "id", "left")
    rows = stored(usable, "similar-rows")
    extra = [f"x_{c}" for c in carry]
    chunks = rows().groupBy("g", "key").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("chunks"))
    cut = rows().join(chunks, ["g", "key"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    nodes = cut.groupBy("g", "key", "chunk").agg(F.first("e").alias("e"), F.max("asked").alias("asked"), F.collect_list(F.struct("id", "asked", "gone", *extra)).alias("m"))
    unlike, _ = _met(nodes, threshold)
    if threshold <= 1:
        side = lambda name: rows().select("g", "key", F.col("id").alias(name), F.col("asked").alias(f"{name}_told"), F.col("gone").alias(f"{name}_gone"), *[F.col(f"x_{c}").alias(f"{name}_{c}") for c in carry])
        alike = side("a").join(side("b"), ["g", "key"]).filter((F.col("a") < F.col("b")) & (F.col("a_told") | F.col("b_told")) & ~F.coalesce(F.array_contains("a_gone", F.col("b")), F.lit(False)))
        unlike = unlike.unionByName(alike.withColumn("similarity", F.lit(1.0)).select(*unlike.columns))
    swap = F.col("a") > F.col("b")
    ends = [F.when(swap, F.col(f"{y}{c}")).otherwise(F.col(f"{x}{c}")).alias(f"{x}{c}") for c in ["", *[f"_{c}" for c in carry]] for x, y in ("ab", "ba")]
    chosen = unlike.select(F.col("g").alias(group), "similarity", *ends)
    return chosen.select(group, "a", "b", "similarity", *[f"{x}_{c}" for c in carry for x in "ab"])


def classes(found: Links) -> DataFrame:
    """(g, id, class_id, links): one row for each member. The class is the
    smallest id with an equal vector of the group, links counts the other rows
    within the threshold, copies among them. No pair of rows is made."""
    by_key = found.members.groupBy("g", "key").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    both = found.links.select("g", F.col("a").alias("key"), F.col("b").alias("other")).unionAll(found.links.select("g", F.col("b").alias("key"), F.col("a").alias("other")))
    others = both.join(by_key.select("g", F.col("key").alias("other"), "copies"), ["g", "other"]).groupBy("g", "key").agg(F.sum("copies").alias("beyond"))
    whole = by_key.join(others, ["g", "key"], "left").select("g", "key", "class_id", (F.col("copies") - 1 + F.coalesce("beyond", F.lit(0))).alias("links"))
    return found.members.join(whole, ["g", "key"]).select("g", "id", "class_id", "links")


def figures(found: Links) -> DataFrame:
    """(g, vectors, blocks, products, compared, possible, share): how many
    products of blocks there were, and how many of the possible pairs of unlike
    vectors they held; a block against itself counts its pairs once."""
    n = F.sum("nodes")
    inner = F.sum(F.col("nodes") * F.col("visits") - F.col("nodes") * (F.col("nodes") + 1) / 2)
    out = found.work.groupBy(*GROUP).agg(n.alias("vectors"), F.count("*").alias("blocks"), F.sum("pieces").alias("products"), inner.cast("long").alias("compared"))
    out = out.withColumn("possible", (F.col("vectors") * (F.col("vectors") - 1) / 2).cast("long"))
    return out.select("g", "vectors", "blocks", "products", "compared", "possible", F.when(F.col("possible") > 0, F.col("compared") / F.col("possible")).otherwise(0.0).alias("share"))
