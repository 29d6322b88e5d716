"""SimHash near-duplicate groups through BK-trees.

Distinct fingerprints are dealt to shards by the bits on which a pair within
the radius must agree: the 64 bits form 8 blocks of 8, and two fingerprints at
distance r or less differ in at most r blocks, so for one of the C(8, r)
choices of r blocks they agree on all the others. A shard is one such choice
with the value of the other blocks; with r = 2 only 16 bits vary in it, so it
holds at most 65,536 fingerprints and its tree at most 512 KB, whatever the
corpus. A tree of all fingerprints, or a broadcast of all shards, has no such
bound; a shard's tree is therefore sent to where the queries of the shard are,
which is the one task that has both. In the tree children are keyed by their
integer Hamming distance to the parent, and a search follows only edges whose
key is within the radius of the distance just measured.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import anchored, drop_written, fresh, slices, written
from .components import components

SEED = 42
SHINGLE = 3
RADIUS = 2
BLOCKS = 8
#: Pairs (query, node) that a tree search holds at once.
FRONTIER = 1 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _words(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in runs, so that no text is split as a whole."""
    at = 0
    while at < len(text):
        end = at + size
        cut = _SPACE.search(text, end) if end < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end].translate(_LOWER).split()
        at = end


def fingerprint(text: bytes) -> int:
    """SimHash of one UTF-8 text: 3-word shingles, repeats included."""
    ones, n, tail = np.zeros(64, np.int64), 0, []
    for run in _words(text):
        words = tail + run
        if len(words) >= SHINGLE:
            hashes = [xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(words, words[1:], words[2:], strict=False))]
            bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8)).reshape(-1, 64)
            ones += bits.sum(axis=0, dtype=np.int64)
            n += len(hashes)
        tail = words[-(SHINGLE - 1) :]
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per input row; fp is the fingerprint's 64 bits as
    a signed long. A null text counts as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


class Forest:
    """One BK-tree for each shard, built and searched for all shards at once.

    values: the shards' fingerprints one after the other, distinct in a shard;
    starts: where each shard begins.
    """

    def __init__(self, values: np.ndarray, starts: np.ndarray) -> None:
        n = len(values)
        self.values = values
        self.root = np.repeat(starts, np.diff(np.append(starts, n)))
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        pending = np.setdiff1d(np.arange(n), starts, assume_unique=True)
        at = self.root[pending]
        while len(pending):
            key = at * 65 + np.bitwise_count(values[pending] ^ values[at])
            _, first, group = np.unique(key, return_index=True, return_inverse=True)
            child = pending[first]  # the first of those at one distance becomes the child
            parent[child], edge[child] = at[first], key[first] % 65
            left = np.ones(len(pending), bool)
            left[first] = False
            pending, at = pending[left], child[group][left]
        nodes = np.flatnonzero(parent >= 0)
        keys = parent[nodes] * 65 + edge[nodes]
        order = np.argsort(keys, kind="stable")
        self.children, self.keys = nodes[order], keys[order]

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) of all pairs of a shard within the radius, node before query."""
        n = len(self.values)
        todo = [(np.arange(n), self.root)]
        while todo:
            query, node = todo.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                todo += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            d = np.bitwise_count(self.values[query] ^ self.values[node]).astype(np.int64)
            hit = (d <= radius) & (node < query)
            if hit.any():
                yield query[hit], node[hit]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), side="right")
            many = high - low
            if total := int(many.sum()):
                within = np.arange(total) - np.repeat(np.cumsum(many) - many, many)
                todo.append((np.repeat(query, many), self.children[np.repeat(low, many) + within]))


def _links(values: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in each shard: (fingerprint, a linked one)."""
    top = list(range(len(values)))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for queries, nodes in Forest(values, starts).pairs(radius):
        for q, m in zip(queries.tolist(), nodes.tolist(), strict=True):
            q, m = find(q), find(m)
            if q != m:
                top[max(q, m)] = min(q, m)
    tops = np.array([find(x) for x in range(len(values))], np.int64)
    moved = np.flatnonzero(tops != np.arange(len(values)))
    return values[moved], values[tops[moved]]


def _masks(radius: int) -> list[int]:
    width = 64 // BLOCKS
    whole = (1 << 64) - 1
    masks = [whole & ~sum(((1 << width) - 1) << (width * k) for k in out) for out in combinations(range(BLOCKS), radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp), distinct -> (a, b): links that connect all fingerprints within the
    radius of each other; at most one fewer than the fingerprints in each shard."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("fps")
            starts = np.asarray(col.offsets)[:-1].astype(np.int64)
            values = np.asarray(col.values).astype(np.int64)
            a, c = _links(values[starts[0] :].view(np.uint64), starts - starts[0], radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64))], ["a", "b"])

    shard = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(_masks(radius))]))
    shards = distinct.select("fp", shard.alias("s")).groupBy("s.k", "s.v").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    return shards.select("fps").mapInArrow(run, "a long, b long")


def groups(own: DataFrame, id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(id, fp) -> (fp, component_id, root), one row per fingerprint: the
    smallest id that its links reach, and the fingerprint that stands for all
    that they reach."""
    per_fp = written(own.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-distinct")
    found = written(links(per_fp.select("fp"), radius), "simhash-links")
    member = components(found)
    linked = member.join(per_fp, member.node == per_fp.fp).select("fp", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    moved = linked.join(least, "root").select("fp", "component", "root")
    # From a table of its own: then both sides of a join on it are plain exchanges, and a fingerprint of very many rows is split.
    found_groups = written(per_fp.join(moved, "fp", "left").select("fp", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component")).alias("component_id"), F.coalesce("root", "fp").alias("root")), "simhash-groups")
    for done in (per_fp, found, member):
        drop_written(own.sparkSession, done)
    return found_groups


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id), one row per input row.

    component_id is the smallest id among all documents that links reach.
    Null or wordless texts have fingerprint zero and link like others; a text
    of any length is read whole, in runs; a null id takes part without ever
    being the smallest; repeated rows and ties give one row each; an empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    own = written(fingerprints(docs, id_col, text_col), "simhash")
    return own.join(groups(own, "doc_id", radius).drop("root"), "fp", "left").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs without near duplicates: of each group one row stays, with all its
    columns.

    It is the row with the smallest id (null counts as the largest), of those
    the one whose text has the smallest hash, of those the one whose whole row
    has; rows alike in that are alike in all. Rows are told apart by where they
    stand and not by id, so unlike texts under one id both stay.
    """
    own, file, place = anchored(docs, "simhash-documents")
    asked = own.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(file).alias("file"), F.col(place).alias("place"), F.col(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                found = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column("text").cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.array(found, np.uint64).view(np.int64))], [*b.schema.names[:-1], "fp"])

    slim = written(asked.mapInArrow(run, "id long, h long, whole long, file long, place long, fp long"), "simhash")
    of = groups(slim, "id", radius).select(F.col("fp").alias("of"), "root")
    least = F.min(F.struct(F.col("id").isNull(), "id", "h", "whole", "file", "place")).alias("least")
    # First within a fingerprint, where most copies meet, and only then by group.
    first = slim.groupBy("fp").agg(least)
    kept_file, kept_place = fresh(own, "kept_file", "kept_place")
    stays = first.join(of, F.col("fp") == F.col("of")).groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.file").alias(kept_file), F.col("least.place").alias(kept_place))
    # The list grows with the corpus, so it is never a broadcast.
    kept = own.join(written(stays, "simhash-stays").hint("merge"), (F.col(file) == F.col(kept_file)) & (F.col(place) == F.col(kept_place)), "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op8(docs: DataFrame) -> DataFrame:
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_duplicates(docs).select("doc_id", hexed.alias("fingerprint"), "component_id")
