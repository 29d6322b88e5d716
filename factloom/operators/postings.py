"""An inverted index: of each stem the texts that hold it and where.

A row is one stem in one block of at most ``BLOCK`` texts: their ids, the
places in each, and the most places that one text has. Rows lie by bucket of
the stem and sorted by stem, so that a query reads the row groups of its own
stems and nothing else; a stem in all texts is as many rows as there are
blocks, and no task holds it whole. New texts are new blocks; texts that are
gone drop out where matches meet the rows that may be seen.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexical

BLOCK = 512
BUCKETS = 32
#: Blocks of the highest bound whose ranks set what the others must reach; an
#: index of no more than so many times as many is ranked whole, at less cost.
FIRST_BLOCKS, WORTH_BOUNDS = 4, 16


@dataclass(frozen=True)
class Index:
    """The rows of an index, and how many blocks of texts there are."""

    rows: DataFrame
    blocks: int


def bucket(stem: str) -> int:
    return zlib.crc32(stem.encode()) % BUCKETS


def _packed(ids: pa.Array, texts: pa.ListArray, block: int) -> pa.RecordBatch:
    """One block: ids and the words of each text, in order."""
    lengths = texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = texts.flatten().dictionary_encode()
    stems: dict[str, int] = {}
    code = np.array([-1 if (s := lexical.lexeme(w)) is None else stems.setdefault(s, len(stems)) for w in flat.dictionary.to_pylist()], np.int64)
    doc = np.repeat(np.arange(len(ids)), lengths)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
    of = code[flat.indices.to_numpy(zero_copy_only=False)] if len(doc) else np.zeros(0, np.int64)
    doc, place, of = doc[of >= 0], place[of >= 0], of[of >= 0]
    order = np.lexsort((place, doc, of))
    doc, place, of = doc[order], place[order], of[order]
    new_stem = np.concatenate([[True], of[1:] != of[:-1]])[: len(of)]
    new_text = new_stem | np.concatenate([[True], doc[1:] != doc[:-1]])[: len(of)]
    texts_at, stems_at = np.flatnonzero(new_text), np.flatnonzero(new_stem[new_text])
    ends = np.append(texts_at, len(of)).astype(np.int32)
    groups = np.append(stems_at, len(texts_at)).astype(np.int32)
    names = list(stems)
    named = [names[k] for k in of[texts_at[stems_at]]]
    most = np.maximum.reduceat(np.diff(ends), stems_at) if len(stems_at) else np.zeros(0, np.int32)
    places = pa.ListArray.from_arrays(groups, pa.ListArray.from_arrays(ends, pa.array(place.astype(np.int32))))
    found = pa.ListArray.from_arrays(groups, ids.take(pa.array(doc[texts_at])))
    return pa.RecordBatch.from_arrays([pa.array(list(map(bucket, named)), pa.int32()), pa.array(named, pa.string()), pa.array(np.full(len(named), block)), found, places, pa.array(most, pa.int32())], ["bucket", "stem", "block", "ids", "places", "most"])


def pack(docs: DataFrame, text: str = "content", generation: int = 0) -> DataFrame:
    """(id, text) -> the rows of an index. Null texts and texts of stop words
    are in no row; ids are those of the store and so unique."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = (generation << 48) | (TaskContext.get().partitionId() << 24)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                yield _packed(piece.column(0), piece.column(1), block)
                block += 1

    cut = docs.select("id", lexical.words(text).alias("words"))
    return cut.mapInArrow(run, f"bucket int, stem string, block long, ids array<{kind}>, places array<array<int>>, most int")


def _store(rows: DataFrame, path: str, mode: str) -> Index:
    """A task of the shuffle has one bucket of the texts of sixteen tasks."""
    placed = rows.repartition("bucket", F.shiftright("block", 28)).sortWithinPartitions("bucket", "stem", "block")
    placed.write.mode(mode).partitionBy("bucket").option("parquet.block.size", 8 << 20).parquet(path)
    return load(rows.sparkSession, path)


def create(docs: DataFrame, path: str, text: str = "content") -> Index:
    """Index texts at a path; the index is what is given to a search."""
    return _store(pack(docs, text), path, "error")


def load(spark: SparkSession, path: str) -> Index:
    rows = spark.read.parquet(path)
    return Index(rows, rows.agg(F.count_distinct("block")).first()[0])


def add(docs: DataFrame, path: str, text: str = "content") -> Index:
    """Index further texts: the blocks that are there stay as they are."""
    last = docs.sparkSession.read.parquet(path).agg(F.max("block")).first()[0]
    return _store(pack(docs, text, 0 if last is None else (last >> 48) + 1), path, "append")


def _asked(index: DataFrame, query: lexical.Query) -> DataFrame:
    """The rows of a query's stems: buckets are folders, stems reach the scan."""
    return index.filter(F.col("bucket").isin(sorted({bucket(s) for s in query.stems})) & F.col("stem").isin(query.stems))


def _by_stem(columns: dict[str, str], value: str) -> list[Column]:
    return [F.expr(f"max(CASE WHEN stem = '{s}' THEN {value} END) AS {c}") for s, c in columns.items()]


def block_bounds(index: DataFrame, query: lexical.Query) -> DataFrame:
    """(block, bound) of the blocks that can hold a match, from one number a row."""
    of = {s: f"m{k}" for k, s in enumerate(query.stems)}
    most = _asked(index, query).groupBy("block").agg(*_by_stem(of, "most"))
    return most.filter(lexical.can_match(query, of)).select("block", lexical.bound(query, of).alias("bound"))


def _ranked(index: DataFrame, query: lexical.Query, blocks: DataFrame | None, universe: DataFrame | None) -> DataFrame:
    """(id, lexical) of all matches in these blocks."""
    of = {s: f"p{k}" for k, s in enumerate(query.stems)}
    rows = _asked(index, query)
    if blocks is not None:
        rows = rows.join(blocks.select("block"), "block", "left_semi")
    each = rows.select("block", "stem", F.explode(F.arrays_zip("ids", "places")).alias("text"))
    texts = each.groupBy("block", F.col("text.ids").alias("id")).agg(*_by_stem(of, "text.places"))
    if query.open_ended:
        if universe is None:
            raise ValueError("a query of what must not occur needs the texts that are asked")
        texts = universe.select("id").join(texts, "id", "left")
    return texts.filter(lexical.matches(query, of)).select("id", lexical.rank(query, of).alias("lexical"))


def match(index: DataFrame, query: str, universe: DataFrame | None = None) -> DataFrame:
    """(id, lexical), all texts that match; of the universe, where one is given."""
    q = lexical.parse_query(query)
    if not q.alternatives:
        return index.select(F.explode("ids").alias("id"), F.lit(0.0).alias("lexical")).limit(0)
    found = _ranked(index, q, None if q.open_ended else block_bounds(index, q), universe)
    return found if universe is None or q.open_ended else found.join(universe.select("id"), "id", "left_semi")


def top(index: Index, query: str, universe: DataFrame, limit: int) -> DataFrame:
    """(id, lexical), the best matches within the universe (id), by rank and
    then id: exactly those of ``match``.

    The blocks with the highest bounds are ranked first, as a subquery; of all
    others only those count whose bound reaches the last of the best there.
    """
    q = lexical.parse_query(query)
    order = (F.col("lexical").desc(), F.col("id"))
    rows = index.rows
    if not q.alternatives or q.open_ended or index.blocks <= WORTH_BOUNDS * FIRST_BLOCKS:
        return match(rows, query, universe).orderBy(*order).limit(limit)
    bounds = block_bounds(rows, q)
    seen = universe.select("id")
    first = _ranked(rows, q, bounds.orderBy(F.col("bound").desc(), "block").limit(FIRST_BLOCKS), None).join(seen, "id", "left_semi").orderBy(*order).limit(limit)
    reach = first.agg(F.coalesce(F.when(F.count("*") == limit, F.min("lexical")), F.lit(-1.0)).alias("reach"))
    found = _ranked(rows, q, bounds.filter(F.col("bound") >= reach.scalar() - 1e-12), None)
    return found.join(seen, "id", "left_semi").orderBy(*order).limit(limit)
