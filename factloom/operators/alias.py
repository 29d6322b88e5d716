"""Names that mean one subject."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.staging import stored

#: Names of one automaton, and bytes of text that one is run over at once.
NAMES, BYTES = 50_000, 16 << 20


def normal_name(name: str | Column) -> Column:
    return F.lower(F.trim(F.col(name) if isinstance(name, str) else name))


def scoped(alias: DataFrame, namespace: str) -> DataFrame:
    """The names known in a namespace, or in all of its family (before the colon)."""
    family, colon, _ = namespace.partition(":")
    fits = F.startswith("namespace", F.lit(family + ":")) if colon else F.col("namespace") == namespace
    return alias.filter(fits).select("alias", "canonical").distinct()


def group(alias: DataFrame, namespace: str, name: str) -> DataFrame:
    """(name, hop): the canonical name of a name, which may be itself, and all
    its aliases. Of an alias with two canonical names the smaller counts."""
    rows = scoped(alias, namespace)
    name = name.strip().lower()
    root = rows.filter(F.col("alias") == name).agg(F.coalesce(F.min("canonical"), F.lit(name)).alias("name"))
    others = rows.join(F.broadcast(root), rows.canonical == root.name).select(F.col("alias").alias("name"), F.lit(1).alias("hop"))
    return root.select("name", F.lit(0).alias("hop")).union(others).distinct().orderBy("hop", "name")


def listing(alias: DataFrame, namespace: str | None = None) -> DataFrame:
    rows = alias if namespace is None else alias.filter(F.col("namespace") == namespace)
    return rows.orderBy("namespace", "canonical", "alias")


def expand_query(queries: DataFrame, alias: DataFrame) -> DataFrame:
    """(query_id, text) -> (query_id, canonical, names): the groups one of whose
    names is a phrase of the query. Names meet the query's own word windows by
    equality, as long as the longest name."""
    names = alias.select("canonical", F.col("alias").alias("name")).union(alias.select("canonical", "canonical")).distinct()
    words = names.withColumn("phrase", F.array_join(_words("name"), " "))
    longest = words.agg(F.coalesce(F.max(F.size(F.split("phrase", " "))), F.lit(1)).alias("n")).first().n
    tokens = queries.select("query_id", _words("text").alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1)))
    grams = F.flatten(F.transform(starts, lambda k: F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.array_join(F.slice("w", k, n), " "))))
    hit = tokens.select("query_id", F.explode(F.array_distinct(grams)).alias("phrase")).join(words, "phrase").select("query_id", "canonical").distinct()
    whole = names.groupBy("canonical").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return hit.join(whole, "canonical").select("query_id", "canonical", "names")


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def put(alias: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aliases, refused): names are lower-cased; a name that already points
    elsewhere is followed one hop; what would point at itself is refused; a
    derived mapping never replaces one made by hand; names that pointed at a
    demoted name follow it. new: one row per (namespace, alias)."""
    cols = ["namespace", "alias", "canonical", "since", "until", "origin", "created_at"]
    asked = new.select(*[normal_name(c).alias(c) if c in ("alias", "canonical") else c for c in cols if c in new.columns])
    onward = alias.select("namespace", F.col("alias").alias("canonical"), F.col("canonical").alias("_to"))
    settled = asked.join(onward, ["namespace", "canonical"], "left").withColumn("target", F.coalesce("_to", "canonical"))
    bad = (F.col("alias") == F.col("canonical")) | (F.col("target") == F.col("alias")) | (F.col("alias") == "")
    refused = settled.filter(bad).select("namespace", "alias", "canonical")
    good = settled.filter(~bad).drop("canonical", "_to").withColumnRenamed("target", "canonical").withColumn("_new", F.lit(1))
    both = alias.withColumn("_new", F.lit(0)).unionByName(good, allowMissingColumns=True)
    firm = F.when(F.col("origin") == "derived", 0).otherwise(1)
    kept = both.withColumn("_n", F.row_number().over(W.partitionBy("namespace", "alias").orderBy(firm.desc(), F.col("_new").desc()))).filter("_n = 1").drop("_n")
    moved = kept.filter("_new = 1").select("namespace", F.col("alias").alias("canonical"), F.col("canonical").alias("_follow"))
    out = kept.join(moved, ["namespace", "canonical"], "left")
    follow = F.col("_follow").isNotNull() & (F.col("_follow") != F.col("alias"))
    return out.withColumn("canonical", F.when(follow, F.col("_follow")).otherwise(F.col("canonical"))).select(*alias.columns), refused


def forget(alias: DataFrame, keys: DataFrame) -> DataFrame:
    return alias.join(keys.select("namespace", normal_name("alias").alias("alias")), ["namespace", "alias"], "left_anti")


def occurrences(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(namespace, name, id): the names of its namespace that a text holds,
    each once, as substrings in the case they have. texts: (namespace, id,
    text), names: (namespace, name).

    A namespace's names are cut into shards and its texts into parts; a task
    makes one automaton of a shard and runs it once over each text of a part,
    whatever the number of names. Null texts and names hold and are nothing;
    the empty name is in every text; ids of repeated rows are found again.
    """
    names = stored(names.filter("namespace is not null and name is not null").select("namespace", "name").distinct(), "alias-names")
    shards = names().groupBy("namespace").agg(F.ceil(F.count("*") / NAMES).cast("int").alias("shards"))
    rows = texts.filter("text is not null").select("namespace", "id", "text")
    parts = rows.groupBy("namespace").agg(F.ceil((F.sum(F.octet_length("text")) + 1) / BYTES).cast("int").alias("parts"))
    plan = stored(parts.join(shards, "namespace"), "alias-plan")
    part = F.pmod(F.xxhash64("id", "text"), F.col("parts")).cast("int")
    shard = F.pmod(F.xxhash64("name"), F.col("shards")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(plan(), "namespace").select("namespace", each("shards").alias("shard"), part.alias("part"), "id", "text")
    right = names().join(plan(), "namespace").select("namespace", shard.alias("shard"), each("parts").alias("part"), "name")

    def run(key: tuple, texts: pa.Table, names: pa.Table) -> pa.Table:
        known = names["name"].to_pylist()
        automaton = ahocorasick.Automaton()
        for n, name in enumerate(known):
            if name:
                automaton.add_word(name, n)
        everywhere = {n for n, name in enumerate(known) if not name}
        if len(automaton):
            automaton.make_automaton()
        at, found = [], []
        for i, text in enumerate(texts["text"].to_pylist()):
            hits = everywhere | ({n for _, n in automaton.iter(text)} if len(automaton) else set())
            at += [i] * len(hits)
            found += hits
        return pa.table({"namespace": pa.array([key[0].as_py()] * len(at), pa.string()), "name": pa.array([known[n] for n in found], pa.string()), "id": texts["id"].take(pa.array(np.array(at, np.int64)))})

    schema = f"namespace string, name string, id {texts.schema['id'].dataType.simpleString()}"
    keys = ["namespace", "shard", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)
