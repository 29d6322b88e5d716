"""The derived graph: edges from structure, and bounded walks over it."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.predicates import Grant, linked, live, readable
from ..functions.staging import stored, written
from .alias import occurrences

# Hubs, caps and the router's thresholds.
TAG_HUB, DEGREE_CAP, FAN_OUT, SEEDS = 40, 200, 25, 10
MAX_TOP, MAX_SPREAD, SPREAD_RANK = 0.65, 0.08, 5
#: Facts of a class that meet others at once.
PART = 1024


def supersedes_edges(memory: DataFrame) -> DataFrame:
    return memory.filter("superseded_by is not null").select(F.col("id").alias("src_id"), F.col("superseded_by").alias("dst_id"), F.lit("supersedes").alias("relation"))


def alias_edges(memory: DataFrame, alias: DataFrame, hub: int | None = None) -> DataFrame:
    """A fact with an alias and one with its canonical name, in one namespace.
    An automaton over a namespace's names goes once over each fact. Facts with
    the same names are a class; classes are joined, and of two that are linked
    all members are paired, so that each pair is made once and none is
    shuffled. An id is in one namespace. A name in more facts than ``hub``, if
    that is given, links none of them; by itself every name links."""
    current = alias.filter("until is null").select("namespace", "alias", F.lower("canonical").alias("canonical")).distinct()
    names = current.select("namespace", F.col("alias").alias("name")).unionAll(current.select("namespace", "canonical"))
    hits = written(occurrences(memory.filter(linked() & F.col("id").isNotNull()).select("namespace", "id", F.lower("content").alias("text")), names), "alias-hits").distinct()
    if hub is not None:
        small = hits.groupBy("namespace", "name").agg(F.count("*").alias("n")).filter(F.col("n") <= hub)
        hits = hits.join(small.select("namespace", "name"), ["namespace", "name"])
    named = hits.groupBy("namespace", "id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    members = stored(named.select("namespace", F.sha2(F.to_json("names"), 256).alias("class"), "names", "id"), "alias-members")
    classes = stored(members().groupBy("namespace", "class").agg(F.first("names").alias("names"), F.ceil(F.count("*") / PART).cast("int").alias("parts")), "alias-classes")
    of = lambda name, end: classes().select("namespace", F.explode("names").alias(name), F.col("class").alias(end))
    linked_classes = current.join(of("alias", "x"), ["namespace", "alias"]).join(of("canonical", "y"), ["namespace", "canonical"])
    linked_classes = linked_classes.select("namespace", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    sized = classes().select("namespace", "class", "parts")
    packs = members().join(sized, ["namespace", "class"]).groupBy("namespace", "class", F.pmod(F.xxhash64("id"), "parts").alias("part")).agg(F.collect_list("id").alias("ids"))
    packs = stored(packs, "alias-packs")
    side = lambda end: packs().select("namespace", F.col("class").alias(end), F.col("part").alias(f"{end}_part"), F.col("ids").alias(f"{end}_ids"))
    units = linked_classes.join(side("x"), ["namespace", "x"]).join(side("y"), ["namespace", "y"]).filter("x <> y or x_part <= y_part")
    units = stored(units, "alias-units")()
    n = units.count()
    dealt = units.repartition(max(1, min(n, max(64, n // 16))), "namespace", "x", "x_part", "y", "y_part")
    pairs = dealt.select(((F.col("x") == F.col("y")) & (F.col("x_part") == F.col("y_part"))).alias("own"), F.explode("x_ids").alias("a"), "y_ids").select("own", "a", F.explode("y_ids").alias("b"))
    return pairs.filter("not own or a < b").select(F.least("a", "b").alias("src_id"), F.greatest("a", "b").alias("dst_id"), F.lit("shares_alias").alias("relation"))


def usable_tags(memory: DataFrame, hub: int = TAG_HUB) -> DataFrame:
    """Tags on at least two facts and no more than a hub has."""
    return memory.filter(linked()).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).filter((F.col("n") >= 2) & (F.col("n") <= hub))


def tag_edges(memory: DataFrame, hub: int = TAG_HUB) -> DataFrame:
    """Pairs that share a usable tag: at most hub ** 2 / 2 of a tag."""
    tagged = memory.filter(linked()).select("id", F.explode(F.array_distinct("tags")).alias("tag")).join(usable_tags(memory, hub).select("tag"), "tag")
    pairs = tagged.withColumnRenamed("id", "src_id").join(tagged.withColumnRenamed("id", "dst_id"), "tag").filter("src_id < dst_id")
    return pairs.select("src_id", "dst_id", F.lit("shares_tag").alias("relation")).distinct()


def rebuild_edges(memory: DataFrame, alias: DataFrame, edges: DataFrame | None = None, hub: int = TAG_HUB, alias_hub: int | None = None) -> DataFrame:
    """All edges anew: what structure produced is replaced, others stay."""
    made = supersedes_edges(memory).unionByName(alias_edges(memory, alias, alias_hub)).unionByName(tag_edges(memory, hub)).withColumn("produced_by", F.lit("structure"))
    if edges is not None:
        kept = edges.filter("produced_by <> 'structure'").select(*made.columns)
        made = kept.unionByName(made.join(kept.select("src_id", "dst_id", "relation"), ["src_id", "dst_id", "relation"], "left_anti"))
    return made


def readable_edges(edges: DataFrame, memory: DataFrame, grants: Iterable[Grant], now: datetime, history: bool = False) -> DataFrame:
    """Edges both of whose ends the caller can read."""
    seen = memory.filter(readable(grants) if history else readable(grants) & live(now)).select("id")
    one = edges.join(seen.withColumnRenamed("id", "src_id"), "src_id", "left_semi")
    return one.join(seen.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi").select("src_id", "dst_id", "relation")


def degrees(sub: DataFrame) -> DataFrame:
    ends = sub.select(F.col("src_id").alias("id")).unionAll(sub.select(F.col("dst_id").alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def expand(sub: DataFrame, frontier: Sequence, degree_cap: int = DEGREE_CAP, fan_out: int = FAN_OUT) -> DataFrame:
    """One hop out from some rows over edges that can be read: rows of too
    high a degree are not walked from, and each gives its first few."""
    ids = list(frontier)
    both = sub.filter(F.col("src_id").isin(ids)).select(F.col("src_id").alias("from_id"), F.col("dst_id").alias("to_id"), "relation")
    both = both.unionAll(sub.filter(F.col("dst_id").isin(ids)).select(F.col("dst_id").alias("from_id"), F.col("src_id").alias("to_id"), "relation"))
    small = degrees(sub).filter(F.col("id").isin(ids) & (F.col("degree") <= degree_cap)).select(F.col("id").alias("from_id"))
    order = W.partitionBy("from_id").orderBy("relation", "to_id")
    return both.join(small, "from_id", "left_semi").withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= fan_out).drop("rn")


def walk(sub: DataFrame, seeds: Sequence, hops: int = 2, degree_cap: int = DEGREE_CAP, fan_out: int = FAN_OUT) -> DataFrame:
    """(id, hop, via) of what some hops from the first ten seeds reach, seeds
    left out; what is reached twice counts once, by its first relation. A
    frontier is at most seeds * fan_out ** hop ids."""
    spark = sub.sparkSession
    seeds = list(seeds)[:SEEDS]
    seen, frontier, out = set(seeds), seeds, []
    for hop in range(1, hops + 1):
        if not frontier:
            break
        found = {}
        for r in expand(sub, frontier, degree_cap, fan_out).orderBy("from_id", "relation", "to_id").collect():
            if r.to_id not in seen and r.to_id not in found:
                found[r.to_id] = r.relation
        out += [(i, hop, via) for i, via in found.items()]
        seen |= set(found)
        frontier = list(found)
    kind = sub.schema["src_id"].dataType.simpleString()
    return spark.createDataFrame(out, f"id {kind}, hop int, via string")


def route(hits: DataFrame, names_entity: bool = False, fusion: str = "linear") -> DataFrame:
    """One row (route, top, spread, hits): a walk is worth it only where the
    best hit is weak and the field flat. hits: (score), a page."""
    order = W.orderBy(F.col("score").desc())
    ranked = hits.select("score", F.row_number().over(order).alias("n"))
    s = ranked.agg(F.count("*").alias("hits"), F.max("score").alias("top"), F.min_by("score", F.abs(F.col("n") - SPREAD_RANK) + F.when(F.col("n") > SPREAD_RANK, 1000).otherwise(0)).alias("against"))
    spread = F.greatest(F.col("top") - F.col("against"), F.lit(0.0))
    walks = F.lit(fusion == "linear" and not names_entity) & (F.col("hits") > 0) & (F.col("top") < MAX_TOP) & (spread < MAX_SPREAD)
    return s.select(F.when(walks, "walk").otherwise("search").alias("route"), F.coalesce("top", F.lit(0.0)).alias("top"), F.coalesce(spread, F.lit(0.0)).alias("spread"), "hits")
