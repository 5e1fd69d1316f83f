"""Co-mention edges and related memories over entity mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import graph_id
from .bounded import firsts

MAX_ENDS, MAX_PAIRS, SHOWN = 12, 48, 5


def co_mentions(mentions: DataFrame, *, key: str = "hash_seq", max_ends: int = MAX_ENDS, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Edges between the first entities of each chunk: subject, object, the longer evidence, id.

    At most max_ends entities of a chunk take part, so a chunk gives max_ends * (max_ends - 1) / 2 rows at most.
    """
    first = mentions.where(F.col("ord") <= max_ends)
    item = F.struct("ord", "entity_key", "name", "evidence")
    grouped = first.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("all"))
    left = grouped.select(key, "all", F.explode("all").alias("l"))
    pairs = left.select(key, "l", F.explode(F.filter("all", lambda r: r["ord"] > F.col("l.ord"))).alias("r"))
    w = Window.partitionBy(key).orderBy("l.ord", "r.ord")
    pairs = pairs.withColumn("pair", F.row_number().over(w)).where(F.col("pair") <= max_pairs)
    longer = F.when(F.length("l.evidence") >= F.length("r.evidence"), F.col("l.evidence")).otherwise(F.col("r.evidence"))
    return pairs.select(
        key, F.col("l.entity_key").alias("subject_key"), F.col("l.name").alias("subject_name"), F.col("r.entity_key").alias("object_key"),
        F.col("r.name").alias("object_name"), F.lit("co_mentions").alias("relation_type"), longer.alias("evidence"), "pair",
        graph_id(F.col(key), F.col("l.entity_key"), F.col("r.entity_key")).alias("id"),
    )


def related_memories(mentions: DataFrame, seeds: DataFrame, limit: int = 20) -> DataFrame:
    """Memories that share entities with seed memories: score 10 per shared entity plus mentions.

    mentions: memory_id, path, file_path, entity_key, name, evidence. seeds: memory_id. Ties go to the smaller path.
    Evidence is gathered for the memories of the result only, five places each, of which a
    task sends five at most; mentions without a memory or a path are no result.
    """
    known = seeds.select("memory_id").distinct()
    keys = mentions.join(known, "memory_id", "left_semi").select("entity_key").distinct()
    others = mentions.join(keys, "entity_key", "left_semi").join(known, "memory_id", "left_anti")
    scored = others.groupBy("memory_id", "path").agg((F.countDistinct("entity_key") * 10 + F.count("*")).alias("score"))
    best = F.broadcast(scored.orderBy(F.desc("score"), "path", "memory_id").limit(max(1, min(limit, 200))))
    theirs = others.join(best, ["memory_id", "path"])
    shared = theirs.groupBy("memory_id", "path", "score").agg(F.array_sort(F.collect_set("entity_key")).alias("shared_entities"))
    told = firsts(theirs.select("memory_id", "path", F.struct("file_path", "entity_key", "name", "evidence").alias("e")), ["memory_id", "path"], ["e"], SHOWN)
    told = told.groupBy("memory_id", "path").agg(F.array_sort(F.collect_list("e")).alias("evidence"))
    return shared.join(told, ["memory_id", "path"]).orderBy(F.desc("score"), "path", "memory_id")


def list_entities(mentions: DataFrame, limit: int = 100) -> DataFrame:
    """The first mentions by name whatever its case, then by path and place; files of one memory by exact name and key."""
    return mentions.orderBy(F.lower("name"), "path", "ord", "name", "entity_key").limit(max(1, min(limit, 5000)))
