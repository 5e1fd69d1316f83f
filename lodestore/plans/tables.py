"""Memories over the supplied tables: documents in families of four, with deterministic policy columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from ..functions import text as tx
from ..operators.retrieval import keyed

#: Fixed point in time that queries judge age and expiry by (2024-02-01 UTC).
AS_OF_MS = 1_706_745_600_000
DAY_MS = 86_400_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("float").alias("importance"))


def memory_chunks(spark: SparkSession, sf_dir: str, *, vectors: bool = True) -> DataFrame:
    """One chunk per document, with its keys and length: a family of four ids is one memory, its first document the root."""
    docs = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    family = F.floor(i / 4)
    root = F.concat(F.lit("doc/"), (family * 4).cast("string"))
    path = F.when(i % 4 == 0, root).otherwise(identity.child_path(root, "section", i % 4))
    text = F.coalesce("text", F.lit(""))
    kind = F.when(i % 10 == 7, "image").when(i % 10 == 8, "video").otherwise("text")
    expires = F.when(i % 11 == 0, F.lit(AS_OF_MS - DAY_MS)).when(i % 11 == 1, F.lit(AS_OF_MS + DAY_MS))
    # What texts tell is found where they are read, so that the joins move them only to who asks for them.
    rows = docs.select(
        "doc_id", path.alias("file_path"), root.alias("memory_root_path"), F.concat(F.lit("c"), (family % 5).cast("string")).alias("collection"),
        F.concat(F.lit("u"), (family % 3).cast("string")).alias("user_id"), F.lit(None).cast("string").alias("session_id"),
        F.when(family % 2 == 0, F.concat(F.lit("p"), (family % 4).cast("string"))).alias("project_id"), F.lit(None).cast("string").alias("profile"),
        text.alias("text_body"), kind.alias("content_type"), "lang", "source",
        F.when(i % 13 == 0, 0).otherwise(1).cast("byte").alias("active"), expires.cast("long").alias("expires_at"),
        (F.lit(AS_OF_MS) - (i % 60) * F.lit(DAY_MS)).alias("embedded_at"), F.lit(0).alias("seq"), F.lit(0).alias("pos"),
        F.array(F.lower("lang"), F.concat(F.lit(" Src "), "source"), F.lit("")).alias("tags"), F.length(text).alias("chars"),
    )
    rows = rows.withColumns({
        "content_hash": identity.content_hash(F.col("text_body")),
        "title": tx.title(F.col("text_body"), F.col("file_path")),
        "memory_role": identity.role(F.col("file_path"), F.col("memory_root_path")),
        "memory_id": identity.memory_id(*[F.col(c) for c in ("collection", "user_id", "session_id", "project_id", "profile", "memory_root_path")]),
    })
    # As in a store: equal texts at two paths have one hash_seq, and are told apart by their file_key.
    rows = keyed(rows.withColumn("hash_seq", identity.hash_seq(F.col("content_hash"), F.col("seq"))))
    rows = rows.join(importance(spark, sf_dir), "doc_id", "left")
    if not vectors:
        return rows
    vecs = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return rows.join(vecs, "doc_id", "left")


def search_queries(spark: SparkSession, sf_dir: str, every: int = 20) -> DataFrame:
    """query_id, query, vector, weight: benchmark texts whose id is divisible by `every`, each with the vector of its id."""
    items = read(spark, sf_dir, "benchmark").where(F.col("item_id") % every == 0).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    vecs = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return items.join(vecs, "query_id", "left").withColumn("weight", F.lit(1.0) + (F.col("query_id") % 3) * 0.5)
