"""Queries from files, and query vectors with a cache."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import compact, shortened
from ..sources.folder import list_folder
from ..sources.transcripts import preferred_sidecars, transcripts
from .store import Store

# Bytes of a text file that a query reads, and characters that it keeps; bytes in which a zero marks a binary file.
MAX_READ, MAX_TEXT, HEAD = 64 * 1024, 4000, 2048


def file_queries(spark: SparkSession, folder: str, **listing) -> DataFrame:
    """The files of a folder as queries: rel_path, kind (text, image, video), query and error.

    Text files give their words, audio files those of their preferred transcript beside
    them, images and videos nothing but their path (a vector comes from a model). Words are
    compacted to 4000 characters. error says why a file gives no query.
    """
    files = list_folder(spark, folder, **listing)
    sidecar = F.lower("rel_path").rlike(r"(\.transcript\.json|\.srt|\.vtt)$")

    @F.pandas_udf("string")
    def opened(data: pd.Series) -> pd.Series:
        return data.map(lambda b: bytes(b or b"").decode("utf-8", "replace"))

    head = F.substring(F.col("content"), 1, MAX_READ)
    binary = F.hex(F.substring(head, 1, HEAD)).rlike("^(?:..)*00")
    text = files.where((F.col("content_type") == "text") & ~sidecar).withColumn("query", F.when(~binary, shortened(compact(opened(head)), MAX_TEXT)))
    text = text.select("rel_path", F.lit("text").alias("kind"), "query", F.when(binary, "binary").when(F.col("query") == "", "no text").alias("error"))

    stem = lambda c: F.regexp_replace(c, r"(?i)(\.transcript\.json|\.[^./]+)$", "")
    beside = preferred_sidecars(files.select(F.col("rel_path").alias("path"), opened(F.col("content")).alias("text")))
    said = transcripts(beside).groupBy(stem(F.col("path")).alias("stem")).agg(F.array_sort(F.collect_list(F.struct("seq", "segment"))).alias("s"))
    said = said.select("stem", shortened(compact(F.array_join(F.transform("s", lambda x: x["segment"]), " ")), MAX_TEXT).alias("query"))
    audio = files.where("content_type = 'audio'").withColumn("stem", stem(F.col("rel_path"))).join(said, "stem", "left")
    audio = audio.select("rel_path", F.lit("text").alias("kind"), "query", F.when(F.coalesce("query", F.lit("")) == "", "no transcript").alias("error"))

    media = files.where(F.col("content_type").isin("image", "video")).select("rel_path", F.col("content_type").alias("kind"), F.lit(None).cast("string").alias("query"), F.lit(None).cast("string").alias("error"))
    return text.unionByName(audio).unionByName(media)


def vector_key(query: Column, model: str, index_version: int, namespace: str = "", kind: str = "text") -> Column:
    """Key of a query's vector: a SHA-256 of what it depends on."""
    parts = F.struct(query.alias("data"), F.lit(str(index_version)).alias("index_version"), F.lit(model).alias("model"), F.lit(namespace).alias("namespace"), F.lit(kind).alias("type"))
    return F.sha2(F.to_json(parts), 256)


def embedded_queries(
    store: Store, queries: DataFrame, embed: Callable[[Column], Column], *, model: str, now_ms: int, namespace: str = "", index_version: int = 0, most: int | None = None
) -> DataFrame:
    """queries (query_id, query) with vector: from the store's cache, else by embed, each distinct query once; new ones enter the cache.

    The key holds model, namespace and index_version, so a vector made under another is never
    found. Null queries have no vector. With `most`, what the call uses is stamped with
    now_ms, and beyond `most` vectors those used longest ago leave in the same write.
    """
    keyed = queries.withColumn("key", F.when(F.col("query").isNotNull(), vector_key(F.col("query"), model, index_version, namespace)))
    known = store.table("cache").select("key", "value", "created_at")
    asked = keyed.where("key is not null").dropDuplicates(["key"])
    missing = asked.join(known, "key", "left_anti")
    made = missing.select("key", F.to_json(embed(F.col("query")).cast("array<float>")).alias("value"), F.lit(now_ms).cast("long").alias("created_at"))
    if most is not None:
        if not asked.isEmpty():
            store.remember(made.unionByName(known.join(asked.select("key"), "key", "left_semi")), now_ms=now_ms, most=most)
    elif not missing.isEmpty():
        store.upsert({"cache": made})
    found = keyed.join(store.table("cache").select("key", "value"), "key", "left")
    return found.select(*queries.columns, F.from_json("value", "array<float>").alias("vector"))


class VectorCache:
    """Vectors of single queries on the driver, the least recently used ones dropped beyond `most`."""

    def __init__(self, most: int = 256):
        self.most, self.hits, self.misses = most, 0, 0
        self._held: OrderedDict[str, list[float]] = OrderedDict()

    def get(self, key: str, make: Callable[[], list[float]]) -> list[float]:
        """The vector of a key, made if it is not held."""
        if key in self._held:
            self.hits += 1
            self._held.move_to_end(key)
            return self._held[key]
        self.misses += 1
        self._held[key] = vector = make()
        if len(self._held) > self.most:
            self._held.popitem(last=False)
        return vector

    def stats(self) -> dict[str, int]:
        return {"size": len(self._held), "most": self.most, "hits": self.hits, "misses": self.misses}


def embedder(model) -> Callable[[Column], Column]:
    """A text column to a vector column by any object that has embed_texts(list) or embed_text(str), or by a plain function of a text."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        given = texts.fillna("").tolist()
        if hasattr(model, "embed_texts"):
            made = model.embed_texts(given)
        else:
            one = getattr(model, "embed_text", model)
            made = [one(t) for t in given]
        return pd.Series([list(map(float, v)) for v in made])

    return run
