"""A watched folder applied to the store: listing, difference, batches, deletions, ingestion."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folder import list_folder, routed
from ..streaming.watch import latest_changes, snapshot_diff
from .ingest import SIDECAR, folder_texts, stem
from .store import Store

#: Changed files that are read by name; more are read with their folder.
MAX_NAMED = 10_000
LISTING = "path string, length long, modified_ms long"


def _state(store: Store, folder: str) -> str:
    return f"watch:{sha256(folder.encode()).hexdigest()}"


def last_listing(store: Store, folder: str) -> DataFrame:
    """The listing that the last scan of a folder left in the store; empty before the first."""
    places = [r.value for r in store.cached(store.spark.createDataFrame([(_state(store, folder),)], "key string")).collect() if r.value]
    return store.spark.read.schema(LISTING).parquet(places[0]) if places else store.spark.createDataFrame([], LISTING)


def _read(store: Store, folder: str, now: DataFrame, changed: DataFrame, **listing) -> tuple[DataFrame, DataFrame]:
    """The changed files that are there, with content, and the paths that they stand for: a changed transcript also brings the media beside it, and media bring their transcripts.

    Only these files are read: by name up to MAX_NAMED of them, beyond that with their folder.
    """
    spark = store.spark
    stems = now.select(F.col("rel_path").alias("path"), "content_type", stem(F.col("rel_path")).alias("_stem"))
    side = F.col("path").rlike(SIDECAR)
    turned = changed.select("path").where(side).select(stem(F.col("path")).alias("_stem")).distinct()
    media = stems.where(F.col("content_type").isin("video", "audio"))
    owners = media.join(turned, "_stem", "left_semi").select("path")
    fresh = changed.select("path").unionByName(owners).distinct()
    beside = stems.where(side).join(media.join(fresh, "path", "left_semi").select("_stem").distinct(), "_stem", "left_semi").select("path")
    wanted = now.select(F.col("rel_path").alias("path")).join(fresh.unionByName(beside).distinct(), "path", "left_semi")
    names = [r.path for r in wanted.limit(MAX_NAMED + 1).collect()]
    if not names:
        return now.where("false").withColumns({"content": F.lit(None).cast("binary"), "status": F.lit("")}), fresh
    options = {k: v for k, v in listing.items() if k == "recursive"}
    files = list_folder(spark, folder, only=names) if len(names) <= MAX_NAMED else list_folder(spark, folder, **options).join(wanted.withColumnRenamed("path", "rel_path"), "rel_path", "left_semi")
    return routed(files), fresh


def apply_changes(store: Store, changes: DataFrame, folder: str, collection: str, *, now_ms: int, embed=None, caption=None, now: DataFrame | None = None, **listing) -> dict[str, int]:
    """Apply the latest change of each path (path, change) to the store, in one version: what the paths and their children held leaves, their present files are ingested.

    Files of every kind count (see ingest.folder_texts). A file that yields no text any
    more, binary or too large, loses its chunks as a deleted one does. A change can be
    applied again without another effect.
    """
    now = list_folder(store.spark, folder, content=False, **listing) if now is None else now
    changes = changes.select("path", "change").where("path is not null")
    files, fresh = _read(store, folder, now, changes, **listing)
    # The texts of changed files only: a transcript that was read for its media is no change of its own.
    texts = folder_texts(files, collection, caption=caption).join(fresh.withColumnRenamed("path", "memory_root_path"), "memory_root_path", "left_semi")
    deleted = changes.where("change = 'deleted'").count()
    with store.aside(texts, fresh) as (texts, fresh):  # files are read once
        written = texts.agg(F.countDistinct("memory_root_path")).first()[0]
        if written:
            store.upsert_memory(texts, now_ms=now_ms, embed=embed, families=fresh, collection=collection)
        elif not changes.isEmpty():
            store.delete_paths(fresh, collection)
    return {"deleted": deleted, "written": written}


def scan(store: Store, folder: str, collection: str, *, now_ms: int, embed=None, caption=None, progress: Callable[[str], None] = lambda step: None, **listing) -> dict[str, int]:
    """One scan of a folder: what changed since the last one is applied, then the new listing is kept in the store.

    progress is told each step (listed, applied, kept) as it ends.
    """
    spark = store.spark
    files = list_folder(spark, folder, content=False, **listing)
    place = f"{store.root}/watch/{_state(store, folder).partition(':')[2]}-{now_ms}"
    files.select(F.col("rel_path").alias("path"), "length", "modified_ms").write.mode("overwrite").parquet(place)
    progress("listed")
    now = spark.read.schema(LISTING).parquet(place)
    done = apply_changes(store, snapshot_diff(last_listing(store, folder), now), folder, collection, now_ms=now_ms, embed=embed, caption=caption, now=files, **listing)
    progress("applied")
    store.upsert({"cache": spark.createDataFrame([(_state(store, folder), place, now_ms)], "key string, value string, created_at long")})
    progress("kept")
    return done


def follow(store: Store, events: DataFrame, folder: str, collection: str, checkpoint: str, *, now_ms: int, embed=None, caption=None):
    """A stream of change events (path, change, ts, event_id) applied batch by batch with the folder's present files; drains what is there."""
    from ..streaming.watch import watch

    def apply(changes: DataFrame, _: int) -> None:
        apply_changes(store, latest_changes(changes), folder, collection, now_ms=now_ms, embed=embed, caption=caption)

    return watch(events, apply, checkpoint)
