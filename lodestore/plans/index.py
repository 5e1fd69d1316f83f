"""Search tables: chunks with their length, and postings sorted by term; of a corpus written once, of a store a segment per layer."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from contextlib import suppress
from dataclasses import dataclass
from functools import cache
from hashlib import sha256
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.entities import mentions
from ..operators import pruned
from ..operators.filters import visible
from ..operators.retrieval import MAX_BROADCAST_BYTES, keyed, postings, small
from ..schema import TABLES
from .search import searchable
from .store import Store
from .tables import AS_OF_MS, importance, memory_chunks

_OPEN: dict[tuple[str, str], Index] = {}
_BLOCKS: dict[tuple[str, str], pruned.BlockIndex] = {}
_CELLS: dict[tuple[str, str], pruned.CellIndex] = {}
_MENTIONED: dict[tuple[str, str], DataFrame] = {}


@dataclass(frozen=True)
class Index:
    """chunks: as memory_chunks, with keys (see retrieval.keyed) and chars. postings: term, chunk_id, len, tf of all of them, hidden and expired ones too."""

    chunks: DataFrame
    postings: DataFrame


@cache
def _temporary() -> str:
    folder = tempfile.mkdtemp(prefix="lodestore-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; on one machine a temporary folder, deleted at exit, stands in where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _temporary()


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted as this process exits."""
    folder = f"{shared_folder(spark)}/{name}-{uuid4().hex}"
    place, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder), spark.sparkContext._jsc.hadoopConfiguration()

    def gone() -> None:
        with suppress(Exception):  # the JVM may have ended before
            place.getFileSystem(conf).delete(place, True)

    atexit.register(gone)
    return folder


def written(spark: SparkSession, chunks: DataFrame, folder: str) -> Index:
    """Write the two tables of chunks under a folder and read them back."""
    keyed(chunks).withColumn("chars", F.length("text_body")).write.parquet(f"{folder}/chunks")
    kept = spark.read.parquet(f"{folder}/chunks")
    # Each task sorts the postings of the chunks that it reads, so that row groups hold ranges of terms.
    postings(kept).select("term", "chunk_id", "len", "tf").sortWithinPartitions("term").write.parquet(f"{folder}/postings")
    return Index(kept, spark.read.parquet(f"{folder}/postings"))


def _state(spark: SparkSession, sf_dir: str) -> str:
    """Names, sizes and times of the files that the chunks are made of: a changed table is indexed anew."""
    said = []
    for name in ("documents", "labels", "embeddings"):
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        said += [f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in fs.listStatus(place)]
    return sha256("\n".join(sorted(said)).encode()).hexdigest()


def opened(spark: SparkSession, sf_dir: str) -> Index:
    """The index of a folder of tables, written at the first call of an application."""
    key = (spark.sparkContext.applicationId, _state(spark, sf_dir))
    if key not in _OPEN:
        _OPEN[key] = written(spark, memory_chunks(spark, sf_dir), own_folder(spark, "index"))
    return _OPEN[key]


def block_view(spark: SparkSession, sf_dir: str) -> pruned.BlockIndex:
    """Posting blocks of a folder of tables: its searchable chunks at the fixed time, written at the first call of an application. Texts and postings are written nowhere else."""
    key = (spark.sparkContext.applicationId, _state(spark, sf_dir))
    if key not in _BLOCKS:
        # Importance is broadcast up to MAX_BROADCAST_BYTES, so that texts enter no exchange.
        rows = searchable(memory_chunks(spark, sf_dir, vectors=False).drop("importance"), AS_OF_MS)
        rows = rows.join(small(importance(spark, sf_dir), rows=MAX_BROADCAST_BYTES), "doc_id", "left")
        _BLOCKS[key] = pruned.write_blocks(spark, rows, None, own_folder(spark, "blocks"), as_of_ms=AS_OF_MS)
    return _BLOCKS[key]


def cell_view(spark: SparkSession, sf_dir: str) -> pruned.CellIndex:
    """Vector cells of the same chunks, written at the first call of an application; no text and no posting is."""
    key = (spark.sparkContext.applicationId, _state(spark, sf_dir))
    if key not in _CELLS:
        _CELLS[key] = pruned.write_cells(spark, searchable(memory_chunks(spark, sf_dir), AS_OF_MS), own_folder(spark, "cells"), as_of_ms=AS_OF_MS)
    return _CELLS[key]


def views(spark: SparkSession, sf_dir: str) -> tuple[pruned.BlockIndex, pruned.CellIndex]:
    """What pruned searches read of a folder of tables."""
    return block_view(spark, sf_dir), cell_view(spark, sf_dir)


def mentioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity mentions of the visible memories of a folder of tables, written at the first call of an application; hash_seq tells equal texts at two paths apart."""
    key = (spark.sparkContext.applicationId, _state(spark, sf_dir))
    if key not in _MENTIONED:
        rows = memory_chunks(spark, sf_dir, vectors=False).where(visible())
        rows = rows.select(F.concat_ws("|", "hash_seq", "file_path").alias("hash_seq"), "memory_id", F.col("memory_root_path").alias("path"), "file_path", "text_body")
        folder = own_folder(spark, "mentions")
        mentions(rows).write.parquet(folder)
        _MENTIONED[key] = spark.read.parquet(folder)
    return _MENTIONED[key]


SEGMENT = "term string, chunk_id string, len int, tf long"


def segments(store: Store) -> dict[str, str]:
    """The folder of postings of every layer of chunks that the store's newest version names; those that are not there yet are written, in one job.

    A layer never changes, so its postings don't either: a write costs the postings of
    its own layer. Postings of rows that delete vectors name stay; they meet no chunk, as
    every layer's rows have keys of their own. Layers that fold() merges become one segment.
    """
    spark, jvm = store.spark, store.spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(store.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    layers = [y["place"] for x in store.manifest()["tables"].get("embeddings", {}).values() for y in x["layers"]]
    named = {p: sha256(p.encode()).hexdigest()[:32] for p in layers}
    folder = path(f"{store.root}/index")
    there = {x.getPath().getName() for x in fs.listStatus(folder)} if fs.exists(folder) else set()
    missing = {p: n for p, n in named.items() if n not in there}
    if missing:
        side = f"{store.root}/index/.{uuid4().hex}"
        rows = spark.read.schema(TABLES["embeddings"]).parquet(*[f"{store.root}/{p}" for p in missing]).select("*", F.substring_index("_metadata.file_path", "/", -3).alias("_place"))
        names = spark.createDataFrame([("/".join(p.split("/")[-2:]), n) for p, n in missing.items()], "_folder string, _segment string")
        # Folders of parts are escaped in paths, once more in the paths that rows tell.
        own = F.substring_index("_place", "/", 2)
        rows = rows.join(F.broadcast(names), F.url_decode(F.regexp_replace(own, r"\+", "%2B")) == F.col("_folder"))
        posted = postings(rows, _segment=F.col("_segment")).select("term", "chunk_id", F.col("len").cast("int").alias("len"), "tf", "_segment")
        # By the tasks that read the layers: few chunks to a file, whose ids Parquet then keeps as short numbers.
        posted.sortWithinPartitions("_segment", "term").write.partitionBy("_segment").parquet(side)
        for n in missing.values():
            made, target = path(f"{side}/_segment={n}"), path(f"{store.root}/index/{n}")
            if fs.exists(made):
                fs.rename(made, target)  # another searcher may have been first: then it is as good
            else:
                fs.mkdirs(target)  # a layer without words
        fs.delete(path(side), True)
    return {p: f"{store.root}/index/{n}" for p, n in named.items()}


def of_store(store: Store) -> Index:
    """The index of a store's newest version: its chunks, and the postings of their layers, which are written at the first search after a write."""
    spark = store.spark
    places = sorted(segments(store).values())
    posted = spark.read.schema(SEGMENT).parquet(*places) if places else spark.createDataFrame([], SEGMENT)
    return Index(store.table("embeddings"), posted)


def sweep(store: Store) -> int:
    """Delete segments of layers that the newest version does not name; returns how many went."""
    path = store.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(store.root).getFileSystem(store.spark.sparkContext._jsc.hadoopConfiguration())
    folder = path(f"{store.root}/index")
    live = {sha256(y["place"].encode()).hexdigest()[:32] for x in store.manifest()["tables"].get("embeddings", {}).values() for y in x["layers"]}
    return sum(fs.delete(x.getPath(), True) for x in (fs.listStatus(folder) if fs.exists(folder) else []) if x.getPath().getName() not in live)
