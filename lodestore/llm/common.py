"""Helpers shared by the corpus operators: table access, lineage cuts, Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import wraps
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from zstandard import compress, decompress

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Rows of an Arrow batch in the steps of an operator.
ARROW_ROWS = 2000
#: Counts travel as compressed arrays of 2 ** CHUNK_BITS buckets.
CHUNK_BITS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; on one machine (tests) a folder in the warehouse stands in where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives lost executors and is computed once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def discard(df: DataFrame) -> None:
    """Delete the files of a checkpoint that cut() made and that no later plan reads."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        place = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file.get())
        place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class Stage:
    """Parquet tables of one call, in a folder of its own under the shared checkpoint folder; dropped by name or all together."""

    def __init__(self, spark: SparkSession, name: str):
        ensure_checkpoint_dir(spark)
        self.spark, self.folder = spark, f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """df as a written table: survives lost executors, and later plans read only the columns they need."""
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, name: str | None = None) -> None:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder if name is None else f"{self.folder}/{name}")
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def trimmed(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """f over the batches of a task; as it ends, the worker hands freed memory back."""

    @wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        trim_memory()

    return run


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Actions on DataFrames made inside drop their shuffle files as they end; their results are tables or checkpoints.

    Their Arrow batches have ARROW_ROWS rows, so that few texts are held at once.
    """
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": str(ARROW_ROWS)}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def trim_memory() -> None:
    """Hand freed memory back to the system: workers outlive their tasks, and large arrays leave holes."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def drops_shuffles(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f(df, ...), whose steps are checkpoints or tables, with their shuffle files dropped as each ends; its result is planned anew outside."""

    @wraps(f)
    def run(df: DataFrame, *args, **options) -> DataFrame:
        with shuffles_dropped(df.sparkSession):
            out = f(df, *args, **options)
        return out.select("*")

    return run


def fresh(df: DataFrame, base: str) -> str:
    """A column name that clashes with none of df's (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; lower() would also change other scripts."""
    return F.translate(col, UPPER, LOWER)


def batches_of(batches: Iterable[pa.RecordBatch], max_bytes: int = 8 << 20) -> Iterable[pa.RecordBatch]:
    """Cut Arrow batches further where their rows are long, so that Python holds few bytes at once."""
    for b in batches:
        rows = b.num_rows
        if not rows:
            continue
        step = max(1, min(rows, rows * max_bytes // max(1, b.nbytes)))
        for at in range(0, rows, step):
            yield b.slice(at, step)


def packed(chunk: int, arrays: list[np.ndarray]) -> tuple:
    """(chunk, blob per array): counts in the narrowest unsigned type that holds them, compressed behind a byte that names its size."""
    out = []
    for x in arrays:
        kind = np.min_scalar_type(int(x.max(initial=0)))
        out.append(bytes([kind.itemsize]) + compress(x.astype(kind).tobytes(), 3))
    return (chunk, *out)


def unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(decompress(blob[1:]), f"u{blob[0]}").astype(np.int64)
