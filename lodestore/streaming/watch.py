"""Folder watching: changes between two listings, the latest change per path, and batches for ingestion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BATCH = 32
#: Spans of time within which changes are numbered independently.
SPANS = 4096


def snapshot_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change): created, modified or deleted between listings of path, length, modified_ms."""
    old = before.select(F.col("path").alias("_p"), F.col("length").alias("_l"), F.col("modified_ms").alias("_m"))
    met = now.join(old, now.path == F.col("_p"), "full_outer")
    changed = (F.col("length") != F.col("_l")) | (F.col("modified_ms") != F.col("_m"))
    change = F.when(F.col("_p").isNull(), "created").when(F.col("path").isNull(), "deleted").when(changed, "modified")
    return met.select(F.coalesce("path", "_p").alias("path"), change.alias("change")).where("change is not null")


def latest_changes(events: DataFrame) -> DataFrame:
    """The last change of each path. events: path, change, ts, and event_id for equal times."""
    last = F.max_by(F.struct("change", "ts", "event_id"), F.struct("ts", "event_id"))
    return events.groupBy("path").agg(last.alias("e")).select("path", "e.*")


def batches(changes: DataFrame, size: int = BATCH, spans: int = SPANS) -> DataFrame:
    """Changes numbered into batches of `size`, oldest first, deletions of a batch before its other changes.

    Time is cut into spans of equal length; rows are numbered within their span, behind
    the counts of the spans before it, of which there are few. Changes without a time come first.
    """
    at = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(-(1 << 62)))
    known = F.when(F.col("ts").isNotNull(), at)
    bounds = changes.agg(F.min(known).alias("_low"), F.max(known).alias("_high"))
    width = F.greatest((F.col("_high") - F.col("_low")) / spans, F.lit(1.0))
    spot = F.coalesce(F.floor((known - F.col("_low")) / width), F.lit(-1))
    timed = changes.crossJoin(F.broadcast(bounds)).withColumn("_span", spot).drop("_low", "_high")
    counts = timed.groupBy("_span").agg(F.count("*").alias("_n"))
    before = counts.select("_span", (F.sum("_n").over(Window.orderBy("_span")) - F.col("_n")).alias("_before"))  # spans + 2 rows
    own = F.row_number().over(Window.partitionBy("_span").orderBy("ts", "path"))
    numbered = timed.join(F.broadcast(before), "_span").withColumn("batch", F.floor((F.col("_before") + own - 1) / size).cast("int")).drop("_span", "_before")
    step = Window.partitionBy("batch").orderBy(F.when(F.col("change") == "deleted", 0).otherwise(1), "ts", "path")
    return numbered.withColumn("step", F.row_number().over(step))


def watch(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, *, seconds: float | None = None):
    """Start a stream that hands each micro-batch's latest changes to apply(changes, batch_id).

    Without seconds it drains what is there and stops. The checkpoint keeps its place
    over restarts; apply must be repeatable, as a batch can run again after a failure.
    """
    writer = events.writeStream.foreachBatch(lambda df, i: apply(latest_changes(df), i)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()
