"""Visibility, expiry and namespace predicates; all are plain column predicates that reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NAMESPACES, checked_name


def visible() -> Column:
    return F.coalesce(F.col("active"), F.lit(1)) == 1


def live(as_of_ms: int) -> Column:
    return F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of_ms))


def expiry(now_ms: Column, ttl_seconds: Column) -> Column:
    return F.when(ttl_seconds > 0, now_ms + ttl_seconds.cast("long") * 1000)


def within(**scope: str | None) -> Column:
    """Conjunction of equalities: collection and content_type where given and not empty, namespaces where not None."""
    tests = [F.lit(True)]
    for name, value in scope.items():
        if name not in (*NAMESPACES, "collection", "content_type"):
            raise ValueError(f"unknown scope {name}")
        if value is None or (value == "" and name not in NAMESPACES):
            continue
        tests.append(F.col(name) == F.lit(checked_name(value, name) if value else value))
    return reduce(lambda a, b: a & b, tests)


def is_root() -> Column:
    return F.col("memory_role").isNull() | (F.col("memory_role") == "root")


def in_family(path: str) -> Column:
    """The row of a path and its children; the path is literal, not a pattern."""
    p = F.lit(path)
    return (F.col("file_path") == p) | F.coalesce(F.col("memory_root_path") == p, F.lit(False)) | F.col("file_path").startswith(path + "::")


def in_batch(batch: str, *, other: bool = False) -> Column:
    same = F.col("index_batch_id") == F.lit(batch)
    return (F.col("index_batch_id").isNull() | ~same) if other else same


def policy(as_of_ms: int) -> Column:
    """Ranking multiplier of importance (up to 0.15) and recency (0.05 within 7 days, 0.025 within 30)."""
    weight = F.coalesce(F.least(F.greatest(F.col("importance").cast("double"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0)) * 0.15
    days = (F.lit(as_of_ms) - F.col("embedded_at")) / F.lit(86_400_000.0)
    recent = F.when((days >= 0) & (days <= 7), 0.05).when((days >= 0) & (days <= 30), 0.025).otherwise(0.0)
    return F.lit(1.0) + weight + recent
