"""Connected components as DataFrame joins: alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

#: Rows of a small table to a partition. So few edges are united in one step: rounds of exchanges would be empty tasks and their records.
FEW = 1 << 15


def snug(df: DataFrame) -> tuple[DataFrame, int]:
    """A checkpoint in a partition per FEW rows, as far as it has so many, and its number of rows."""
    n = df.coalesce(16).count()
    return df.coalesce(n // FEW + 1), n


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of the edges (u, v) of one partition."""
    parent: dict = {}

    def find(x):
        while (y := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[y]
        return x

    kind = pa.int64()
    for b in batches:
        kind = b.column(0).type
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(u), find(v)
            parent[max(x, y)] = min(x, y)
    if parent:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(list(map(find, nodes)), kind)], ["node", "component"])


def _settled(edges: DataFrame) -> bool:
    """Whether edges (u, v) form stars: each u has one v, and no v is a u. One pre-aggregated pass."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("c")), F.struct(F.col("v").alias("n"), F.lit(0).alias("c")))).alias("e"))
    nodes = ends.groupBy("e.n").agg(F.sum("e.c").alias("out"), F.min("e.c").alias("least"))
    return nodes.where("out > 1 or (out > 0 and least = 0)").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Component of every node that has an edge.

    edges: two columns of one orderable type. Null ends, self loops and repeated edges
    are ignored. Returns (node, component): component is the smallest node reachable,
    each node once; nodes without an edge are absent, so empty edges give an empty
    table. Every round is a few hash aggregations (partial on the map side) and
    equi-joins, whose hot keys AQE can split; the edge set is checkpointed per round, the
    last one's deleted, and never reaches the driver. Rounds end when the edges form stars.
    Up to FEW edges between numbers need no rounds: one task unites them.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    now = cut(
        pairs.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    edges, n = snug(now)
    if n < FEW and (kind := now.schema["u"].dataType.simpleString()) in ("int", "bigint"):
        return cut(edges.mapInArrow(_united, f"node {kind}, component {kind}"))
    for _ in range(max_rounds):
        if _settled(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        turned = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        was, now = now, cut(turned.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        discard(was)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
