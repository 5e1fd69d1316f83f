"""Sharding by histogram sort: near equal bytes per shard, one exchange.

Rows are ordered by a hash of their text. Per round every partition counts the exact
bytes and rows below a list of candidate boundaries; the probes around each wanted
splitter are refined until its byte count is within tolerance or no key lies between.
Then the rows move once, to ranges that nest in the shards, and get their slots from the
counts that are already known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, fresh, trimmed

SHARDS = 16
#: Allowed distance of a splitter from its wanted byte count, as a share of a shard.
TOLERANCE = 0.002
#: Groups of equal texts above this share of a shard are placed one by one; there are at most shards / HEAVY of them.
HEAVY = 0.01
#: Probes between the bounds of a splitter in each round.
PROBES = 32
MAX_ROUNDS = 40
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def count_below(keyed: DataFrame, probes: list[int]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows with key < probe, for each of the ascending probes (keyed: key long, size long)."""
    edges = np.array(probes, np.int64)

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for b in batches:
            at = np.searchsorted(edges, b.column(0).to_numpy(zero_copy_only=False), side="right")
            np.add.at(sizes, at, b.column(1).to_numpy(zero_copy_only=False))
            rows += np.bincount(at, minlength=len(edges) + 1)
        used = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sizes[used]), pa.array(rows[used])], ["cell", "bytes", "n"])

    total = keyed.select("key", "size").mapInArrow(count, "cell long, bytes long, n long").groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    sizes, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
    for r in total.collect():  # one row per probe at most
        sizes[r["cell"]], rows[r["cell"]] = r["bytes"], r["n"]
    return np.cumsum(sizes)[:-1].tolist(), np.cumsum(rows)[:-1].tolist()


def splitters(keyed: DataFrame, wanted: list[int], total: tuple[int, int], tolerance: int, probes: int = PROBES) -> list[tuple[int, int, int]]:
    """For each wanted byte count, ascending: (key, bytes below, rows below), as near as keys allow or within tolerance."""
    low = [(_LOW, 0, 0)] * len(wanted)
    high = [(_HIGH, *total)] * len(wanted)
    for _ in range(MAX_ROUNDS):
        ask = set()
        for w, a, b in zip(wanted, low, high, strict=True):
            if min(abs(a[1] - w), abs(b[1] - w)) > tolerance and b[0] - a[0] > 1:
                step = max(1, (b[0] - a[0]) // (probes + 1))
                ask.update(range(a[0] + step, b[0], step))
        if not ask:
            break
        points = sorted(ask)
        found = list(zip(points, *count_below(keyed, points), strict=True))
        for i, w in enumerate(wanted):
            for p in found:
                if low[i][0] < p[0] < high[i][0]:
                    if p[1] <= w:
                        low[i] = p
                    else:
                        high[i] = p
                        break
    return [min(a, b, key=lambda p: (abs(p[1] - w), p[0])) for w, a, b in zip(wanted, low, high, strict=True)]


def _shares(total: int, heavy: list[int], shards: int) -> list[int]:
    """How many bytes of small groups each shard takes, so that all are as equal as the heavy ones allow."""
    rest = total - sum(heavy)
    order = sorted(range(shards), key=lambda s: heavy[s])
    give = [0] * shards
    for k in range(shards, 0, -1):  # the k lightest share the rest, if that lifts them over the k-th
        own = order[:k]
        level = (rest + sum(heavy[s] for s in own)) / k
        if level >= heavy[own[-1]]:
            for s in own:
                give[s] = max(0, round(level - heavy[s]))
            break
    return give


def shard_by_bytes(
    docs: DataFrame, *, shards: int = SHARDS, tolerance: float = TOLERANCE, heavy: float = HEAVY, text: str = "text", order: str = "doc_id"
) -> DataFrame:
    """Every row and column of docs plus size, text_crc32, law, shard, slot and grown_shard.

    Law `bytes`: sizes (UTF-8 bytes of the text plus 1; null text has none) are near
    equal over the shards while rows of equal text stay in one shard. Groups over `heavy`
    of a shard are placed first, largest first, into the lightest shard (at most shards /
    heavy of them, whatever the input); the others are split by key ranges that fill
    every shard to the same level. A group above a whole shard stays whole and the other
    shards share the rest. slot counts gapless from 0 within a shard, in the order of
    text hash and `order`; rows that agree in both get their slots in any order.
    grown_shard is null under this law. Names that docs already has get a trailing
    underscore. An empty table gives an empty one. Two texts of one 64-bit hash count as
    one group, which costs balance only. Rows move once; the rounds read a checkpoint of
    (key, size) alone.
    """
    spark = docs.sparkSession
    key, cell = fresh(docs, "shard_key"), fresh(docs, "shard_cell")
    names = {n: fresh(docs, n) for n in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")}
    body = F.coalesce(F.col(text), F.lit(""))
    size = F.octet_length(body).cast("long") + 1
    keyed = cut(docs.select(F.xxhash64(body).alias("key"), size.alias("size")))
    total, rows = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()

    level = total / shards
    groups = keyed.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where(F.col("bytes") > F.lit(heavy * level))
    big = sorted(groups.collect(), key=lambda r: (-r["bytes"], r["key"]))  # fewer than shards / heavy rows
    loads, home = [0] * shards, {}
    for r in big:
        s = min(range(shards), key=lambda s: (loads[s], s))
        loads[s] += r["bytes"]
        home[r["key"]] = s
    small = keyed.where(~F.col("key").isin(list(home))) if home else keyed
    in_small = (total - sum(r["bytes"] for r in big), rows - sum(r["n"] for r in big))

    # Ranges finer than shards, so that more tasks than shards take part; each shard has `fine` of them.
    fine = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    wanted, at = [], 0
    for s, give in enumerate(_shares(total, loads, shards)):
        wanted += [at + give * (k + 1) // fine for k in range(fine)]
        at += give
    cuts = splitters(small, wanted[:-1], in_small, max(1, int(tolerance * level)))
    discard(keyed)
    edges, below = [_LOW], [0]
    for c in cuts:
        edges.append(max(edges[-1], c[0]))
        below.append(max(below[-1], c[2]))
    ends = below[1:] + [in_small[1]]
    cells = [(i // fine, below[i] - below[i // fine * fine]) for i in range(len(edges))]
    filled = [ends[(s + 1) * fine - 1] - below[s * fine] for s in range(shards)]

    # A heavy group comes behind the small ones of its shard, split over tasks by a hash of `order`.
    chunk = max(1, rows // len(edges))
    splits = {r["key"]: -(-r["n"] // chunk) for r in big}
    heavy_first: dict[int, int] = {}
    if big:
        part = F.element_at(F.create_map(*[F.lit(x) for kv in splits.items() for x in kv]), F.col("key"))
        parts = docs.select(F.xxhash64(body).alias("key"), F.xxhash64(F.col(order)).alias("o")).where(F.col("key").isin(list(home)))
        counted = parts.groupBy("key", F.pmod("o", part).alias("part")).count().collect()  # about 2 * len(edges) + len(big) rows
        counts = {(r["key"], r["part"]): r["count"] for r in counted}
        for r in big:
            k, s = r["key"], home[r["key"]]
            heavy_first[k] = len(cells)
            for i in range(splits[k]):
                cells.append((s, filled[s]))
                filled[s] += counts.get((k, i), 0)

    keys = sorted(home)
    place = spark.sparkContext.broadcast((
        np.array(edges[1:], np.int64), np.array(keys, np.int64), np.array([heavy_first[k] for k in keys], np.int64), np.array([splits[k] for k in keys], np.int64),
        np.array([c[0] for c in cells], np.int32), np.array([c[1] for c in cells], np.int64),
    ))

    @F.pandas_udf("cell int, shard int, base long")
    def placed(keys: pd.Series, orders: pd.Series) -> pd.DataFrame:
        bounds, heavies, first, split, shard, base = place.value
        k = keys.to_numpy()
        out = np.searchsorted(bounds, k, side="right")
        if len(heavies):
            at = np.minimum(np.searchsorted(heavies, k), len(heavies) - 1)
            hit = heavies[at] == k
            out[hit] = (first[at] + np.mod(orders.to_numpy(), split[at]))[hit]
        return pd.DataFrame({"cell": out.astype(np.int32), "shard": shard[out], "base": base[out]})

    spot = fresh(docs, "shard_spot")
    moved = docs.withColumn(key, F.xxhash64(body)).withColumn(spot, placed(F.col(key), F.xxhash64(F.col(order)))).withColumn(cell, F.col(spot)["cell"])
    within = F.row_number().over(Window.partitionBy(cell).orderBy(key, order))
    return moved.select(
        *docs.columns,
        size.alias(names["size"]),
        F.crc32(F.encode(body, "UTF-8")).alias(names["text_crc32"]),
        F.lit("bytes").alias(names["law"]),
        F.col(spot)["shard"].alias(names["shard"]),
        (F.col(spot)["base"] + within - 1).alias(names["slot"]),
        F.lit(None).cast("int").alias(names["grown_shard"]),
    )
