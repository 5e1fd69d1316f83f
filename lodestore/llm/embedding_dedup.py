"""Embedding near-dedup: an exact metric range join over pivot cells.

The angle between vectors is a metric. Every vector belongs to the cell of its nearest
pivot. If y of cell q lies within e of x of cell p, the triangle inequality gives
d(x, q) <= d(x, p) + 2 e and d(x, q) <= radius(q) + e; x is copied to exactly the cells
for which both hold. Each pair then meets in one cell, and cells join independently.
Within a cell, blocks are rings around its pivot: as |d(x, p) - d(y, p)| <= d(x, y), only
blocks whose rings come within e of each other are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drops_shuffles, trimmed
from .components import connected_components

THRESHOLD = 0.9
#: There are as many pivots as the root of the vectors over this: 4 for 2,000 vectors, 22 for 50,000 (2,300 to a cell), 3,162 for a billion.
#: Where bounds exclude nothing, a vector is copied to half of the cells, so more pivots would copy more than they part.
PER_PIVOT = 100
#: Bounds what is broadcast; larger cells are parted into more ring blocks.
MAX_PIVOTS = 4096
#: Rows of a cell that one task compares with as many others.
BLOCK = 8192
#: Rings of equal width around a pivot; a block is some of them, or part of one.
RINGS = 32
_TILE = 512
#: Slack of the angle bounds against rounding; it can only copy more.
ROUNDING = 1e-6


def _units(column: pa.Array, width: int) -> np.ndarray:
    """Unit rows in double precision; shorter vectors have zeros behind."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) and (lengths == width).all():
        out = flat.reshape(len(column), width).copy()
    else:
        out = np.zeros((len(column), width))
        at = 0
        for i, n in enumerate(lengths):
            out[i, :n] = flat[at : at + n]
            at += n
    out /= np.abs(out).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1, 1))


def linked(one: np.ndarray, two: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix of the unit rows at cosine >= threshold in double precision.

    Products are taken in single precision; those nearer to the threshold than its error
    are taken again in double.
    """
    margin = 1e-6 + one.shape[1] * 2.5e-7
    a, b = one.astype(np.float32), two.astype(np.float32)
    out = np.zeros((len(a), len(b)), bool)
    for at in range(0, len(a), 512):
        g = a[at : at + 512] @ b.T
        out[at : at + 512] = g >= threshold + margin
        row, col = np.nonzero(np.abs(g - np.float32(threshold)) <= 2 * margin)
        for k in range(0, len(row), 50_000):
            r, c = row[k : k + 50_000], col[k : k + 50_000]
            out[at + r, c] = np.einsum("ij,ij->i", one[at + r], two[c]) >= threshold
    return out


def _join_block(table: pa.Table, width: int, threshold: float) -> pa.Table:
    """Links between the two blocks of a group, or within its one block: per row the weighted count of partners and edges to smaller rows.

    Rows are taken in tiles. Within a tile the smallest position spreads along the links
    until nothing changes; where a row's label changes, old and new label form an edge, so
    the edges span what the links do. No more than a tile of the matrix is held.
    """
    order = np.argsort(table["uid"].to_numpy())  # so that the smallest position is the smallest id
    table = table.take(pa.array(order)).combine_chunks()
    uid, copies, side = table["uid"].to_numpy(), table["copies"].to_numpy(), table["side"].to_numpy()
    units, n = _units(table["embedding"].chunk(0), width), len(order)
    alone = table["low"][0] == table["high"][0]
    a, b = (np.arange(n), np.arange(n)) if alone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    links, label = np.zeros(n, np.int64), np.arange(n, dtype=np.int32)
    turned = [np.zeros((0, 2), np.int32)]
    for at in range(0, len(a), _TILE):
        rows = a[at : at + _TILE]
        near = linked(units[rows], units[b], threshold)
        if alone:
            near[np.arange(len(rows)), rows] = False
        r, c = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if not len(r):
            continue
        near, r, c = near[np.ix_(r, c)], rows[r], b[c]
        links[r] += np.where(near, copies[c][None, :], 0).sum(axis=1)
        if not alone:
            links[c] += np.where(near, copies[r][:, None], 0).sum(axis=0)
        while True:
            ends = np.concatenate([r, c])
            was = label[ends]
            np.minimum.at(label, r, np.where(near, label[c][None, :], n).min(axis=1).astype(np.int32))
            np.minimum.at(label, c, np.where(near, label[r][:, None], n).min(axis=0).astype(np.int32))
            new = label[ends] != was
            if not new.any():
                break
            turned.append(np.unique(np.column_stack([was[new], label[ends][new]]), axis=0))
    hit, pairs = np.flatnonzero(links), np.unique(np.concatenate(turned), axis=0)
    return pa.table({
        "uid": np.concatenate([uid[hit], uid[pairs[:, 0]]]), "links": np.concatenate([links[hit], np.zeros(len(pairs), np.int64)]),
        "root": np.concatenate([uid[label[hit]], uid[pairs[:, 1]]]),
    })


def ring_layout(sizes: dict[tuple[int, bool, int], int], block: int, reach: float) -> list[tuple]:
    """Blocks of each cell from its rows per (cell, home, ring): (cell, home, ring, first block, blocks of the ring, and the ranges h0..h1 of home and
    o0..o1 of copied blocks to compare with).

    Blocks are numbered from 0 in a cell, those of home rows first, and take
    neighbouring rings up to `block` rows; a larger ring has several. Copied rows meet home
    rows only. An empty range has its end before its start.
    """
    width, out = np.pi / RINGS, []
    by_cell: dict[int, dict[tuple[bool, int], int]] = {}
    for (cell, home, ring), n in sizes.items():
        by_cell.setdefault(cell, {})[home, ring] = n
    for cell, counts in by_cell.items():
        blocks: list[tuple[bool, int, int]] = []  # home, first and last ring
        place: dict[tuple[bool, int], tuple[int, int]] = {}
        for home in (True, False):
            held = block
            for ring in sorted(r for h, r in counts if h == home):
                n = counts[home, ring]
                if n > block:
                    place[home, ring] = len(blocks), -(-n // block)
                    blocks += [(home, ring, ring)] * place[home, ring][1]
                    held = block
                elif held + n > block:
                    place[home, ring] = len(blocks), 1
                    blocks.append((home, ring, ring))
                    held = n
                else:
                    place[home, ring] = len(blocks) - 1, 1
                    blocks[-1] = (home, blocks[-1][1], ring)
                    held += n
        for (home, ring), (first, count) in place.items():
            _, low, high = blocks[first]
            near = [k for k, (_, a, b) in enumerate(blocks) if (max(low, a) - min(high, b) - 1) * width <= reach]
            mine = [k for k in near if blocks[k][0]]
            others = [k for k in near if not blocks[k][0]] if home else []
            out.append((cell, home, ring, first, count, *((mine[0], mine[-1]) if mine else (0, -1)), *((others[0], others[-1]) if others else (0, -1))))
    return out


def compared_pairs(sizes: dict[tuple[int, bool, int], int], block: int, reach: float) -> int:
    """Pairs of rows that the blocks of a layout compare; all others are excluded by the triangle inequality."""
    rows: dict[tuple[int, int], float] = {}
    reached: dict[tuple[int, int], list[range]] = {}
    for cell, home, ring, first, count, h0, h1, o0, o1 in ring_layout(sizes, block, reach):
        for k in range(first, first + count):
            rows[cell, k] = rows.get((cell, k), 0) + sizes[cell, home, ring] / count
            reached[cell, k] = [range(h0, h1 + 1), range(o0, o1 + 1)]
    total = 0.0
    for (cell, k), spans in reached.items():
        n = rows[cell, k]
        total += sum(n * (n - 1) / 2 if j == k else n * rows[cell, j] for span in spans for j in span if j >= k)
    return round(total)


def embedding_links(vectors: DataFrame, *, threshold: float = THRESHOLD, cell: int | None = None, block: int = BLOCK, report: dict | None = None) -> DataFrame:
    """(uid, links, root) partial rows over unique vectors (uid long, copies long, embedding array).

    links sums to the weighted number of partners of uid; (uid, root) are edges that span
    the same components as all links. No pair is ever emitted. cell: mean vectors per
    cell, in the place of PER_PIVOT. report gets the numbers of cells, pairs, copied rows
    and compared pairs.
    """
    spark = vectors.sparkSession
    n, width = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    out = "uid long, links long, root long"
    if n < 2:
        return spark.createDataFrame([], out)
    reach = float(np.arccos(threshold)) + ROUNDING
    count = max(1, min(MAX_PIVOTS, isqrt(n // PER_PIVOT) if cell is None else -(-n // cell)))
    rows = vectors.orderBy(F.xxhash64("uid"), "uid").limit(count).select("embedding").toArrow()  # at most MAX_PIVOTS rows
    pivots = spark.sparkContext.broadcast(_units(rows["embedding"].combine_chunks(), width))
    element = vectors.schema["embedding"].dataType.simpleString()

    @trimmed
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radius, size = np.full(count, -1.0), np.zeros(count, np.int64)
        for b in batches:
            if b.num_rows:
                d = _angles(_units(b.column(0), width), pivots.value)
                p = d.argmin(axis=1)
                np.maximum.at(radius, p, d[np.arange(len(p)), p])
                size += np.bincount(p, minlength=count)
        used = np.flatnonzero(size)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(radius[used]), pa.array(size[used])], ["cell", "radius", "n"])

    radii = np.full(count, -np.inf)
    for r in vectors.select("embedding").mapInArrow(nearest, "cell long, radius double, n long").groupBy("cell").agg(F.max("radius").alias("r")).collect():
        radii[r["cell"]] = r["r"]
    bounds = spark.sparkContext.broadcast(radii)

    @trimmed
    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                d = _angles(_units(part.column(2), width), pivots.value)
                p = d.argmin(axis=1)
                own = d[np.arange(len(p)), p][:, None]
                to = (d <= own + 2 * reach) & (d <= bounds.value[None, :] + reach) & (np.arange(count)[None, :] < p[:, None])
                to[np.arange(len(p)), p] = True
                row, where = np.nonzero(to)
                ring = np.minimum(d[row, where] / (np.pi / RINGS), RINGS - 1).astype(np.int64)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(where), pa.array(where == p[row]), pa.array(ring)], ["uid", "copies", "embedding", "cell", "home", "ring"])

    dealt = vectors.select("uid", "copies", "embedding").mapInArrow(copy, f"uid long, copies long, embedding {element}, cell long, home boolean, ring long")
    # At most 2 * MAX_PIVOTS * RINGS rows reach the driver and go back as the layout of the blocks.
    sizes = {(r["cell"], r["home"], r["ring"]): r["count"] for r in dealt.groupBy("cell", "home", "ring").count().collect()}
    if report is not None:
        report |= {"cells": count, "pairs": n * (n - 1) // 2, "copied": sum(k for (_, home, _), k in sizes.items() if not home), "compared": compared_pairs(sizes, block, reach)}
    layout = spark.createDataFrame(ring_layout(sizes, block, reach), "cell long, home boolean, ring long, first int, blocks int, h0 int, h1 int, o0 int, o1 int")
    span = lambda a, b: F.when(F.col(a) <= F.col(b), F.sequence(F.col(a), F.col(b))).otherwise(F.array().cast("array<int>"))
    placed = dealt.join(F.broadcast(layout), ["cell", "home", "ring"])
    met = placed.select(
        "uid", "copies", "embedding", "cell", (F.col("first") + F.pmod(F.xxhash64("uid"), F.col("blocks"))).cast("int").alias("own"),
        F.explode(F.concat(span("h0", "h1"), span("o0", "o1"))).alias("other"),
    )
    pairs = met.select(
        "uid", "copies", "embedding", "cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
    )

    def join(table: pa.Table) -> pa.Table:
        return _join_block(table, width, threshold)

    return pairs.groupBy("cell", "low", "high").applyInArrow(join, out)


@drops_shuffles
def embedding_groups(
    rows: DataFrame, *, threshold: float = THRESHOLD, cell: int | None = None, block: int = BLOCK, key: str = "vec_id", vector: str = "embedding", report: dict | None = None
) -> DataFrame:
    """One row per row of rows (key, vector; other columns are ignored): vec_id, n_links, component_id, kept.

    Vectors link at cosine >= threshold in double precision. Equal vectors are joined
    once and weighted, so copies make no pairs; n_links still counts every linked row.
    Vectors that are null, empty or zero, or hold null or non-finite components, and
    rows with a null id link with nothing. Vectors shorter than the longest count as
    having zeros behind. Repeated ids are rows of their own. An empty table gives an
    empty one. Pivots, radii and cell sizes (MAX_PIVOTS rows at most) are all that
    reaches the driver, with the sizes of their rings; a large cell is compared in pairs of
    ring blocks by many tasks. Where
    distances between unrelated vectors are all alike (high intrinsic dimension), the
    bounds exclude little and the work approaches that of all block pairs.
    """
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = F.coalesce(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite & F.exists(F.col(vector), lambda x: x != 0), F.lit(False))
    base = rows.select(F.col(key).alias("vec_id"), F.when(valid, F.col(vector)).alias("embedding"))
    base = base.withColumn("h", F.xxhash64("embedding"))
    unique = base.where("embedding is not null").groupBy("h", "embedding").agg(F.min("vec_id").cast("long").alias("uid"), F.count("*").alias("copies"))
    unique = cut(unique)
    links = cut(embedding_links(unique.select("uid", "copies", "embedding"), threshold=threshold, cell=cell, block=block, report=report))
    counts = links.groupBy("uid").agg(F.sum("links").alias("links"))
    roots = connected_components(links.select("uid", "root")).select(F.col("node").alias("uid"), "component")
    found = unique.join(counts, "uid", "left").join(roots, "uid", "left").select(
        "h", "embedding",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "uid").alias("component_id"),
    )
    linked = base.where("embedding is not null").join(found, ["h", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = base.where("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
