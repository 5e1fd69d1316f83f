"""Prefix trie of conversations: succinct level-order tries per prefix shard, heavy upper levels apart.

1. Conversations are rebuilt from shared openings. A node is named by its depth and the
   exclusive or of 128-bit hashes of (place, turn) along its prefix: a running aggregate,
   so texts are hashed where they are read and enter no exchange. Rows of a name are
   counted with partial aggregation; copies become one node.
2. Nodes of more than sqrt(rows) conversations are heavy: there are fewer than
   sqrt(rows) of them, as each has so many rows of its own. Below them hang light
   subtrees of at most sqrt(rows) conversations each, dealt to shards by their top.
3. A shard's subtrees become one LOUDS trie in numpy: a bit per child and a closing zero
   per node in level order, and label arrays. Parents come from rank and select; sums over
   subtrees run through the levels in reverse with add.at.
4. The sums of the tops, added up per heavy parent, enter the trie of the heavy levels.

A conversation's turns meet in one task as hashes, in a window that Spark sorts and spills.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, shuffles_dropped

#: Conversations whose ids differ in the last two digits share an opening of up to LONGEST_HEAD turns.
FAMILY = 100
LONGEST_HEAD = 5
#: Least bound of a light subtree's conversations; expected nodes of a shard.
LEAST_BOUND = 64
SHARD_NODES = 1 << 15
#: Bytes of joined ids that travel as one row.
BLOB_BYTES = 1 << 16

NODE = ["depth", "k1", "k2"]


class Louds:
    """A forest in level order. bits: for the super-root and then every node, a one per child and a zero; labels: a row per node."""

    def __init__(self, level: np.ndarray, name: np.ndarray, parent: np.ndarray):
        """level: 0 for tops. name and parent: (n, 2) numbers of a node and of its parent, which are unique per level."""
        n = len(level)
        self.order = np.empty(n, np.int64)  # rows in level order
        above = np.zeros(n, np.int64)  # in level order, 1 for the first node
        self.bounds = [0]
        by_level = np.argsort(level, kind="stable")
        cuts = np.flatnonzero(np.diff(level[by_level])) + 1
        before: tuple[np.ndarray, np.ndarray] | None = None  # sorted names of the level before, and their places
        for rows in np.split(by_level, cuts):
            at = self.bounds[-1]
            own = _joined(name[rows])
            up = np.zeros(len(rows), np.int64) if before is None else before[1][np.searchsorted(before[0], _joined(parent[rows]))] + 1
            order = np.lexsort((own, up))
            self.order[at : at + len(rows)], above[at : at + len(rows)] = rows[order], up[order]
            by_name = np.argsort(own[order])
            before = own[order][by_name], at + by_name
            self.bounds.append(at + len(rows))
        self.degree = np.bincount(above, minlength=n + 1)
        bits = np.ones(2 * n + 1, bool)
        bits[np.cumsum(self.degree) + np.arange(n + 1)] = False
        self.bits = np.packbits(bits)
        self.labels = name[self.order]
        ones = np.flatnonzero(np.unpackbits(self.bits, count=2 * n + 1))
        #: Place of each node's parent in level order, -1 for the super-root: the zeros before its one.
        self.parent = ones - np.arange(n) - 1

    def rolled_up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees of values in level order."""
        out = values.copy()
        for a, b in list(zip(self.bounds[:-1], self.bounds[1:], strict=True))[:0:-1]:
            np.add.at(out, self.parent[a:b], out[a:b])
        return out


def _joined(numbers: np.ndarray) -> np.ndarray:
    """Rows of two numbers as one value each, that compares and sorts."""
    return np.ascontiguousarray(numbers).view([("a", np.int64), ("b", np.int64)]).ravel()


def rebuilt_turns(turns: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, depth, a, b, chars) with two 60-bit halves of a hash of role and text, and all conversations (conv_id, depth of the last turn or 0)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    half = lambda at: F.conv(F.substring("_digest", at, 15), 16, 10).cast("long")
    told = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.length(text).cast("long").alias("chars"), digest.alias("_digest"))
    told = told.select("conv_id", "turn", half(1).alias("a"), half(16).alias("b"), "chars")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "a", "b", "chars"))
    own = stage.put(told.withColumn("place", place).drop("turn"), "turns")
    head = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    opening = own.where((F.pmod("conv_id", F.lit(FAMILY)) == 0) & (F.col("place") <= LONGEST_HEAD))
    opening = opening.groupBy(F.col("conv_id").alias("_base")).agg(F.array_sort(F.collect_list(F.struct("place", "a", "b", "chars"))).alias("_head"))
    all_ = own.groupBy("conv_id").agg(F.max("place").alias("_n")).withColumns({"_h": head, "_base": F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))})
    none = F.array().cast("array<struct<place:int,a:bigint,b:bigint,chars:bigint>>")
    convs = all_.join(opening, "_base", "left").withColumn("_head", F.slice(F.coalesce("_head", none), F.lit(1), F.col("_h")))
    convs = stage.put(convs.withColumn("depth", F.size("_head") + F.greatest(F.col("_n") - F.col("_h"), F.lit(0))).select("conv_id", "depth", "_h", "_head"), "convs")
    shared = convs.select("conv_id", F.inline("_head")).withColumnRenamed("place", "depth")
    rest = own.join(convs.select("conv_id", "_h", F.size("_head").alias("_taken")), "conv_id").where("place > _h")
    rest = rest.select("conv_id", (F.col("place") - F.col("_h") + F.col("_taken")).alias("depth"), "a", "b", "chars")
    return shared.unionByName(rest), convs.select("conv_id", "depth")


def _id_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring ids of a node, joined; rows come sorted by node and id."""
    node, ids, size = None, [], 0

    def flushed() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"depth": node[0], "k1": node[1], "k2": node[2], "first": ids[0], "ids": ",".join(map(str, ids))}], _BLOB)

    for b in batches:
        for depth, k1, k2, c in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if ids and (node != (depth, k1, k2) or size > BLOB_BYTES):
                yield flushed()
                ids, size = [], 0
            node = (depth, k1, k2)
            ids.append(c)
            size += len(str(c)) + 1
    if ids:
        yield flushed()


_BLOB = pa.schema([("depth", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])


def _id_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of all joined ids of a node, blob by blob."""
    node, state, out = None, None, []

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"depth": n[0], "k1": n[1], "k2": n[2], "ends_sha256": s} for n, s in rows], _ENDS)

    for b in batches:
        for depth, k1, k2, ids in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if node == (depth, k1, k2):
                state.update(b"," + ids.encode())
            else:
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = (depth, k1, k2), sha256(ids.encode())
        if out:
            yield told(out)
            out = []
    if node is not None:
        yield told([(node, state.hexdigest())])


_ENDS = pa.schema([("depth", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])


def _ends(rows: DataFrame, parts: int) -> DataFrame:
    """(depth, k1, k2, ends_sha256): rows (depth, k1, k2, conv_id), joined in range partitions first, so that a hot node's ids are not joined in one task."""
    order = [*NODE, "conv_id"]
    blobs = rows.select(order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_id_blobs, "depth int, k1 long, k2 long, first long, ids string")
    return blobs.repartition(*NODE).sortWithinPartitions(*NODE, "first").select(*NODE, "ids").mapInArrow(_id_hashes, "depth int, k1 long, k2 long, ends_sha256 string")


_ROLLED = "depth int, k1 long, k2 long, p1 long, p2 long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, top boolean"


def _rolled(nodes: pa.Table) -> pa.Table:
    """Rows of a trie: own columns with the sums over subtrees. more, leaves_in and saved_in are what hangs below a node outside this trie."""
    col = lambda c: nodes[c].combine_chunks().to_numpy(zero_copy_only=False)
    name, parent = np.stack([col("k1"), col("k2")], axis=1), np.stack([col("p1"), col("p2")], axis=1)
    trie = Louds(col("level"), name, parent)
    rows = trie.order
    convs, own = col("n_convs")[rows], col("conv_id")[rows]
    children = trie.degree[1:] + col("more")[rows]
    leaves = trie.rolled_up(np.where(children == 0, 1, col("leaves_in")[rows]))
    saved = trie.rolled_up((convs - 1) * col("chars")[rows] + col("saved_in")[rows])
    top = trie.parent < 0
    up = pa.array(own[np.maximum(trie.parent, 0)], mask=top)
    back = nodes.take(pa.array(rows))
    columns = [*[back[c] for c in (*NODE, "p1", "p2", "conv_id")], up, back["n_convs"], *[pa.array(x.astype(np.int64)) for x in (children, leaves, saved)], pa.array(top)]
    return pa.table(columns, [c.split()[0] for c in _ROLLED.split(", ")])


def conversation_trie(turns: DataFrame, *, least_bound: int = LEAST_BOUND, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, all over rebuilt conversations.

    turns: conv_id, turn, role, text. A conversation's turns are ordered by turn, null
    first, equal ones by a hash of role and text; null role or text is empty. Conversation
    c is rebuilt as the first crc32(c) % 6 turns of conversation c - c % 100 (the floor for
    negative ids), then its own turns from that number on. A conversation without turns
    left is a member of the root only. Rows without a conv_id belong to no conversation
    and are left out; without conversations there is no root and no row. Repeated rows
    are repeated turns. Other columns are ignored.
    """
    spark = turns.sparkSession
    kept = Stage(spark, "trie")
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_dropped(spark):
        rebuilt, convs = rebuilt_turns(turns, kept)
        so_far = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        k1, k2 = F.xxhash64("depth", "a", "b"), F.xxhash64("b", "depth", "a", F.lit(1))
        placed = rebuilt.withColumns({"_x": k1, "_y": k2})
        placed = placed.withColumns({"k1": F.bit_xor("_x").over(so_far), "k2": F.bit_xor("_y").over(so_far)})
        placed = placed.select("conv_id", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("_x")).alias("p1"), F.col("k2").bitwiseXOR(F.col("_y")).alias("p2"), "chars")
        placed = kept.put(placed, "placed")
        counted = placed.groupBy(*NODE).agg(F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("chars").alias("chars"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
        zero = F.lit(0).cast("long")
        root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
        root = root.select(F.lit(0).alias("depth"), *[zero.alias(c) for c in ("k1", "k2", "p1", "p2", "chars")], "n_convs", "conv_id")
        nodes = kept.put(counted.unionByName(root), "nodes")
        rows = placed.count()
        bound = max(least_bound, isqrt(rows))
        is_heavy = (F.col("n_convs") > bound) | (F.col("depth") == 0)
        heavy = nodes.where(is_heavy)  # at most rows / bound, and the root
        marks = F.broadcast(heavy.select(F.col("depth").alias("_d"), F.col("k1").alias("_a"), F.col("k2").alias("_b")))
        here = (F.col("depth") == F.col("_d")) & (F.col("k1") == F.col("_a")) & (F.col("k2") == F.col("_b"))
        above = (F.col("depth") == F.col("_d") + 1) & (F.col("p1") == F.col("_a")) & (F.col("p2") == F.col("_b"))
        tops = placed.join(marks, above, "left_semi").join(marks, here, "left_anti")  # a row per conversation at most
        tops = tops.select("conv_id", F.col("depth").alias("_top"), F.xxhash64("depth", "k1", "k2").alias("_shard"))
        shards = max(1, min(wide, rows // 256), rows // shard_nodes)
        light = nodes.where(~is_heavy).join(tops, "conv_id")
        nothing = {c: zero for c in ("more", "leaves_in", "saved_in")}
        light = light.withColumns({"level": F.col("depth") - F.col("_top"), "_shard": F.pmod("_shard", F.lit(shards)), **nothing})
        light = kept.put(light.groupBy("_shard").applyInArrow(_rolled, _ROLLED), "light")
        hung = light.where("top").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
        hung = hung.agg(F.count("*").alias("more"), F.sum("n_leaves").alias("leaves_in"), F.sum("saved_tokens").alias("saved_in"))
        upper = hung.join(F.broadcast(heavy), NODE, "right").fillna(0, ["more", "leaves_in", "saved_in"]).withColumn("level", F.col("depth"))
        upper = kept.put(upper.groupBy(F.lit(0).alias("_all")).applyInArrow(_rolled, _ROLLED), "heavy")
        parents = F.broadcast(heavy.select(F.col("depth").alias("_d"), F.col("k1").alias("_a"), F.col("k2").alias("_b"), F.col("conv_id").alias("_up")))
        light = light.join(parents, F.col("top") & above, "left").withColumn("parent_conv_id", F.coalesce("_up", "parent_conv_id"))
        last = placed.join(convs, ["conv_id", "depth"]).select("conv_id", *NODE)
        last = last.unionByName(convs.where("depth = 0").select("conv_id", "depth", zero.alias("k1"), zero.alias("k2")))
        ends = _ends(last, max(1, min(wide, rows // 256), rows // shard_nodes))
        every = light.select(*upper.columns).unionByName(upper).join(ends, NODE, "left")
        out = every.select(
            "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
        out = kept.put(out, "out")
        for name in ("turns", "convs", "placed", "nodes", "light", "heavy"):
            kept.drop(name)
    return out.select("*")
