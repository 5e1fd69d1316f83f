"""Merkle manifest of a dataset: a sparse forest of hashes, merged up a tree of partitions.

Rows become leaves; the leaves of a source, in order of their id, become a tree of known
arity, and the roots of the sources one tree above them. A Forest holds the nodes of a
stretch of leaves whose sibling runs are not complete, keyed by tree, level and index.
Two forests merge by uniting their nodes and closing every run that is now whole, as the
sizes of all trees are known; this is associative, with the empty forest as its unit. A
stretch leaves at most two open runs per level, however many leaves it has.

1. Leaves are hashed where the texts are read and written without texts, then sorted by
   (source, id) into range partitions, so that a hot source spreads over many.
2. Every partition folds its leaves to its forest. Rounds of a tree reduction merge the
   forests of FAN_IN neighbours each, as rows of written tables; a run that closes there
   is kept with its children. The driver sees counts only.
3. Every partition asks for the runs above it that closed in a round (two per level at
   most), folds its leaves again and writes proofs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, ascii_lower, shuffles_dropped

ARITY = 16
#: Leaves of a partition, where the session's shuffle partitions do not make it more.
PARTITION_ROWS = 2048
FAN_IN = 16
#: The tree over the roots of the sources.
TOP = -1

Key = tuple[int, int, int]  # tree, level, index


def leaf_hash(columns: Iterable[Column]) -> Column:
    """sha256 of fields end to end: "-" for null, else the UTF-8 byte count, ":" and the value."""
    parts = []
    for c in columns:
        said = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def joined(digests: Iterable[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


class Forest:
    """Unresolved nodes of some stretches of leaves. sizes gives the number of leaves of each tree that the nodes belong to.

    closed gets every run that closes: its parent's key and its children's digests.
    """

    def __init__(self, sizes: Callable[[int], int], arity: int = ARITY, closed: Callable[[Key, list[str]], None] = lambda key, run: None):
        self.sizes, self.arity, self.closed = sizes, arity, closed
        self.nodes: dict[Key, str] = {}

    def width(self, tree: int, level: int) -> int:
        n = self.sizes(tree)
        for _ in range(level):
            n = -(-n // self.arity)
        return n

    def add(self, nodes: Iterable[tuple[Key, str]]) -> Forest:
        """Unite with other nodes, of keys that are not in yet, and close what is whole."""
        fresh: dict[tuple[int, int], set[int]] = {}
        for (tree, level, index), digest in nodes:
            self._put(tree, level, index, digest, fresh)
        while fresh:
            tree, level = min(fresh, key=lambda k: (k[0] == TOP, k[1]))
            runs = {i // self.arity for i in fresh.pop((tree, level))}
            width = self.width(tree, level)
            if width == 1:
                continue  # the root of all
            for r in sorted(runs):
                own = [(tree, level, i) for i in range(r * self.arity, min(width, (r + 1) * self.arity))]
                if all(k in self.nodes for k in own):
                    children = [self.nodes.pop(k) for k in own]
                    self.closed((tree, level + 1, r), children)
                    self._put(tree, level + 1, r, joined(children), fresh)
        return self

    def _put(self, tree: int, level: int, index: int, digest: str, fresh: dict[tuple[int, int], set[int]]) -> None:
        """A tree's root is a leaf of the tree above it."""
        if tree != TOP and self.width(tree, level) == 1:
            tree, level, index = TOP, 0, tree
        self.nodes[tree, level, index] = digest
        fresh.setdefault((tree, level), set()).add(index)


_NODES = "kind string, part long, tree long, level int, idx long, size long, digest string"


def _ranked(leaves: DataFrame, order: list[str], stage: Stage, parts: int) -> tuple[DataFrame, DataFrame]:
    """leaves with _part and _at (place in it) after a range sort, and per _part and tree: size, before, tree (rank of the source), of (its size)."""
    placed = leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = stage.put(placed.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id"), "sorted")
    held = placed.groupBy("_part", "source").agg(F.count("*").alias("size"), F.min("_at").alias("first"))
    held = stage.put(held, "held")
    by_source = Window.partitionBy("source").orderBy("_part")  # a row per partition at most
    held = held.withColumns({"before": F.sum("size").over(by_source) - F.col("size"), "of": F.sum("size").over(Window.partitionBy("source"))})
    starts = (F.col("before") == 0).cast("long")
    new = held.groupBy("_part").agg(F.sum(starts).alias("_new"))
    earlier = new.select("_part", (F.sum("_new").over(Window.orderBy("_part")) - F.col("_new")).alias("_earlier"))  # a row per partition
    within = F.sum(starts).over(Window.partitionBy("_part").orderBy("first"))
    held = held.join(earlier, "_part").withColumn("tree", F.col("_earlier") + within - 1)
    return placed, stage.put(held.select("_part", "first", "size", "before", "of", "tree"), "trees")


def _level_up(children: list[str], begin: int, width: int, arity: int) -> tuple[int, list[str], int, int]:
    """The parents of the whole runs among neighbouring nodes from `begin`: the first parent, their digests, and the stretch of children they cover."""
    end = begin + len(children)
    low = -(-begin // arity)
    high = -(-end // arity) if end == width else end // arity
    if high <= low:
        return low, [], begin, begin
    parents = [joined(children[r * arity - begin : min(end, (r + 1) * arity) - begin]) for r in range(low, high)]
    return low, parents, low * arity, min(end, high * arity)


class _Part:
    """A partition's part of every tree: per tree and level its neighbouring nodes, the open ones and the runs above that it lacks."""

    def __init__(self, leaves: list[str], trees: list[dict], total: int, arity: int):
        self.arity, self.levels, self.open, self.lacks = arity, {}, [], set()
        roots: list[tuple[int, str]] = []
        for t in trees:
            root = self._fold(t["tree"], t["of"], t["before"], leaves[t["first"] : t["first"] + t["size"]])
            if root is not None:
                roots.append((t["tree"], root))
        trees_here = [t["tree"] for t in trees]
        self._fold(TOP, total, min(trees_here), [d for _, d in roots], roots[0][0] if roots else min(trees_here), max(trees_here) + 1)

    def _fold(self, tree: int, width: int, first: int, nodes: list[str], begin: int | None = None, end: int | None = None) -> str | None:
        """Returns the root if the whole tree is here. first, end: the stretch that leaves here belong to, whether their node is known or not."""
        begin = first if begin is None else begin
        end = first + len(nodes) if end is None else end
        level = 0
        while width > 1:
            self.levels[tree, level] = (begin, nodes, width)
            up, parents, a, b = _level_up(nodes, begin, width, self.arity)
            self.open += [(tree, level, i, nodes[i - begin]) for i in range(begin, begin + len(nodes)) if not a <= i < b]
            for r in {first // self.arity, (end - 1) // self.arity}:
                if not up <= r < up + len(parents):
                    self.lacks.add((tree, level + 1, r))
            first, end, begin, nodes = first // self.arity, (end - 1) // self.arity + 1, up, parents
            width, level = -(-width // self.arity), level + 1
        if not nodes:
            return None
        if tree == TOP:
            self.open.append((TOP, level, 0, nodes[0]))
        return nodes[0]

    def run(self, tree: int, level: int, index: int, given: dict[Key, str]) -> str:
        """The digests of the children of a node, end to end."""
        if (tree, level, index) in given:
            return given[tree, level, index]
        begin, nodes, width = self.levels[tree, level - 1]
        return "".join(nodes[index * self.arity - begin : min(width, (index + 1) * self.arity) - begin])


def merkle_manifest(
    docs: DataFrame, *, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: Column | None = None, arity: int = ARITY,
    partition_rows: int = PARTITION_ROWS, fan_in: int = FAN_IN,
) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    A leaf is the hash of the fields (leaf_hash). Per source the leaves ascend by doc_id
    (null first; equal ids by leaf, so equal rows stand in any order and give the same
    tree); while several nodes remain, every `arity` neighbours become the hash of their
    digests. What remains is the subroot, a lone leaf itself. Subroots ordered by source
    (null first, then by bytes) give the root likewise. proof_sha256 hashes the siblings on
    the way from leaf to root. Where the condition `tampered` holds, folded_root is made
    from the leaf of a text with A-Z lower-cased, else from the leaf itself, and verified
    says whether it is the root. Nulls in any field are hashed as "-". An empty table has
    no rows. Other columns are left out.
    """
    spark = docs.sparkSession
    kept = Stage(spark, "merkle")
    spoilt = {c: ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in fields}
    other = F.when(F.coalesce(tampered, F.lit(False)), leaf_hash(spoilt.values())) if tampered is not None else F.lit(None).cast("string")
    with shuffles_dropped(spark):
        leaves = docs.select("doc_id", "source", leaf_hash(F.col(c) for c in fields).alias("leaf"), other.alias("other"), F.monotonically_increasing_id().alias("_row"))
        leaves = kept.put(leaves, "leaves")
        rows = leaves.count()
        wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
        parts = max(1, min(-(-rows // partition_rows), max(wide, rows // (64 * partition_rows))))
        # Where a third of all rows are one row, their numbers part them.
        placed, trees = _ranked(leaves, ["source", "doc_id", "leaf", "_row"], kept, parts)
        placed = placed.drop("_row", "source")
        total = trees.agg(F.coalesce(F.max("tree") + 1, F.lit(0))).first()[0]
        sides = lambda: placed.groupBy("_part").cogroup(trees.groupBy("_part"))

        def opened(key: tuple, leaves: pa.Table, trees: pa.Table) -> pa.Table:
            part = _Part(leaves.sort_by("_at")["leaf"].to_pylist(), trees.sort_by("first").to_pylist(), total, arity)
            sizes = {t["tree"]: t["of"] for t in trees.to_pylist()} | {TOP: total}
            rows = [("open", key[0].as_py(), t, level, i, sizes[t], d) for t, level, i, d in part.open]
            rows += [("lacks", key[0].as_py(), t, level, i, sizes[t], None) for t, level, i in sorted(part.lacks)]
            return _table(rows)

        first = kept.put(sides().applyInArrow(opened, _NODES), "open")
        open_, closed = first.where("kind = 'open'"), []
        n, k = parts, 0
        while k == 0 or n > 1:
            n, k = -(-n // fan_in), k + 1
            done = kept.put(open_.withColumn("part", F.floor(F.col("part") / fan_in)).groupBy("part").applyInArrow(_merge(total, arity), _NODES), f"round{k}")
            open_ = done.where("kind = 'open'")
            closed.append(done.where("kind = 'closed'").select("tree", "level", "idx", "digest"))
        runs = reduce(DataFrame.unionByName, closed)
        lacks = first.where("kind = 'lacks'").select(F.col("part").alias("_part"), "tree", "level", "idx")
        given = lacks.join(runs, ["tree", "level", "idx"])
        nothing = lambda kind: F.lit(None).cast(kind)
        told = trees.select("_part", "tree", "first", "size", "before", "of", nothing("int").alias("level"), nothing("long").alias("idx"), nothing("string").alias("digest"))
        told = told.unionByName(given.select("_part", "tree", *[nothing("long").alias(c) for c in ("first", "size", "before", "of")], "level", "idx", "digest"))

        def proven(key: tuple, leaves: pa.Table, told: pa.Table) -> pa.Table:
            return _proofs(leaves.sort_by("_at"), told.to_pylist(), total, arity)

        out = placed.groupBy("_part").cogroup(told.groupBy("_part")).applyInArrow(proven, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
        out = kept.put(out, "proofs")
        for name in ("leaves", "sorted", "held", "trees", "open", *[f"round{i}" for i in range(1, k + 1)]):
            kept.drop(name)
    return out.select("*")


def _table(rows: list[tuple]) -> pa.Table:
    names = [c.split()[0] for c in _NODES.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


def _merge(total: int, arity: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """The forest of a group of neighbouring partitions, from theirs; runs that close are told with their children."""

    def run(key: tuple, nodes: pa.Table) -> pa.Table:
        rows = nodes.to_pylist()
        sizes = {r["tree"]: r["size"] for r in rows} | {TOP: total}
        part, out = key[0].as_py(), []
        forest = Forest(sizes.__getitem__, arity, lambda k, run: out.append(("closed", part, *k, sizes[k[0]], "".join(run))))
        forest.add(((r["tree"], r["level"], r["idx"]), r["digest"]) for r in rows)
        return _table(out + [("open", part, *k, sizes[k[0]], d) for k, d in sorted(forest.nodes.items())])

    return run


def _proofs(leaves: pa.Table, told: list[dict], total: int, arity: int) -> pa.Table:
    """Rows of the manifest for a partition: its nodes are folded again, runs that closed beyond it are given."""
    given = {(r["tree"], r["level"], r["idx"]): r["digest"] for r in told if r["level"] is not None}
    trees = sorted((r for r in told if r["level"] is None), key=lambda r: r["first"])
    own = leaves["leaf"].to_pylist()
    others = leaves["other"].to_pylist()
    part = _Part(own, trees, total, arity)
    last: dict[tuple[int, int], tuple[int, tuple]] = {}

    def width_above(tree: int, width: int, leaf: int) -> Iterator[tuple[int, int, int]]:
        """(tree, level, index) of the nodes that have siblings, from a leaf to the root."""
        level = 0
        while width > 1:
            yield tree, level, leaf
            width, leaf, level = -(-width // arity), leaf // arity, level + 1

    def around(tree: int, level: int, index: int) -> tuple[bytes, bytes]:
        """The digests before and after a node in its run."""
        was = last.get((tree, level))
        if was is None or was[0] != index // arity:
            was = last[tree, level] = (index // arity, part.run(tree, level + 1, index // arity, given).encode())
        at = index % arity * 64
        return was[1][:at], was[1][at + 64 :]

    def folded(digest: str, path: list[tuple[bytes, bytes]]) -> str:
        for a, b in path:
            digest = sha256(a + digest.encode() + b).hexdigest()
        return digest

    columns: list[list] = [[] for _ in range(5)]
    for t in trees:
        above = [around(*k) for k in width_above(TOP, total, t["tree"])]
        subroot = root = None
        for i in range(t["size"]):
            path = [around(*k) for k in width_above(t["tree"], t["of"], t["before"] + i)]
            leaf = own[t["first"] + i]
            if subroot is None:
                subroot = folded(leaf, path)
                root = folded(subroot, above)
            proof = sha256()
            for a, b in (*path, *above):
                proof.update(a)
                proof.update(b)
            other = others[t["first"] + i]
            back = folded(folded(leaf if other is None else other, path), above)
            for c, x in zip(columns, (subroot, root, proof.hexdigest(), back, back == root), strict=True):
                c.append(x)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return pa.table([leaves["doc_id"], leaves["leaf"], *[pa.array(c, pa.string()) for c in columns[:4]], pa.array(columns[4], pa.bool_())], names)
