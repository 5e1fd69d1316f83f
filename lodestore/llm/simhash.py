"""SimHash near-dedup by multi-index hashing.

A 64-bit fingerprint is split into segments. Two fingerprints within distance r agree
in one segment up to r // segments bits, so each fingerprint enumerates the small
Hamming ball around each of its segments, fetches the table entries of those values and
keeps the ones whose complete distance is at most r.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BITS, batches_of, cut, discard, drops_shuffles, packed, trimmed, unpacked
from .components import FEW, connected_components, snug

WIDTH = 3
SEED = 42
DISTANCE = 3
#: Two segments of 32 bits: a table entry meets a random fingerprint once in 2 ** 32.
SEGMENTS = 2
#: Of near_copies: the words of a shingle and the similarity that a link must have.
WORDS = 5
SIMILARITY = 0.8
#: Of near_copies: bits of the buckets by which rarity is estimated (MAX_BITS bounds what is broadcast, 8 MB), and of a set's parity.
MIN_BITS, MORE_BITS, MAX_BITS = 12, 4, 22
PARITY = 512
#: Rounds of stars at most, and pairs per key row up to which the rest is compared at once.
TURNS = 3
REST = 16
#: Ids that may be broadcast (8 bytes each).
MAX_SENT = 1 << 20


def shingle_hashes(text: str | None, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """XXH64 of each word shingle of a text, in order; of the whole sequence if it is shorter; none without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    if n <= width:
        return np.array([xxh64_intdigest(joined, seed)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[: n - width] + 1]).tolist()
    return np.array([xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """Unsigned number of the bits that are set in over half of the hashes; 0 without any."""
    total = len(hashes)
    if not total:
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(total, 8), axis=1, bitorder="little")
    over = 2 * bits.sum(axis=0, dtype=np.int64) > total
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    """Unsigned SimHash of a text's word shingles (repeats count); 0 without words."""
    return majority(shingle_hashes(text, width, seed))


def fingerprints(docs: DataFrame, *, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            got = np.array([fingerprint(t, width, seed) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def ball(bits: int, radius: int) -> list[int]:
    """All masks of at most radius bits among `bits`."""
    return [sum(1 << i for i in at) for k in range(radius + 1) for at in combinations(range(bits), k)]


def linked_pairs(fps: DataFrame, *, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """(a, b) with a < b: every pair of distinct fingerprints in fps (fp long) within `distance` bits."""
    if 64 % segments:
        raise ValueError("segments must divide 64")
    bits = 64 // segments
    low = F.lit((1 << bits) - 1)
    parts = [F.shiftrightunsigned("fp", k * bits).bitwiseAND(low) for k in range(segments)]
    index = fps.select("fp", F.posexplode(F.array(*parts)).alias("segment", "value"))
    masks = F.array(*map(F.lit, map(int, ball(bits, distance // segments)))).cast("array<long>")
    probes = index.select(F.col("fp").alias("a"), "segment", F.explode(F.transform(masks, lambda m: F.col("value").bitwiseXOR(m))).alias("value"))
    met = probes.join(index.withColumnRenamed("fp", "b"), ["segment", "value"])
    return met.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b").distinct()


@drops_shuffles
def simhash_groups(
    docs: DataFrame, *, width: int = WIDTH, seed: int = SEED, distance: int = DISTANCE, segments: int = SEGMENTS
) -> DataFrame:
    """One row per row of docs (doc_id, text; other columns are ignored): doc_id, fingerprint, component_id.

    fingerprint: 16 lowercase hex digits. component_id: the smallest doc_id reachable
    over links between fingerprints within `distance` bits. Null, empty and blank texts
    have fingerprint zero and are linked like any other; fewer words than `width` form
    one shingle. Rows of one fingerprint are joined to it, never to each other, so copies
    make no pairs; repeated doc_ids get a row each. An empty table gives an empty one.
    """
    prints = cut(fingerprints(docs, width=width, seed=seed))
    unique = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    root = connected_components(linked_pairs(unique.select("fp"), distance=distance, segments=segments)).withColumnRenamed("node", "fp")
    rooted = unique.join(root, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def word_shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles of so many words, A-Z lower-cased; of the whole sequence if it is shorter; none without words.

    Each distinct word is hashed once; a shingle's hash is a mixed polynomial of those of its words.
    """
    from xxhash import xxh64_intdigest

    said = (text or "").encode().lower().split()
    if not said:
        return np.zeros(0, np.uint64)
    kinds = dict.fromkeys(said)
    for w in kinds:
        kinds[w] = xxh64_intdigest(w, SEED)
    h = np.fromiter(map(kinds.__getitem__, said), np.uint64, len(said))
    size = min(words, len(said))
    out = np.full(len(said) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ h[k : k + len(out)]
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def parity(hashes: np.ndarray) -> np.ndarray:
    """PARITY bits, as longs: whether each bucket of a set's hashes holds an odd number of them. Two sets differ in at least as many elements as their bits do."""
    odd = np.bincount((hashes & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def shingle_weights(docs: DataFrame, bits: int, words: int = WORDS) -> np.ndarray:
    """How many texts hold a shingle of each of 2 ** bits hash buckets (65535 stands for more): one packed histogram per task, then a sum per chunk of buckets."""
    width = 1 << min(bits, CHUNK_BITS)

    def rows(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.int64()), pa.array([x[1] for x in made], pa.binary())], ["chunk", "counts"])

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << bits, np.int32)
        for b in batches_of(batches):
            got = [word_shingles(t, words) >> np.uint64(64 - bits) for t in b.column(0).to_pylist()]
            if got:
                at, k = np.unique(np.concatenate(got), return_counts=True)
                n[at.astype(np.int64)] += k.astype(np.int32)
        for c, part in enumerate(n.reshape(-1, width)):
            if part.any():
                yield rows([packed(c, [part])])

    def total(key, table):
        return pa.Table.from_batches([rows([packed(key[0].as_py(), [sum(map(unpacked, table.column("counts").to_pylist()))])])])

    out = np.zeros(1 << bits, np.uint16)
    for r in docs.select("text").mapInArrow(count, "chunk long, counts binary").groupBy("chunk").applyInArrow(total, "chunk long, counts binary").toLocalIterator():
        out[r["chunk"] * width : (r["chunk"] + 1) * width] = np.minimum(unpacked(r["counts"]), 65535)
    return out


def rarest(hashes: np.ndarray, weights: np.ndarray, similarity: float) -> np.ndarray:
    """The prefix of a set under one order for all sets, rare buckets first: sets of that Jaccard similarity meet in it."""
    bits = len(weights).bit_length() - 1
    n = len(hashes)
    order = np.lexsort((hashes, weights[(hashes >> np.uint64(64 - bits)).astype(np.int64)]))
    return hashes[order[: n - math.ceil(similarity * n - 1e-9) + 1]]


def members(*of) -> Column:
    """Half of a name for the set of a key's classes: the hashes of its members, in any order. The last argument is the window of the key."""
    *columns, own = of
    return F.bit_xor(F.xxhash64(*columns)).over(own)


def firsts(met: DataFrame) -> DataFrame:
    """(key) one for all keys of the same classes, of met (key, at, s, t, least): the first one in the order of all sets.

    Keys of the same classes lead to the same pairs, and no two of those meet before the
    first one; so near copies, which share most of their prefixes, meet once and not once
    per shingle. s and t name the set of a key's classes, least marks its smallest one,
    whose place tells the order.
    """
    return met.where("least").groupBy("s", "t").agg(F.min(F.struct("at", "key")).alias("f")).select("f.key")


@drops_shuffles
def near_copies(docs: DataFrame, *, distance: int = DISTANCE, segments: int = SEGMENTS, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) of all rows of docs (doc_id, text) by verified links; rows with a null doc_id are left out.

    Every pair of texts links whose `words`-word shingle sets have a Jaccard similarity of
    `similarity` or more. Texts are compared as word sequences with A-Z lower-cased; those
    without words link with each other. Equal sequences meet as one class, so copies make
    no pairs. A repeated doc_id with different texts counts with the shingles of all.

    1. Multi-index hashing over SimHash fingerprints of the shingle sets: every class is
       compared with the smallest one of its group of fingerprints within `distance` bits.
    2. No link is missed: similar sets share a shingle of their prefixes (rarest). Of the
       shingles that the same classes share one is kept (firsts). Within the classes of a
       shingle that are still in different components, stars around a leader are compared
       in rounds; then all such pairs that are left. Rarity is estimated by bucket, which
       only decides how many pairs are looked at.

    Pairs whose lengths, places or parities rule out the similarity are dropped inside the
    join that finds them; sets are read only of classes in one of the others. Pairs, keys and
    components are tables; the driver sees counts and 2 ** MAX_BITS weights at most. A
    rare shingle's unlike classes are still looked at pair by pair.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.where("doc_id is not null").select("doc_id", "text")

    @trimmed
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in batches_of(batches):
            texts = b.column(1).to_pylist()
            keys = [xxh3_128_digest(b" ".join((t or "").encode().lower().split())) for t in texts]
            every = [word_shingles(t, words) for t in texts]
            fps = np.array([majority(x) for x in every], np.uint64).view(np.int64)
            bits = np.array([parity(x) for x in every], np.int64).reshape(len(every), -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(fps), *map(pa.array, bits.T)], ["doc_id", "key", "fp", *odd])

    odd = [f"p{k}" for k in range(PARITY // 64)]
    rows = cut(docs.mapInArrow(prints, f"doc_id {kind}, key binary, fp long, " + ", ".join(f"{p} long" for p in odd)))
    classes = cut(rows.groupBy("key", "fp", *odd).agg(F.min("doc_id").alias("node")))
    rows = rows.select("doc_id", "key")
    repeated = cut(rows.groupBy("doc_id").agg(F.count("*").alias("c"), F.min("key").alias("x"), F.max("key").alias("y")).where("c > 1"))
    several = repeated.where("x <> y").select("doc_id")
    once, alone = repeated.isEmpty(), several.isEmpty()
    bits = min(max(classes.count().bit_length() + MORE_BITS, MIN_BITS), MAX_BITS)
    held = docs.sparkSession.sparkContext.broadcast(shingle_weights(docs, bits, words))

    @trimmed
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            out = [word_shingles(t, words).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], ["node", "set"])

    @trimmed
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 1 << 20):
            every = [x.values.to_numpy().view("<u8") for x in b.column(1)]
            got = [rarest(x, held.value, similarity) if len(x) else x for x in every]
            lens = np.array(list(map(len, got)), np.int64)
            at = np.concatenate([np.zeros(0, np.int64), *[np.arange(n) for n in lens]])
            key = np.concatenate([np.zeros(0, "<u8"), *got]).view(np.int64)
            size = np.repeat(np.array(list(map(len, every)), np.int64), lens)
            yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0).take(pa.array(np.repeat(np.arange(len(lens)), lens))), pa.array(size << 32 | at)], ["key", "node", "place"])

    def unique(df: DataFrame, name: str) -> DataFrame:
        """One row per doc_id; as it is where none is repeated, so that texts enter no exchange."""
        return df if once else df.dropDuplicates([name])

    def shingles(nodes: DataFrame) -> DataFrame:
        """(node, set) of nodes (node), read from their texts."""
        wanted = nodes.select(F.col("node").alias("doc_id"))
        if (n := wanted.coalesce(16).count()) <= MAX_SENT:
            wanted = F.broadcast(wanted)
        texts = docs.join(wanted, "doc_id", "left_semi").where(F.lit(n) > 0)
        if alone:
            return unique(texts, "doc_id").mapInArrow(sets, f"node {kind}, set array<long>")
        single = texts.join(several, "doc_id", "left_anti").mapInArrow(sets, f"node {kind}, set array<long>").dropDuplicates(["node"])
        joint = texts.join(several, "doc_id", "left_semi").mapInArrow(sets, f"node {kind}, set array<long>")
        return single.unionByName(joint.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("set"))).alias("set")))

    def linked(pairs: DataFrame) -> DataFrame:
        """The distinct pairs (a, b) that are similar."""
        kept = cut(pairs.distinct())
        pairs, n = snug(kept)
        found = cut(shingles(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
        left, right = (found.select(F.col("node").alias(n), F.col("set").alias(f"set{n}")) for n in "ab")
        common = F.size(F.array_intersect("seta", "setb"))
        near = left.join(F.broadcast(pairs) if n <= FEW else pairs, "a").join(right, "b").where(common >= F.lit(similarity) * (F.size("seta") + F.size("setb") - common))
        near = cut(near.select("a", "b"))
        discard(kept)
        discard(found)
        return snug(near)[0]

    # Candidates by fingerprint: every class meets the smallest class of its group of linked fingerprints.
    prints_ = cut(classes.groupBy("fp").agg(F.min("node").alias("first")))
    group = connected_components(linked_pairs(prints_.select("fp"), distance=distance, segments=segments)).withColumnRenamed("node", "fp")
    grouped = prints_.join(group, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("group"))
    least = grouped.groupBy("group").agg(F.min("first").alias("other"))
    met = classes.select("fp", "node").join(grouped.select("fp", "group"), "fp").join(least, "group").where("node <> other")
    links = linked(met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")))
    root = connected_components(links)

    # What the fingerprints miss: sets that share a shingle of their prefixes.
    every = shingles(classes.select("node").distinct())
    keys = every.mapInArrow(prefixes, f"key long, node {kind}, place long")
    own = Window.partitionBy("key")
    met = keys.withColumns({"x": F.min("node").over(own), "y": F.max("node").over(own), "s": members("node", own), "t": members(F.lit(1), "node", own)}).where("x <> y")
    met = cut(met.select("key", "node", F.shiftright("place", 32).cast("int").alias("n"), F.col("place").bitwiseAND((1 << 32) - 1).cast("int").alias("at"), "s", "t", F.expr("node = x").alias("least")))
    shared = met.join(firsts(met), "key", "left_semi").drop("s", "t", "least")
    single = classes.select("node", *odd)
    if not alone:
        single = single.join(several, single["node"] == several["doc_id"], "left_anti").groupBy("node").agg(*[F.first(p).alias(p) for p in odd])
    # A doc_id with several texts has no parity of its own. Dealt by key once: what follows per key needs no exchange.
    shared = cut(shared.join(single, "node", "left").repartition("key"))
    discard(met)

    def able(x: str, y: str):
        """Whether two sets that meet first at these places of their orders can be similar, by length, by what is left and by parity."""
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        most = 1 + F.least(n - F.col(f"{x}.at") - 1, m - F.col(f"{y}.at") - 1)
        apart = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in odd])
        fits = (most + 1e-6 >= F.lit(similarity / (1 + similarity)) * (n + m)) & (F.coalesce(apart, F.lit(0)) <= F.lit((1 - similarity) / (1 + similarity)) * (n + m) + 1e-6)
        return (F.col(f"{x}.root") != F.col(f"{y}.root")) & fits

    ordered = [F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")]
    for turn in range(TURNS + 1):
        known, n = root.select("node", F.col("component").alias("r")), root.coalesce(16).count()
        now = shared.join(F.broadcast(known) if n <= MAX_SENT // 8 else known, "node", "left").withColumn("root", F.coalesce("r", "node")).drop("r")
        if n > MAX_SENT // 8:
            now = cut(now.repartition("key"))
        parts = now.groupBy("key", "root").count().groupBy("key").agg(F.sum("count").alias("c"), F.sum(F.col("count") * F.col("count")).alias("s"))
        left, size = parts.agg(F.sum((F.col("c") * F.col("c") - F.col("s")) / 2), F.sum("c")).first()
        if not left:
            break
        if turn == TURNS or left <= REST * size:
            rest = now.alias("x").join(now.alias("y"), "key").where(able("x", "y") & (F.col("x.node") < F.col("y.node")))
            root = connected_components(links.unionByName(linked(rest.select(*ordered))))
            break
        lead = now.groupBy("key").agg(F.min_by(F.struct("node", "n", "at", "root", *odd), F.struct(F.xxhash64("node", F.lit(turn)), "node")).alias("l")).select("key", "l.*")
        links = links.unionByName(linked(now.alias("x").join(lead.alias("y"), "key").where(able("x", "y")).select(*ordered)))
        root = connected_components(links)
        if n > MAX_SENT // 8:
            discard(now)
    discard(shared)
    root = root.withColumnRenamed("node", "n")
    named = classes.join(root, classes["node"] == root["n"], "left").select("key", F.coalesce("component", "node").alias("component_id"))
    return rows.join(named, "key").select("doc_id", "component_id")


def near_copy_dedup(docs: DataFrame, **options) -> DataFrame:
    """Rows of docs, with all columns, whose doc_id is the smallest of its near copies; rows with a null doc_id are kept."""
    kept = near_copies(docs, **options).where("doc_id = component_id").select("doc_id").distinct()
    return docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))


def simhash_dedup(docs: DataFrame, **options) -> DataFrame:
    """Rows of docs whose doc_id is the smallest of its group, with all columns; one stays of repeated doc_ids' groups each.

    Rows with a null doc_id are kept: nothing names them as copies.
    """
    kept = simhash_groups(docs, **options).where("doc_id = component_id").select("doc_id").distinct()
    return docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
