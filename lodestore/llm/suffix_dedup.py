"""Suffix-array dedup: removes bytes covered by long strings that occur elsewhere.

1. Candidates. Every window of `length` bytes is named by the smallest hash among the
   k-grams inside it, so equal windows have equal names. Neighbouring windows of one
   name form a run; a run's bytes are its segment. Runs whose name stands nowhere else
   are done with. Segments that occur twice are repeated throughout; segments that share
   a name with a different one are contested.
2. Burrows-Wheeler transforms. Contested segments go to partitions by name. Each
   partition sorts the suffixes of two or more shards of its segments, over an alphabet
   of blocks of `length / DEPTH` bytes, keeps per shard the transform (the block before
   each suffix), and merges the transforms by refining their interleave, one block per
   iteration. An iteration is one stable pass over the transforms; suffixes are not
   sorted again. The iteration in which two neighbours part gives their common prefix;
   intervals that have not parted after DEPTH iterations are repeated strings.
   A hot name is refined the same way over all partitions: per iteration the intervals
   of its suffixes are counted with their next block, pre-aggregated in every task, and
   suffixes that are alone in their interval leave.
3. Removal. Repeated starts become byte spans of their documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, cut, fresh, shuffles_dropped, trimmed

LENGTH = 400
#: Length at which repeated passages of over 50 words go: the shortest of those have some 250 bytes.
PASSAGE = 240
#: Longest k-gram; shorter windows are named by grams of a fifth of their length.
GRAM = 64
#: Blocks per window: the merge takes so many iterations.
DEPTH = 2
#: Elements of a partition's transforms, and of one shard.
PARTITION_BYTES = 1 << 19
SHARD_BYTES = 1 << 18
#: A name with more different segments is hot: its intervals are refined over all partitions, no task holds them.
MAX_SEGMENTS = 4000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS["n"] < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
        _POWERS["n"] = size
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xA24BAED4963EE407)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """64-bit hashes of any substrings of one byte string, independent of their place."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def every(self, size: int) -> np.ndarray:
        """Hashes of all substrings of one size."""
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * self.down[:n] + np.uint64(size))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each stretch of `width` values: prefix and suffix minima of blocks."""
    n = len(values)
    pad = -n % width
    v = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(v, axis=1).ravel()
    back = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs_of(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of the texts that stand end to end in data: name, hash of the segment, first start, starts, name twice in it.

    A run has at most `length` starts, so that spans of its first and last repeated start
    touch. twice may be set without need, never missing.
    """
    width = length - gram + 1
    begins = np.concatenate([[0], ends[:-1]])
    whole = ends - begins >= length
    if not whole.any():
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z.view(np.uint64), z, z, z.astype(bool)
    hashes = Hashes(data)
    grams = hashes.every(gram)
    names = sliding_min(grams, width)
    edge = np.zeros(len(names) + 1, np.int32)
    np.add.at(edge, begins[whole], 1)
    np.add.at(edge, ends[whole] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(edge[:-1]))
    own = names[at]
    first = np.concatenate([[0], np.flatnonzero((own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)) + 1])
    starts, counts, name = at[first], np.diff(np.concatenate([first, [len(at)]])), own[first]
    if counts.max() > length:
        pieces = -(-counts // length)
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        full = np.repeat(counts, pieces)
        starts, name, counts = np.repeat(starts, pieces) + within * length, np.repeat(name, pieces), np.minimum(length, full - within * length)
    # Names are small hashes: look for second places of a name among the small ones only; a rare large name counts as double.
    limit = np.uint64((1 << 64) // width * 12)
    low = np.flatnonzero(grams <= limit)
    lo, hi = np.searchsorted(low, starts), np.searchsorted(low, starts + counts - 1 + width)
    run = np.repeat(np.arange(len(starts)), hi - lo)
    spot = low[np.arange(len(run)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
    twice = (np.bincount(run[grams[spot] == name[run]], minlength=len(starts)) > 1) | (name > limit)
    return name, hashes.of(starts, starts + counts - 1 + length), starts, counts, twice


_BITS = np.uint64(24)
_MASK = np.uint64((1 << 24) - 1)


def _ordered(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of symbols below 2 ** 40, and the symbols in it."""
    key = (symbols << _BITS) | np.arange(len(symbols), dtype=np.uint64)
    key.sort()
    return (key & _MASK).astype(np.int64), key >> _BITS


def shard_transform(elements: np.ndarray, before: np.ndarray, symbol: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a shard in the order of their first `depth` symbols, and the transform: the symbol before each."""
    order = elements
    for _ in range(depth):
        p = before[order]
        order = p[_ordered(symbol[p])[0]]
    return order, symbol[before[order]]


def merge_transforms(one: tuple, two: tuple, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged suffixes and transform of two shards, and the interval of each suffix.

    side holds the interleave. Iteration t takes the symbols from the two transforms in
    the order of the interleave and brings side into their stable order: the suffixes
    are then ordered by t symbols. Neighbours get different intervals in the iteration
    in which they first differ, so intervals group suffixes with equal first symbols.
    """
    (sa1, bwt1), (sa2, bwt2) = one, two
    side = np.concatenate([np.zeros(len(sa1), bool), np.ones(len(sa2), bool)])
    interval = np.zeros(len(side), np.int32)
    symbols = np.empty(len(side), np.uint64)
    for _ in range(depth):
        symbols[~side], symbols[side] = bwt1, bwt2
        order, sorted_ = _ordered(symbols)
        side, interval = side[order], interval[order]
        parted = (sorted_[1:] != sorted_[:-1]) | (interval[1:] != interval[:-1])
        interval = np.concatenate([[0], np.cumsum(parted, dtype=np.int32)]).astype(np.int32)
    sa, bwt = np.empty(len(side), np.int64), np.empty(len(side), np.uint64)
    sa[~side], sa[side] = sa1, sa2
    bwt[~side], bwt[side] = bwt1, bwt2
    return sa, bwt, interval


def _equal(data: np.ndarray, byte: np.ndarray, owner: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the strings at each pair of elements (a, b) are equal byte by byte.

    A pair one place behind a pair of the same segments shares all but its last byte with it.
    """
    partner = np.full(len(owner) + 1, -2)
    partner[a + 1] = b
    behind = (partner[a] == b - 1) & (a > 0) & (owner[np.maximum(a - 1, 0)] == owner[a]) & (owner[np.maximum(b - 1, 0)] == owner[b])
    out = data[byte[a] + length - 1] == data[byte[b] + length - 1]
    windows = np.lib.stride_tricks.sliding_window_view(data, length)

    def whole(at: np.ndarray) -> None:
        for k in range(0, len(at), 2048):
            i = at[k : k + 2048]
            out[i] = (windows[byte[a[i]]] == windows[byte[b[i]]]).all(axis=1)

    whole(np.flatnonzero(~behind))
    if not out.all():  # two strings with equal hashes: no pair rests on another
        whole(np.arange(len(a)))
    return out


def repeated_starts(data: np.ndarray, ends: np.ndarray, length: int, depth: int = DEPTH, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) start of each segment at which its `length` bytes occur at another start of any segment; -1 without one.

    Segments (at least `length` bytes each) stand end to end in data. A suffix starts at
    every byte from which a block of length / depth bytes is left; its symbols are the
    blocks from there on. Each segment holds one circular string per residue: a suffix
    that wraps around is no start, and no start wraps within depth blocks.
    """
    size = length // depth
    begins = np.concatenate([[0], ends[:-1]])
    m, counts = len(ends), ends - begins - size + 1
    offset = np.cumsum(counts) - counts
    total = int(counts.sum())
    owner = np.repeat(np.arange(m), counts)
    byte = np.arange(total) + (begins - offset)[owner]
    hashes = Hashes(data)
    symbol = hashes.every(size)[byte] >> _BITS
    before = np.arange(total) - size
    residue = np.arange(size)
    head = offset[:, None] + residue
    before[head] = head + (counts[:, None] - 1 - residue) // size * size

    part = (offset // shard_bytes) if offset[-1] >= shard_bytes else (np.arange(m) * 2 // m)
    first = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
    bounds = np.concatenate([offset[first], [total]])
    shards = [shard_transform(np.arange(a, b), before, symbol, depth) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    if len(shards) == 1:
        shards.append((np.zeros(0, np.int64), np.zeros(0, np.uint64)))
    while len(shards) > 1:
        merged = [merge_transforms(shards[i], shards[i + 1], depth) for i in range(0, len(shards) - 1, 2)]
        interval = merged[-1][2]
        shards = [x[:2] for x in merged] + (shards[-1:] if len(shards) % 2 else [])
    sa = shards[0][0]

    starts = byte[sa] + length <= ends[owner[sa]]
    sa, interval = sa[starts], interval[starts]
    same = np.flatnonzero(interval[1:] == interval[:-1])
    same = same[_equal(data, byte, owner, sa[same], sa[same + 1], length)]
    hit = np.zeros(len(sa), bool)
    hit[same] = hit[same + 1] = True
    spots = np.sort(sa[hit])
    lo, hi = np.full(m, -1, np.int64), np.full(m, -1, np.int64)
    if len(spots):
        seg = owner[spots]
        new = np.concatenate([[True], seg[1:] != seg[:-1]])
        old = np.concatenate([new[1:], [True]])
        lo[seg[new]] = spots[new] - offset[seg[new]]
        hi[seg[old]] = spots[old] - offset[seg[old]]
    return lo, hi


def _units(raws: list[bytes], length: int, most: int = 1 << 18) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """Texts end to end in pieces of about `most` bytes; longer texts in pieces that overlap by length - 1 bytes."""
    rows, offsets, parts, size = [], [], [], 0
    for i, raw in enumerate(raws):
        for at in range(0, max(1, len(raw) - length + 1), most):
            piece = raw[at : at + most + length - 1]
            if len(piece) >= length:
                rows.append(i)
                offsets.append(at)
                parts.append(piece)
                size += len(piece)
            if size >= most:
                yield rows, offsets, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
                rows, offsets, parts, size = [], [], [], 0
    if parts:
        yield rows, offsets, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def remove_spans(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """Remaining bytes and maximal removed runs."""
    joined: list[list[int]] = []
    for a, b in sorted(spans):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    kept, at = [], 0
    for a, b in joined:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]]), [(a, b) for a, b in joined]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(3), "doc_id", "text").alias("k2"), "text")


def gram_of(length: int) -> int:
    return max(8, min(GRAM, length // 5))


def _place() -> tuple[Column, Column, Column, Column]:
    """(start, level, starts, twice) of a run's column at: start << 12 | level << 10 | starts << 1 | twice; level is the place of its length in lengths."""
    return F.shiftright("at", 12), F.shiftright("at", 10).bitwiseAND(3), F.shiftright("at", 1).bitwiseAND(511), F.col("at").bitwiseAND(1)


def runs_table(keyed: DataFrame, lengths: tuple[int, ...], gram: int | None = None) -> DataFrame:
    """(k1, k2, h, g, at): the runs of every length in all texts, from one scan."""

    @trimmed
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                raws, keys = [(t or "").encode() for t in part.column(2).to_pylist()], part.select(["k1", "k2"])
                for level, length in enumerate(lengths):
                    for rows, offsets, data, ends in _units(raws, length):
                        name, segment, starts, counts, twice = runs_of(data, ends, length, gram or gram_of(length))
                        unit = np.searchsorted(ends, starts, side="right")
                        spot = starts - np.concatenate([[0], ends[:-1]])[unit] + np.array(offsets)[unit]
                        own = keys.take(pa.array(np.array(rows)[unit]))
                        yield pa.RecordBatch.from_arrays(
                            [own.column(0), own.column(1), _signed(name ^ np.uint64(level * 0x9FB21C651E98DF25 & (1 << 64) - 1)), _signed(segment), pa.array(spot << 12 | level << 10 | counts << 1 | twice)],
                            ["k1", "k2", "h", "g", "at"],
                        )

    return keyed.where(F.octet_length("text") >= min(lengths)).mapInArrow(find, "k1 long, k2 long, h long, g long, at long")


def contested_bytes(keyed: DataFrame, segments: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(h, g, n, level, bytes) of segments (h, g, n, k1, k2, at), cut out of the texts they name."""
    wanted = segments.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "g", "at", "n")).alias("runs"))

    @trimmed
    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                out: list[tuple] = []
                for text, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = text.encode()
                    for r in own:
                        start, level, count = r["at"] >> 12, r["at"] >> 10 & 3, r["at"] >> 1 & 511
                        out.append((r["h"], r["g"], r["n"], level, raw[start : start + count - 1 + lengths[level]]))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["h", "g", "n", "level", "bytes"])

    texts = keyed.where(F.octet_length("text") >= min(lengths))
    return texts.join(wanted, ["k1", "k2"]).select("text", "runs").mapInArrow(slices, "h long, g long, n long, level long, bytes binary")


_FOUND = "h long, g long, first long, last long"


def merged_starts(taken: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(h, g, first, last): first and last repeated start of the segments that occur once, by merged transforms per partition."""

    @trimmed
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids, single, parts, size, now = [], [], [], [], 0, 0

        def flush():
            lo, hi = repeated_starts(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), lengths[now])
            hit = (lo >= 0) & np.array(single)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.array(names)[hit]), pa.array(np.array(ids)[hit]), pa.array(lo[hit]), pa.array(hi[hit])], ["h", "g", "first", "last"]
            )

        for b in batches:
            for h, g, n, level, raw in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if names and (level != now or (size >= PARTITION_BYTES and h != names[-1])):
                    yield flush()
                    names, ids, single, parts, size = [], [], [], [], 0
                now = level
                if names and names[-1] == h and ids[-1] == g:
                    continue  # a repeated row of documents
                names.append(h)
                ids.append(g)
                single.append(n == 1)
                parts.append(raw)
                size += len(raw)
        if parts:
            yield flush()

    parts = int(taken.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return taken.repartition(parts, "h").sortWithinPartitions("level", "h", "g").mapInArrow(decide, _FOUND)


def refined_starts(taken: DataFrame, lengths: tuple[int, ...], stage: Stage) -> DataFrame:
    """The same of hot names: DEPTH iterations that refine the intervals of all their suffixes by the next block.

    An interval is known by a hash of its blocks so far. Its members are counted with
    partial sums per task; those that are alone leave before the next iteration.
    """
    blocks = [f"b{t}" for t in range(DEPTH)]

    @trimmed
    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, g, n, level, raw in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                size, k = lengths[level] // DEPTH, len(raw) - lengths[level] + 1
                each = Hashes(np.frombuffer(raw, np.uint8)).every(size)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.full(k, x)) for x in (h, g, n)), pa.array(np.arange(k)), *(_signed(each[t * size : t * size + k].copy()) for t in range(DEPTH))],
                    ["h", "g", "n", "spot", *blocks],
                )

    own = "h long, g long, n long, spot long, "
    now = stage.put(taken.mapInArrow(suffixes, own + ", ".join(f"{x} long" for x in blocks)).withColumn("interval", F.col("h")), "suffixes")
    for t, symbol in enumerate(blocks):
        several = now.groupBy("interval", symbol).agg(F.count("*").alias("c")).where("c > 1").select("interval", symbol)
        kept = now.join(several, ["interval", symbol], "left_semi")
        now = stage.put(kept.select("h", "g", "n", "spot", *blocks[t + 1 :], F.xxhash64("interval", symbol).alias("interval")), f"refined-{t}")
    return now.where("n = 1").groupBy("h", "g").agg(F.min("spot").alias("first"), F.max("spot").alias("last"))


def repeated_spans(docs: DataFrame, *, lengths: tuple[int, ...] = (LENGTH,), gram: int | None = None, max_segments: int = MAX_SEGMENTS) -> DataFrame:
    """(k1, k2, spans): per level of lengths the removable byte spans [a, b) of documents (doc_id, text), keyed by two hashes of row content.

    Written at once; what is staged on the way is deleted again.
    """
    spark, keyed = docs.sparkSession, _keyed(docs)
    stage, (start, level, count, twice) = Stage(spark, "suffixes"), _place()
    try:
        with shuffles_dropped(spark):
            runs = stage.put(runs_table(keyed, lengths, gram), "runs")
            # A name counts once per run, and twice where it may stand twice in one.
            names = runs.groupBy("h").agg(F.sum(twice + 1).alias("c")).where("c > 1").select("h")
            runs = stage.put(runs.join(names, "h", "left_semi"), "open")
            stage.drop("runs")
            segments = runs.groupBy("h", "g").agg(F.count("*").alias("n"), F.max(twice).alias("twice"), F.min(F.struct("k1", "k2", "at")).alias("rep"))
            segments = stage.put(segments.select("h", "g", "n", "twice", "rep.*"), "segments")
            named = segments.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
            contested = segments.join(named, "h", "left").where("m > 1 or twice = 1").withColumn("hot", F.coalesce(F.col("m") > max_segments, F.lit(False)))
            contested = stage.put(contested, "contested")
            calm = contested_bytes(keyed, contested.where("not hot"), lengths)
            found = [segments.where("n > 1").select("h", "g", F.lit(0).cast("long").alias("first"), (count - 1).alias("last")), stage.put(merged_starts(calm, lengths), "merged")]
            if not contested.where("hot").isEmpty():
                found.append(refined_starts(contested_bytes(keyed, contested.where("hot"), lengths), lengths, stage))
            every = found[0]
            for more in found[1:]:
                every = every.unionByName(more)
            size = F.element_at(F.array(*map(F.lit, lengths)), (level + 1).cast("int"))
            spans = runs.join(every, ["h", "g"]).select(
                "k1", "k2", F.struct(level.cast("int").alias("level"), (start + F.col("first")).alias("a"), (start + F.col("last") + size).alias("b")).alias("span")
            )
            return cut(spans.groupBy("k1", "k2").agg(F.collect_set("span").alias("spans")))
    finally:
        stage.drop()


def suffix_dedup(
    docs: DataFrame, *, length: int = LENGTH, passage: int | None = None, gram: int | None = None, max_segments: int = MAX_SEGMENTS, with_bytes: bool = True, with_text: bool = True, replace: bool = False
) -> DataFrame:
    """Every row and column of docs (doc_id, text, ...; without text on demand) plus n_bytes, n_removed, n_spans, kept_sha256 and on demand spans and kept.

    Texts count as UTF-8 bytes (null: empty); matches never cross documents. Every byte
    covered by a string of `length` bytes that also starts elsewhere in the input, in
    the same document too, is removed; strings are judged on the input. spans holds the
    maximal removed runs (a, b), kept the remaining bytes. Texts below `length` bytes
    stay whole. Repeated rows are each other's copies and lose all such strings. Names
    that docs already has get a trailing underscore. An empty table gives an empty one.

    replace puts the remaining text in the place of text; a character that loses some of
    its bytes goes as a whole, and null stays null. With passage (shorter than length),
    passage_text is what is left without the repeated strings of `passage` bytes, found in
    the same scan; everything else stays that of `length`.

    Lengths must be multiples of DEPTH and at most 511. Segments are told apart by two
    64-bit hashes; merged intervals are compared byte by byte. No task gathers more than
    max_segments different segments of one name: exact copies meet as one segment with a
    count, and names beyond that are refined over all partitions.
    """
    lengths = (length,) if passage is None else (length, passage)
    if any(x % DEPTH or not (gram or gram_of(x)) < x < 512 for x in lengths) or passage is not None and passage >= length:
        raise ValueError("lengths must be multiples of DEPTH, above their gram and below 512, passage below length")
    names = {n: fresh(docs, n) for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
    k1, k2, runs = fresh(docs, "key_one"), fresh(docs, "key_two"), fresh(docs, "removable")
    spans = repeated_spans(docs, lengths=lengths, gram=gram, max_segments=max_segments)
    rows = docs.withColumns({k1: F.xxhash64("text"), k2: F.xxhash64(F.lit(3), "doc_id", "text")})
    spans = spans.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("spans").alias(runs))
    joined = rows.join(spans, [k1, k2], "left").drop(k1, k2)
    columns = [c for c in docs.columns if c != "text" or with_text]
    added = list(names.values())[: 6 if with_bytes else 4]
    extra = [] if passage is None else [fresh(docs, "passage_text")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.binary()][: len(added)]
    kinds = ["long", "long", "long", "string", "array<struct<a:long,b:long>>", "binary"]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns] + [f"`{n}` {k}" for n, k in zip(added, kinds, strict=False)] + [f"`{n}` string" for n in extra])
    carried = [c for c in docs.columns if c != "text"]

    @trimmed
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, 512) for at in range(0, whole.num_rows, 512)):
                out, texts, rests = [], [], []
                for text, own in zip(b.column(len(carried)).to_pylist(), b.column(len(carried) + 1).to_pylist(), strict=True):
                    raw, levels = (text or "").encode(), [[(x["a"], x["b"]) for x in own or () if x["level"] == k] for k in range(len(lengths))]
                    kept, gone = remove_spans(raw, levels[0])
                    out.append((len(raw), len(raw) - len(kept), len(gone), sha256(kept).hexdigest(), [{"a": x, "b": y} for x, y in gone], kept))
                    texts.append(kept.decode("utf-8", "ignore") if replace and text is not None else text)
                    if extra:
                        rests.append(None if text is None else remove_spans(raw, levels[1])[0].decode("utf-8", "ignore"))
                given = dict(zip(carried, b.columns, strict=False)) | {"text": pa.array(texts, pa.string()) if with_text else None}
                yield pa.RecordBatch.from_arrays([*(given[c] for c in columns), *(pa.array([x[i] for x in out], t) for i, t in enumerate(types)), *([pa.array(rests, pa.string())] if extra else [])], [*columns, *added, *extra])

    return joined.select(*carried, "text", runs).mapInArrow(remove, schema)


def suffix_dedup_text(docs: DataFrame, *, length: int = PASSAGE, **options) -> DataFrame:
    """docs with the repeated strings of `length` bytes taken out of `text`; a character that loses some of its bytes goes as a whole.

    All other columns stay. Null texts stay null, empty and short ones as they are. Takes the options of suffix_dedup.
    """
    return suffix_dedup(docs, length=length, with_bytes=False, replace=True, **options).select(*docs.columns)
