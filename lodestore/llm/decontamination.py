"""Benchmark decontamination: suffix arrays over shards of the training texts, searched by every test suffix.

1. Texts become words, words numbers of the benchmark's vocabulary (-1 for any other
   word). A shard is a bounded Arrow batch. Its suffix array holds the suffixes of the
   stretches that are long enough for the shortest window and free of other words: no
   other suffix can hold one. It is sorted by prefix doubling to the longest item's depth.
2. Every test suffix (an item from one of its words on) is searched by narrowing its
   interval of the array word by word with two binary searches. The interval at the
   window's length has all places of that window; the deepest one that is not empty
   gives the longest verbatim match. Intervals of one depth are equal or disjoint, so a
   shard's work is bounded by its words times the depth, whatever repeats.
3. Hit words are compared byte by byte with the vocabulary. Documents with hits leave.

Documents take part in no exchange. A benchmark beyond BLOCK_BYTES is searched in blocks,
one pass over the documents each, which carry their matches along in a written table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stage, batches_of, fresh
from .suffix_dedup import Hashes

WINDOW = 10
#: Benchmark text that is searched in one pass and broadcast to it.
BLOCK_BYTES = 4 << 20
#: Training text of a shard, and of a step of its tokenisation.
SHARD_BYTES = 8 << 20
STEP_BYTES = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of words, which are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[ord("0") : ord("9") + 1] = _IN_WORD[ord("a") : ord("z") + 1] = _IN_WORD[128:] = True

FOUND = "struct<n_words:bigint,spans:array<bigint>,items:array<string>,longest:bigint,longest_at:bigint,longest_item:string,longest_item_at:bigint>"


def texts_as_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The texts end to end as lower-cased bytes, and the end of each; null is empty."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat.cast(pa.large_binary()).fill_null(b"")
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    at = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    data = flat.buffers()[2]
    whole = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return _LOWER[whole], at[1:] - at[0]


def words_in(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, hash) of the words of lower-cased texts, some bytes at a time; no word crosses the end of a text."""
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + STEP_BYTES)
        while b < n and _IN_WORD[data[b - 1]] and _IN_WORD[data[b]]:  # on to the end of a word
            more = np.flatnonzero(~_IN_WORD[data[b : b + STEP_BYTES]])
            b = b + int(more[0]) if len(more) else min(n, b + STEP_BYTES)
        step = data[a:b]
        inside = np.concatenate([[False], _IN_WORD[step], [False]])
        fresh_text = np.zeros(len(step) + 1, bool)
        own = begins[np.searchsorted(begins, a) : np.searchsorted(begins, b)]
        fresh_text[own - a] = True
        start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | fresh_text[:-1]))
        end = np.flatnonzero(inside[1:-1] & (~inside[2:] | fresh_text[1:])) + 1
        if len(start):
            yield start + a, end + a, Hashes(step).of(start, end)
        a = b


@dataclass
class Tests:
    """A block of benchmark items as numbers of their words, and its suffixes that are long enough to hold a window."""

    vocabulary: np.ndarray  # sorted hashes
    words: list[bytes]  # by number
    ids: list[str | None]
    symbols: np.ndarray
    at: np.ndarray  # place in symbols, per test suffix
    left: np.ndarray  # words to the item's end
    item: np.ndarray
    place: np.ndarray  # word of the item it starts at
    window: np.ndarray  # words of its window

    def __post_init__(self):
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int32)
        some = np.flatnonzero(self.sieve[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        found = np.searchsorted(self.vocabulary, hashes[some])
        found[found == len(self.vocabulary)] = 0
        same = self.vocabulary[found] == hashes[some]
        out[some[same]] = found[same]
        return out


def tests_of(items: pa.Table, window: int) -> Tests | None:
    """items: id (string) and text. None if no item has a word."""
    data, ends = texts_as_bytes(items["text"])
    steps = list(words_in(data, ends))
    if not steps:
        return None
    start, end, hashes = (np.concatenate(x) for x in zip(*steps, strict=True))
    vocabulary, first, symbols = np.unique(hashes, return_index=True, return_inverse=True)
    words = [data[start[i] : end[i]].tobytes() for i in first]
    owner = np.searchsorted(ends, start, side="right")
    n = np.bincount(owner, minlength=len(ends))
    place = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
    left = n[owner] - place
    size = np.minimum(n, window)[owner]
    at = np.flatnonzero(left >= size)
    return Tests(vocabulary, words, items["id"].to_pylist(), symbols.astype(np.int32), at, left[at], owner[at], place[at], size[at])


def suffix_array(symbols: np.ndarray, reach: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The starts in the order of their suffixes' first `depth` symbols; a suffix ends after `reach` symbols, and ends sort first.

    Prefix doubling: ranks by k symbols become ranks by 2k. starts hold, with a start, all later ones of its stretch.
    """
    n = len(starts)
    place = np.full(len(symbols) + 1, -1)
    place[starts] = np.arange(n)
    rank = np.unique(symbols[starts], return_inverse=True)[1].astype(np.int64)
    k = 1
    while k < depth:
        inside = reach[starts] > k
        follow = np.zeros(n, np.int64)
        follow[inside] = rank[place[starts[inside] + k]] + 1
        parts, rank = np.unique(rank * (n + 1) + follow, return_inverse=True)
        if len(parts) == n:
            break
        k *= 2
    return starts[np.argsort(rank, kind="stable")]


def search(tests: Tests, symbols: np.ndarray, reach: np.ndarray, array: np.ndarray) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray, np.ndarray]:
    """Windows found, as arrays (low, high, test suffix) of intervals, and per suffix of the array its longest match with a test suffix that holds a window: (words, test suffix)."""
    best, by = np.zeros(len(array), np.int64), np.full(len(array), -1)
    heads = symbols[array]
    wanted = tests.symbols[tests.at]
    low, high = np.searchsorted(heads, wanted), np.searchsorted(heads, wanted, side="right")
    active = np.flatnonzero(low < high)
    low, high = low[active], high[active]
    found, k = [], 1

    def bound(low: np.ndarray, high: np.ndarray, target: np.ndarray, k: int) -> np.ndarray:
        """First suffix of each interval whose symbol k is not below the target."""
        a, b = low.copy(), high.copy()
        while (open_ := np.flatnonzero(a < b)).size:
            mid = (a[open_] + b[open_]) >> 1
            at = array[mid]
            inside = reach[at] > k
            symbol = np.where(inside, symbols[np.where(inside, at + k, at)], -1)
            less = symbol < target[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
        return a

    while active.size:
        full = tests.window[active] <= k
        held, first = np.unique(low[full], return_index=True)
        for a, b, t in zip(held.tolist(), high[full][first].tolist(), active[full][first].tolist(), strict=True):
            best[a:b], by[a:b] = k, t
        whole = tests.window[active] == k
        if whole.any():
            found.append((low[whole], high[whole], active[whole]))
        more = tests.left[active] > k
        active, low, high = active[more], low[more], high[more]
        target = tests.symbols[tests.at[active] + k]
        low = bound(low, high, target, k)
        high = bound(low, high, target + 1, k)
        some = low < high
        active, low, high = active[some], low[some], high[some]
        k += 1
    return found, best, by


def matches(tests: Tests, column: pa.Array) -> list[tuple]:
    """Per text: words, hit spans (start and end word, flat), ids of the items found, and the longest verbatim match: words, its place in the text, its item and place there."""
    data, ends = texts_as_bytes(column)
    steps = list(words_in(data, ends))
    n_texts = len(ends)
    if not steps:
        return [(0, [], [], 0, None, None, None)] * n_texts
    start, end = (np.concatenate([s[i] for s in steps]) for i in (0, 1))
    symbols = np.concatenate([tests.numbers(s[2]) for s in steps])
    owner = np.searchsorted(ends, start, side="right")
    counts = np.bincount(owner, minlength=n_texts)
    heads = np.cumsum(counts) - counts
    out: list[tuple] = [(n, [], [], 0, None, None, None) for n in counts.tolist()]
    while True:
        # Words from each place to the next one that is unknown or in another text.
        n = len(symbols)
        stop = np.concatenate([(symbols[1:] < 0) | (owner[1:] != owner[:-1]), [True]])
        edges = np.flatnonzero(stop)
        reach = np.where(symbols >= 0, edges[np.searchsorted(edges, np.arange(n))] - np.arange(n) + 1, 0)
        begin = (symbols >= 0) & np.concatenate([[True], stop[:-1] | (symbols[:-1] < 0)])
        long = begin & (reach >= tests.window.min())
        lengths = reach[long]
        starts = np.repeat(np.flatnonzero(long) - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        if not len(starts):
            return out
        array = suffix_array(symbols, reach, starts, int(tests.left.max()))
        found, best, by = search(tests, symbols, reach, array)
        if not found:
            return out
        low, high, test = (np.concatenate(x) for x in zip(*found, strict=True))
        kinds, kind = np.unique(np.stack([low, high, tests.window[test]]), axis=1, return_inverse=True)
        rows = kinds[1] - kinds[0]
        which = np.repeat(np.arange(len(rows)), rows)
        hit = array[kinds[0][which] + np.arange(len(which)) - (np.cumsum(rows) - rows)[which]]
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + kinds[2][which], -1)
        covered = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        false = [i for i in covered.tolist() if data[start[i] : end[i]].tobytes() != tests.words[symbols[i]]]
        if not false:
            break
        symbols[false] = -1  # another word of the same hash
    # Spans of covered words, cut at the ends of texts.
    first = np.concatenate([[True], (covered[1:] != covered[:-1] + 1) | (owner[covered[1:]] != owner[covered[:-1]])])
    span_from = covered[first]
    span_to = np.concatenate([covered[:-1][first[1:]], covered[-1:]]) + 1
    items = np.unique(np.stack([kind.ravel(), tests.item[test]]), axis=1)  # by kind
    places = np.unique(np.stack([owner[hit], which]), axis=1)  # texts by kind
    low, high = np.searchsorted(items[0], places[1]), np.searchsorted(items[0], places[1], side="right")
    pair = np.unique(np.stack([np.repeat(places[0], high - low), items[1][np.repeat(low, high - low) + np.arange((high - low).sum()) - np.repeat(np.cumsum(high - low) - (high - low), high - low)]]), axis=1)
    order = np.lexsort((array, -best, owner[array]))
    lead = order[np.concatenate([[True], owner[array[order]][1:] != owner[array[order]][:-1]])]
    top = dict(zip(owner[array[lead]].tolist(), lead.tolist(), strict=True))
    for text in np.unique(owner[covered]).tolist():
        a, b = np.searchsorted(owner[span_from], [text, text + 1])
        head = heads[text]
        spans = np.stack([span_from[a:b], span_to[a:b]], axis=1).ravel() - head
        c, d = np.searchsorted(pair[0], [text, text + 1])
        ids = sorted({x for x in (tests.ids[i] for i in pair[1][c:d].tolist()) if x is not None})
        e = top[text]
        t = by[e]
        out[text] = (int(counts[text]), spans.tolist(), ids, int(best[e]), int(array[e] - head), tests.ids[tests.item[t]], int(tests.place[t]))
    return out


def _merged(old: dict | None, new: tuple) -> dict:
    """The matches of two blocks of the benchmark in one text; equal longest matches: those of the earlier block stay."""
    keys = ("n_words", "spans", "items", "longest", "longest_at", "longest_item", "longest_item_at")
    got = dict(zip(keys, new, strict=True))
    if old is None or not old["spans"]:
        return got
    if not new[1]:
        return old
    out: list[int] = []
    for a, b in sorted(zip(old["spans"][::2] + got["spans"][::2], old["spans"][1::2] + got["spans"][1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    longest = got if got["longest"] > old["longest"] else old
    return {**longest, "spans": out, "items": sorted({*old["items"], *got["items"]})}


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[Tests]:
    """The benchmark in blocks of about block_bytes, by the hash of its texts."""
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // block_bytes)
    for k in range(count):
        part = items if count == 1 else items.where(F.pmod(F.xxhash64("text", "id"), F.lit(count)) == k)
        if (tests := tests_of(part.toArrow(), window)) is not None:
            yield tests


def with_matches(docs: DataFrame, benchmark: DataFrame, *, name: str = "found", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs and a struct column of what of the benchmark (item_id, text) stands in each text.

    n_words; spans: first word and word after the last, one pair after the other, of the
    hit stretches; items: ids of the items with windows there, as sorted strings; longest,
    longest_at, longest_item, longest_item_at: words of the longest verbatim match that
    holds a window, where it starts in the text (ties: the first), its item and where it starts there.
    Null and empty texts have no words. An item of fewer words than a window is one
    window; without words it is none. Items of equal ids count as one; one without an id
    hits, but is not listed. Equal texts get equal results; other columns stay as they are.
    """
    spark = docs.sparkSession
    blocks = list(_blocks(benchmark, window, block_bytes))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T._parse_datatype_string(FOUND))])
    at, width, names = docs.columns.index("text"), len(docs.columns), schema.names
    kept = Stage(spark, "decontamination") if len(blocks) > 1 else None
    out = docs
    for k, tests in enumerate(blocks or [None]):
        held = spark.sparkContext.broadcast(tests)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            tests = held.value
            for b in batches_of(batches, SHARD_BYTES):
                if tests is None:
                    data, ends = texts_as_bytes(b.column(at))
                    n = np.zeros(b.num_rows, np.int64)
                    for start, _, _ in words_in(data, ends):
                        n += np.bincount(np.searchsorted(ends, start, side="right"), minlength=b.num_rows)
                    new = [(x, [], [], 0, None, None, None) for x in n.tolist()]
                else:
                    new = matches(tests, b.column(at))
                columns = [b.column(i) for i in range(b.num_columns)]
                old = columns.pop().to_pylist() if len(columns) > width else [None] * b.num_rows
                rows = [_merged(o, x) for o, x in zip(old, new, strict=True)]
                found = pa.array(rows, pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("longest_at", pa.int64()), ("longest_item", pa.string()), ("longest_item_at", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*columns, found], names)

        out = out.mapInArrow(run, schema)
        if kept is not None:
            out = kept.put(out, str(k))
            if k:
                kept.drop(str(k - 1))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside a window), n_items, items_sha256, contaminated, and the longest verbatim match (see with_matches)."""
    found = with_matches(docs.select("doc_id", "text"), benchmark, **options)
    pairs = F.expr("aggregate(transform(found.spans, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (a, x) -> a + x)")
    return found.select(
        "doc_id", "found.n_words", pairs.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (F.size("found.spans") > 0).alias("contaminated"),
        "found.longest", "found.longest_at", "found.longest_item", "found.longest_item_at",
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no window of the benchmark, with their columns; null and empty texts stay."""
    name = fresh(docs, "found")
    return with_matches(docs, benchmark, name=name, **options).where(F.size(f"{name}.spans") == 0).drop(name)
