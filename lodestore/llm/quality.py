"""Quality rules: exact counts per document and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed one- and two-word n-grams: trusted
target documents against the raw corpus. Both are counted over whole texts of all
documents; the result per document is divided by its number of n-grams and held
against one fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BITS, batches_of, cut, packed, trimmed, unpacked

#: Hash buckets of the n-gram table (2 ** BITS) at least.
BITS = 16
#: There are as many buckets (a power of two) as leaves at least so many n-grams of the corpus to each, and under twice as many.
GRAMS_PER_BUCKET = 20
#: Up to 2 ** BROADCAST_BITS weights (32 MB) are broadcast; more are joined by shuffle.
BROADCAST_BITS = 23
#: At most so many trusted documents define the target multinomial, taken in the order of a hash of their id.
MAX_TARGET = 20_000
#: Pseudo-count of each bucket in both multinomials.
ALPHA = 1.0
#: Weights are whole multiples of 1 / SCALE, so that their sums are exact in any order: verdicts do not depend on how texts meet weights.
SCALE = 1 << 20
#: Documents with a mean log-likelihood ratio below this are rejected.
THRESHOLD = -0.25
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

_SPACE = "\t\n\x0b\x0c\r "
_SYMBOLS = "#*$%&|<>"


def _word_ids(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    index = dict.fromkeys(words)
    for i, w in enumerate(index):
        index[w] = i
    return list(index), np.fromiter(map(index.__getitem__, words), np.int64, len(words))


def _repeat_words(ids: np.ndarray, kinds: int, width: int = 5) -> int:
    """Words inside windows of `width` words that occur twice or more."""
    n = len(ids)
    if n <= width or kinds == n:
        return 0
    key, base = ids[: n - width + 1], kinds
    for k in range(1, width):
        if key.max(initial=0) >= (1 << 62) // base:
            key = np.unique(key, return_inverse=True)[1]
        key = key * base + ids[k : n - width + 1 + k]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(key, twice))
    edge = np.zeros(n + 1, np.int32)
    edge[at] += 1
    edge[at + width] -= 1
    return int((np.cumsum(edge)[:n] > 0).sum())


def _buckets(kinds: list[bytes], ids: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of each one-word and two-word n-gram of a text, in order."""
    h = np.fromiter(map(crc32, kinds), np.uint64, len(kinds))[ids]
    shift = np.uint64(64 - bits)
    one = (h + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    two = (one[:-1] ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(7))) * np.uint64(0xD6E8FEB86659FD93)
    return (np.concatenate([one, two]) >> shift).astype(np.int64)


def document_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text (null: no words)."""
    return _counts(text or "")[0]


def _counts(text: str):
    raw = text.encode()
    words = raw.split()
    kinds, ids = _word_ids(words)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACE)) if words else 0,
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeat_words(ids, len(kinds)),
    ), kinds, ids


def bucket_bits(docs: DataFrame) -> int:
    """Bits of the n-gram table for docs, by about two n-grams per word (white space is counted, runs of it as often)."""
    text = F.coalesce("text", F.lit(""))
    gaps = F.length(text) - F.length(F.translate(text, _SPACE, "")) + 1
    grams = 2 * (docs.agg(F.sum(gaps.cast("long"))).first()[0] or 0)
    return max(BITS, (grams // GRAMS_PER_BUCKET).bit_length() - 1)


def _flagged(docs: DataFrame, target_ids: DataFrame | None) -> DataFrame:
    """(text, target): target is true for trusted documents."""
    if target_ids is None:
        return docs.select("text", F.lit(False).alias("target"))
    return docs.select("doc_id", "text").join(target_ids.withColumn("target", F.lit(True)), "doc_id", "left").select("text", "target")


def chunk_counts(docs: DataFrame, target_ids: DataFrame | None, bits: int = BITS) -> DataFrame:
    """(chunk, raw, target): counts of 2 ** CHUNK_BITS buckets as packed arrays; one partial histogram per task, then a sum per chunk."""
    flagged = _flagged(docs, target_ids)
    width = 1 << min(bits, CHUNK_BITS)
    kind = "chunk long, raw binary, target binary"

    def rows(made) -> pa.RecordBatch:
        made = list(made)
        kinds = (pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in made], t) for i, t in enumerate(kinds)], ["chunk", "raw", "target"])

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = [{}, {}]

        def add(which: int, got: list[np.ndarray]) -> None:
            at, n = np.unique(np.concatenate(got), return_counts=True)
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at // width)) + 1):
                c = int(at[part[0]]) // width
                if c not in held[which]:
                    held[which][c] = np.zeros(width, np.int32)
                held[which][c][at[part] - c * width] += n[part].astype(np.int32)

        for b in batches_of(batches):
            raw, trusted = [], []
            for text, target in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = (text or "").encode().split()
                if words:
                    raw.append(_buckets(*_word_ids(words), bits))
                    if target:
                        trusted.append(raw[-1])
            for which, got in enumerate((raw, trusted)):
                if got:
                    add(which, got)
        none = np.zeros(width, np.int32)
        for c, raw in held[0].items():
            yield rows([packed(c, [raw, held[1].get(c, none)])])

    def total(key, table):
        sums = [sum(map(unpacked, table.column(c).to_pylist())) for c in ("raw", "target")]
        return pa.Table.from_batches([rows([packed(key[0].as_py(), sums)])])

    return flagged.mapInArrow(count, kind).groupBy("chunk").applyInArrow(total, kind)


def ngram_counts(docs: DataFrame, target_ids: DataFrame | None, bits: int = BITS) -> DataFrame:
    """(bucket, n_raw, n_target) over all documents, of the buckets that occur: sparse counts of some bytes of text at a time, summed by partial aggregations that spill.

    No task holds a table of buckets, so memory does not grow with their number.
    """
    flagged = _flagged(docs, target_ids)

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 2 << 20):
            raw, trusted = [], []
            for text, target in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = (text or "").encode().split()
                if words:
                    raw.append(_buckets(*_word_ids(words), bits))
                    if target:
                        trusted.append(raw[-1])
            if raw:
                at, n = np.unique(np.concatenate(raw), return_counts=True)
                own = np.zeros(len(at), np.int64)
                if trusted:
                    some, k = np.unique(np.concatenate(trusted), return_counts=True)
                    own[np.searchsorted(at, some)] = k
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.astype(np.int64)), pa.array(own)], ["bucket", "n_raw", "n_target"])

    counts = flagged.mapInArrow(count, "bucket long, n_raw long, n_target long")
    return counts.groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target"))


def _target(labels: DataFrame | None, max_target: int) -> DataFrame | None:
    if labels is None:
        return None
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return F.broadcast(good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target))


def fitted_weights(
    docs: DataFrame, labels: DataFrame | None, *, bits: int = BITS, max_target: int = MAX_TARGET, alpha: float = ALPHA
) -> np.ndarray:
    """log P(bucket | target) - log P(bucket | raw) of all 2 ** bits buckets in units of 1 / SCALE, from the n-grams of all
    docs and of the (at most max_target) trusted ones; all zero without a target."""
    width = 1 << min(bits, CHUNK_BITS)
    raw, trusted = np.zeros(1 << bits), np.zeros(1 << bits)
    for r in chunk_counts(docs, _target(labels, max_target), bits).toLocalIterator():
        at = slice(r["chunk"] * width, (r["chunk"] + 1) * width)
        raw[at], trusted[at] = unpacked(r["raw"]), unpacked(r["target"])
    if not trusted.sum():
        return np.zeros(1 << bits, np.int32)
    trusted = np.log((trusted + alpha) / (trusted.sum() + alpha * len(trusted)))
    return np.rint((trusted - np.log((raw + alpha) / (raw.sum() + alpha * len(raw)))) * SCALE).astype(np.int32)


def _sent(docs: DataFrame, weights: np.ndarray):
    """Broadcast of weights as bytes: workers read them without a second copy."""
    return docs.sparkSession.sparkContext.broadcast(weights.tobytes())


def _mean(weights: np.ndarray, buckets: np.ndarray) -> float:
    return int(weights[buckets].sum(dtype=np.int64)) / (len(buckets) * SCALE)


def joined_scores(docs: DataFrame, labels: DataFrame | None, *, bits: int, max_target: int = MAX_TARGET, alpha: float = ALPHA) -> DataFrame:
    """docs and column llr, for tables that outgrow a broadcast: n-grams meet their weights by shuffle, then texts their scores."""
    docs = cut(docs.withColumn("ngram_row", F.monotonically_increasing_id()))
    counts = cut(ngram_counts(docs, _target(labels, max_target), bits))
    raw, trusted = counts.agg(F.sum("n_raw"), F.sum("n_target")).first()
    own = F.log((F.col("n_target") + alpha) / F.lit((trusted or 0) + alpha * (1 << bits))) - F.log((F.col("n_raw") + alpha) / F.lit((raw or 0) + alpha * (1 << bits)))
    weights = counts.select("bucket", (F.rint(own * SCALE) if trusted else F.lit(0.0)).cast("long").alias("w"))

    @trimmed
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 1 << 20):
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = (text or "").encode().split()
                if words:
                    at, n = np.unique(_buckets(*_word_ids(words), bits), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row)), pa.array(at), pa.array(n)], ["ngram_row", "bucket", "n"])

    met = docs.select("ngram_row", "text").mapInArrow(grams, "ngram_row long, bucket long, n long").join(weights, "bucket")
    scores = met.groupBy("ngram_row").agg((F.sum(F.col("w") * F.col("n")) / (F.sum("n") * SCALE)).alias("llr"))
    return docs.join(scores, "ngram_row", "left").drop("ngram_row").fillna(0.0, ["llr"])


def quality_rules(
    docs: DataFrame,
    labels: DataFrame | None = None,
    *,
    bits: int | None = None,
    max_target: int = MAX_TARGET,
    alpha: float = ALPHA,
    threshold: float = THRESHOLD,
    broadcast_bits: int = BROADCAST_BITS,
) -> DataFrame:
    """Judge every row of docs (doc_id, text and any other columns).

    labels (doc_id, quality): documents of quality 1 form the trusted target; without
    any, the ratio is 0 for all. Returns one row per input row: doc_id, n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept.
    A null or empty text has no words: it fails the base rule and its llr is 0.
    Repeated doc_ids are judged row by row. Columns other than doc_id and text are
    ignored, so their names cannot clash. The number of buckets follows the corpus
    (bucket_bits) unless bits is given. At most 2 ** broadcast_bits weights and
    max_target ids are ever broadcast or collected; larger tables are joined.
    """
    docs = docs.select("doc_id", "text")
    bits = bucket_bits(docs) if bits is None else bits
    joined = bits > broadcast_bits
    if joined:
        docs = joined_scores(docs, labels, bits=bits, max_target=max_target, alpha=alpha)
    weights = None if joined else fitted_weights(docs, labels, bits=bits, max_target=max_target, alpha=alpha)
    schema = (
        "doc_id {}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, llr double, kept boolean"
    ).format(docs.schema["doc_id"].dataType.simpleString())
    held = None if joined else _sent(docs, weights)

    @trimmed
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = None if joined else np.frombuffer(held.value, np.int32)
        for b in batches_of(batches):
            counts, scores = [], []
            for text in b.column(1).to_pylist():
                got, kinds, ids = _counts(text or "")
                counts.append(got)
                if not joined:
                    scores.append(_mean(w, _buckets(kinds, ids, bits)) if got[0] else 0.0)
            c = np.array(counts, np.int64)
            failed = (c[:, 0] < MIN_WORDS) | (100 * c[:, 4] > MAX_REPEAT_PERCENT * c[:, 0])
            llr = b.column(2).to_numpy(zero_copy_only=False) if joined else np.array(scores)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c[:, i]) for i in range(5)), pa.array(failed), pa.array(llr), pa.array(~failed & (llr >= threshold))],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"],
            )

    return docs.mapInArrow(judge, schema)


def quality_filter(
    docs: DataFrame, labels: DataFrame | None = None, *, bits: int | None = None, threshold: float = THRESHOLD, broadcast_bits: int = BROADCAST_BITS, **fit
) -> DataFrame:
    """Rows of docs, with all columns, that quality_rules keeps; texts are judged where they are read, without a join up to broadcast_bits."""
    bits = bucket_bits(docs) if bits is None else bits
    joined, schema = bits > broadcast_bits, docs.schema
    held = None if joined else _sent(docs, fitted_weights(docs, labels, bits=bits, **fit))
    at = docs.columns.index("text")
    if joined:
        docs = joined_scores(docs, labels, bits=bits, **fit)

    @trimmed
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = None if joined else np.frombuffer(held.value, np.int32)
        for b in batches_of(batches):
            good = []
            for k, text in enumerate(b.column(at).to_pylist()):
                (n, _, _, _, repeated), kinds, ids = _counts(text or "")
                bad = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
                good.append(not bad and (b.column(len(schema))[k].as_py() if joined else _mean(w, _buckets(kinds, ids, bits))) >= threshold)
            yield b.select(schema.names).filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, schema)
