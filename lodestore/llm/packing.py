"""Best-fit packing of token sequences: partitions pack locally, underfull bins go on as items.

Each task packs its own pieces by best fit, longest first, and emits the bins that are
nearly full. The others travel as single items to fewer partitions, where they are
packed again; this repeats up a tree until one partition is left or a round no longer
helps.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, cut, trimmed

CAPACITY = 4096
END_ID = 1
#: A bin with at most this share of its capacity free is emitted.
SLACK = 1 / 256
#: Underfull bins that one task of a later round takes.
BINS_PER_TASK = 20_000
#: How many partitions of a round meet in one of the next.
FAN_IN = 8
#: A round that lowers the number of underfull bins by less than this share is the last.
LEAST_GAIN = 0.01
#: Words that a worker remembers; beyond it the memory starts anew.
MAX_KNOWN = 300_000

_ITEM = "struct<doc_id:{}, piece:int, start:bigint, length:int, offset:int, crc:bigint, ids:array<int>>"


class WordTokens:
    """Ids of a text by the tokenizers library, each white-space separated word once.

    Right for tokenizers whose tokens never reach across ASCII white space and drop it.
    Plain words (ASCII letters, with trailing . or ,) go straight to the library's merge
    model in lower case; all others through its whole chain.
    """

    def __init__(self, definition: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(definition)
        self.model = self.whole.model
        self.known: dict[bytes, bytes] = {}
        self.plain: dict[bytes, bytes] = {}
        self.tail = {t: self._chain(t.decode()) for t in (b"", b".", b",")}
        self.fast = all(self._direct(w.lower().encode()) == self._chain(w) for w in ("Hello", "tokenization", "QUICKLY", "a", "zzyzx"))

    def _chain(self, word: str) -> bytes:
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _direct(self, word: bytes) -> bytes:
        return np.array([t.id for t in self.model.tokenize(word.decode())], "<u4").tobytes()

    def _new(self, word: bytes) -> bytes:
        if self.fast and word.isascii():
            core = word.rstrip(b".,")
            end = word[len(core) :]
            if core.isalpha() and end in self.tail:
                core = core.lower()
                if (got := self.plain.get(core)) is None:
                    if len(self.plain) > MAX_KNOWN:
                        self.plain.clear()
                    got = self.plain[core] = self._direct(core)
                return got + self.tail[end]
        return self._chain(word.decode())

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        words = text.encode().split()
        known = self.known
        got = list(map(known.get, words))
        if None in got:
            for i, g in enumerate(got):
                if g is None:
                    w = words[i]
                    if (g := known.get(w)) is None:
                        if len(known) > MAX_KNOWN:
                            known.clear()
                        g = self._new(w)
                        if len(w) <= 64:
                            known[w] = g
                    got[i] = g
        return b"".join(got)


_TOKENS: dict[int, WordTokens] = {}


def _tokens(definition: str) -> WordTokens:
    key = hash(definition)
    if key not in _TOKENS:
        _TOKENS.clear()
        _TOKENS[key] = WordTokens(definition)
    return _TOKENS[key]


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item positions: longest first, each into the fullest bin that still holds it."""
    bins: list[list[int]] = []
    room: dict[int, list[int]] = {}
    free = 0  # bit r set: some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fit = free >> n << n
        if fit:
            r = (fit & -fit).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free ^= 1 << r
        else:
            r, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = r - n
        room.setdefault(left, []).append(b)
        free |= 1 << left
    return bins


def _bin_type(kind: str) -> str:
    return f"sequence_id bigint, used int, full boolean, items array<{_ITEM.format(kind)}>"


def _arrow_bins(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    item = pa.struct([("doc_id", kind), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("offset", pa.int32()), ("crc", pa.int64()), ("ids", pa.list_(pa.int32()))])
    types = [("sequence_id", pa.int64()), ("used", pa.int32()), ("full", pa.bool_()), ("items", pa.list_(item))]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(types)], [n for n, _ in types])


def _number(level: int) -> int:
    """First sequence number of a task: its level of the tree and its partition."""
    return (level << 56) + (TaskContext.get().partitionId() << 32)


def pack_documents(
    docs: DataFrame, tokenizer_file: str, *, capacity: int = CAPACITY, end_id: int = END_ID, slack: float = SLACK, with_ids: bool = False
) -> DataFrame:
    """Place every row of docs (doc_id, text; other columns are ignored) into sequences of at most `capacity` tokens.

    A document is its ids and end_id behind them. Only longer ones are cut, into pieces
    of `capacity` ids; the last may be shorter. Returns one row per piece: doc_id,
    piece, start, length, ids_crc32, sequence_id, offset and on demand ids. Null and
    empty texts are one piece of end_id alone; repeated doc_ids are placed each. An
    empty table gives an empty one. Tasks hold the lengths of their own pieces, never
    the texts of more than one batch; a later task takes about BINS_PER_TASK bins. Bins
    that no round fills up are emitted as they are.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        held = spark.sparkContext.broadcast(f.read())
    kind = docs.schema["doc_id"].dataType.simpleString()
    most = int(capacity * slack)
    end = np.array([end_id], "<u4").tobytes()

    def emit(items, level, kind_):
        rows, first = [], _number(level)
        lengths = [x[0] for x in items]
        for k, at in enumerate(best_fit(lengths, capacity)):
            own, used = [p for i in at for p in items[i][1]], 0
            for p in own:
                p["offset"] = used
                used += p["length"]
            rows.append((first + k, used, capacity - used <= most, own))
            if len(rows) == 2000:
                yield _arrow_bins(rows, kind_)
                rows = []
        if rows:
            yield _arrow_bins(rows, kind_)

    @trimmed
    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, items, id_type = _tokens(held.value), [], None
        for b in batches_of(batches):
            id_type = b.column(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = tokens.ids(text or "") + end
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    own = raw[at : at + 4 * capacity]
                    ids = np.frombuffer(own, "<i4") if with_ids else None
                    items.append((len(own) // 4, [{"doc_id": doc, "piece": piece, "start": at // 4, "length": len(own) // 4, "offset": 0, "crc": crc32(own), "ids": ids}]))
        tokens.known.clear()  # workers outlive their tasks
        tokens.plain.clear()
        if items:
            yield from emit(items, 0, id_type)

    def later(level: int):
        @trimmed
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, id_type = [], None
            for b in batches:
                id_type = b.schema.field("items").type.value_type.field("doc_id").type
                items += zip(b.column("used").to_pylist(), b.column("items").to_pylist(), strict=True)
            if items:
                yield from emit(items, level, id_type)

        return run

    bins = cut(docs.select("doc_id", "text").mapInArrow(first_round, _bin_type(kind)))
    done, open_bins, level = bins.where("full"), bins.where("not full"), 0
    parts, count = bins.rdd.getNumPartitions(), open_bins.count()
    while count > 1:
        level += 1
        parts = max(1, -(-parts // FAN_IN), -(-count // BINS_PER_TASK))
        bins = cut(open_bins.repartition(parts, "sequence_id").mapInArrow(later(level), _bin_type(kind)))
        before, count = count, bins.where("not full").count()
        done, open_bins = done.unionByName(bins.where("full")), bins.where("not full")
        if parts == 1 or count > before * (1 - LEAST_GAIN):
            break
    rows = done.unionByName(open_bins).select("sequence_id", F.explode("items").alias("item"))
    item = F.col("item")
    return rows.select(
        *[item[c].alias(c) for c in ("doc_id", "piece", "start")],
        item["length"].cast("long").alias("length"),
        item["crc"].alias("ids_crc32"),
        "sequence_id",
        item["offset"].cast("long").alias("offset"),
        *[item["ids"].alias("ids")] * with_ids,
    )
