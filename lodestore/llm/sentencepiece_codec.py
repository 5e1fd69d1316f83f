"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Own encoder: the symbols of a stretch of text are its characters; an agenda of adjacent
pairs that form a piece, ordered by piece score and then by position, is worked off
until no pair is left. Texts are cut beforehand at places where no piece of the
vocabulary can reach across, so equal stretches are encoded once per worker. Every
newly met stretch is held against the sentencepiece library inside its Arrow batch.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from hashlib import sha256
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches_of, trimmed

SPACE = "▁"
#: Stretches that a worker remembers; beyond it the memory starts anew.
MAX_KNOWN = 500_000
#: Longer stretches are encoded each time they occur, not remembered.
MAX_REMEMBERED_CHARS = 48


class PieceCodec:
    """A BPE vocabulary with byte fallback, given as the bytes of a model file."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(lib.get_piece_size())
        self.bytes = {int(lib.id_to_piece(i)[3:5], 16): i for i in ids if lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        whole = [i for i in ids if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.id = {lib.id_to_piece(i): i for i in whole}
        self.piece = {i: p for p, i in self.id.items()}
        scores = sorted({lib.get_score(i) for i in whole}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        self.rank = {p: rank[lib.get_score(i)] for p, i in self.id.items() if len(p) > 1}
        self.raw = {i: p.replace(SPACE, " ").encode() for i, p in self.piece.items()}
        self.unknown = lib.unk_id()
        self.hidden = frozenset(i for i in ids if lib.is_control(i))
        self.stretch = re.compile(self._cuts())
        self.known: dict[str, tuple[int, bytes, bytes]] = {}

    def _cuts(self) -> str:
        """Pattern of stretches that no piece crosses, derived from the pairs of characters inside pieces."""
        pairs = {(p[i], p[i + 1]) for p in self.id for i in range(len(p) - 1)}
        if any(b == SPACE != a for a, b in pairs):
            return r"(?s).+"  # pieces run over word starts: only the whole text is safe
        free, more = set(), {c for c in map(chr, range(33, 127)) if not c.isalnum()}
        while more - free:
            free |= more
            more = {y for a, b in pairs for x, y in ((a, b), (b, a)) if x in free and y != SPACE}
        if any(c.isascii() and c.isalnum() for c in free) or "\n" in free:
            free = set()
        free = "".join(map(re.escape, sorted(free)))
        line = "" if any("\n" in p for p in pairs) else "\n"
        p = f"[{free}]" if free else "(?!)"
        return f"{SPACE}*[^{SPACE}{line}{free}]+|{SPACE}*{p}+|{SPACE}+" + ("|\n" if line else "")

    def merge(self, stretch: str) -> list[str]:
        """Pieces of a stretch by the agenda of adjacent symbol pairs."""
        sym: list[str | None] = list(stretch)
        n = len(sym)
        rank = self.rank
        agenda = [(r, i, both) for i, both in enumerate(map(add, stretch, stretch[1:])) if (r := rank.get(both)) is not None]
        heapq.heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            _, i, both = heapq.heappop(agenda)
            left = sym[i]
            if left is None or (j := after[i]) >= n or len(left) + len(sym[j]) != len(both):
                continue  # one of the two has been merged since
            sym[i], sym[j] = both, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(both + sym[k])) is not None:
                    heapq.heappush(agenda, (r, i, both + sym[k]))
            h = before[i]
            if h >= 0 and (r := rank.get(sym[h] + both)) is not None:
                heapq.heappush(agenda, (r, h, sym[h] + both))
        return [s for s in sym if s is not None]

    def ids_of(self, stretch: str) -> list[int]:
        out: list[int] = []
        for s in self.merge(stretch):
            i = self.id.get(s)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out.extend(map(self.bytes.__getitem__, s.encode()))
            else:
                out.append(self.unknown)
        return out

    def raw_of(self, ids: list[int]) -> bytes:
        """Text of ids as UTF-8, word marks as spaces; bytes that form no character become U+FFFD each."""
        try:
            return b"".join([self.raw[i] for i in ids])
        except KeyError:  # bytes, unknown or control ids among them
            pass
        out, run = [], bytearray()

        def flush():
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + size]).decode().encode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�".encode())
                    size = 1
                at += size
            run.clear()

        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
                continue
            flush()
            if i not in self.hidden:
                out.append(self.piece[i].replace(SPACE, " ").encode() if i in self.piece else " ⁇ ".encode())
        flush()
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The library's decode(ids): the space that stands for the text's beginning goes."""
        shown = [i for i in ids if i not in self.hidden]
        raw = self.raw_of(shown)
        starts = bool(shown) and self.piece.get(shown[0], "").startswith(SPACE)
        return (raw[1:] if starts else raw).decode()

    def stretches(self, text: str) -> list[str]:
        return self.stretch.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def look_up(self, stretches: list[str], verify: bool) -> list[tuple[int, bytes, bytes]]:
        """(count, ids joined by commas, decoded bytes) of each stretch."""
        known = self.known
        got = list(map(known.get, stretches))
        if None in got:
            new = {s: None for s, g in zip(stretches, got, strict=True) if g is None}
            for s in new:
                ids = self.ids_of(s)
                new[s] = (len(ids), ",".join(map(str, ids)).encode(), self.raw_of(ids))
            if verify:
                self.check(new)
            if len(known) + len(new) > MAX_KNOWN:
                known.clear()
            known.update((s, v) for s, v in new.items() if len(s) <= MAX_REMEMBERED_CHARS)
            got = [new[s] if g is None else g for s, g in zip(stretches, got, strict=True)]
        return got

    def check(self, new: dict[str, tuple[int, bytes, bytes]]) -> None:
        """Hold new stretches against the library; a line end before them keeps its own beginning apart."""
        head = self.library.encode("\n")
        plain = list(new)
        wants = self.library.encode([s[1:] if s[0] == SPACE else "\n" + s for s in plain], num_threads=1)
        for s, want in zip(plain, wants, strict=True):
            if s[0] != SPACE:
                want = want[len(head) :]
            elif len(s) == 1:
                continue  # the library gives nothing for an empty text
            if ",".join(map(str, want)).encode() != new[s][1]:
                raise AssertionError(f"the library encodes {s!r} as {want}, the agenda as {new[s][1].decode()}")

    def encode(self, text: str, verify: bool = False) -> list[int]:
        return [int(i) for _, ids, _ in self.look_up(self.stretches(text), verify) for i in ids.split(b",")]


_CODEC: dict[int, PieceCodec] = {}


def codec_of(model: bytes) -> PieceCodec:
    """One codec per worker process and model."""
    key = hash(model)
    if key not in _CODEC:
        _CODEC.clear()
        _CODEC[key] = PieceCodec(model)
    return _CODEC[key]


def sentencepiece_codec(docs: DataFrame, model_file: str, *, with_ids: bool = True, with_decoded: bool = True, verify: bool = True) -> DataFrame:
    """Encode and decode every whole text of docs (doc_id, text; other columns are ignored).

    Returns one row per row: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by
    commas), decoded_sha256, and on demand ids (array<int>) and decoded (string). Null
    and empty texts have no ids; their digests are those of the empty string. Repeated
    doc_ids are encoded row by row; an empty table gives an empty one. The model file is
    read on the driver and sent as bytes (fixed size), so executors need no such path.
    verify holds each stretch that a worker meets anew against the library and fails on
    any difference. A worker remembers at most MAX_KNOWN stretches.
    """
    with open(model_file, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_decoded

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(held.value)
        for b in batches_of(batches, 2 << 20):
            texts = [t or "" for t in b.column(1).to_pylist()]
            parts = [codec.stretches(t) for t in texts]
            flat = codec.look_up([s for p in parts for s in p], verify)
            n, shas, says, ids, decoded, at = [], [], [], [], [], 0
            for p in parts:
                own = flat[at : at + len(p)]
                at += len(p)
                joined = b",".join([x[1] for x in own])
                raw = b"".join([x[2] for x in own])[1:]
                n.append(sum([x[0] for x in own]))
                shas.append(sha256(joined).hexdigest())
                says.append(sha256(raw).hexdigest())
                if with_ids:
                    ids.append(np.array(joined.split(b",") if joined else [], dtype="S").astype(np.int32) if joined else np.zeros(0, np.int32))
                if with_decoded:
                    decoded.append(raw.decode())
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(says, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            if with_decoded:
                columns.append(pa.array(decoded, pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
