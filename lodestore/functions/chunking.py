"""Chunks of long texts at weighted break points; sequential by nature, so an Arrow UDF."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sizes in characters; break patterns with their weights.
SIZE, OVERLAP, WINDOW, DECAY = 2048, 256, 200, 0.7
BREAKS = [
    (r"\n#(?!#)", 100), (r"\n##(?!#)", 90), (r"\n###(?!#)", 80), (r"\n####(?!#)", 70), (r"\n#####(?!#)", 60), (r"\n######(?!#)", 50),
    (r"\n```", 80), (r"\n(?:---|\*\*\*|___)\s*\n", 60), (r"\n\n+", 20), (r"\n[-*]\s", 5), (r"\n\d+\.\s", 5), (r"\n", 1),
]
_FENCE = re.compile(r"\n```")
_BREAKS = [(re.compile(p), w) for p, w in BREAKS]


def _weights(text: str) -> tuple[list[int], dict[int, int]]:
    """Break positions outside code fences, ascending, and the largest weight of each."""
    best: dict[int, int] = {}
    for pattern, weight in _BREAKS:
        for m in pattern.finditer(text):
            if weight > best.get(m.start(), -1):
                best[m.start()] = weight
    fences = [(m.start(), m.end()) for m in _FENCE.finditer(text)]
    inner = [(a, b) for (a, _), (_, b) in zip(fences[::2], [*fences[1::2], (0, len(text))], strict=False)]
    starts = [a for a, _ in inner]

    def fenced(p: int) -> bool:
        i = bisect_left(starts, p) - 1
        return i >= 0 and inner[i][0] < p < inner[i][1]

    return [p for p in sorted(best) if not fenced(p)], best


def chunk_bounds(text: str, size: int = SIZE, overlap: int = OVERLAP, window: int = WINDOW) -> list[tuple[int, int]]:
    """(start, end) of each chunk. A cut is the break of highest decayed weight in the window before the size limit."""
    n = len(text)
    if n <= size:
        return [(0, n)]
    spots, weight = _weights(text)
    out, at = [], 0
    while True:
        limit = min(at + size, n)
        end = limit
        if limit < n:
            near = spots[bisect_left(spots, limit - window) : bisect_right(spots, limit)]
            decayed = [(weight[p] * (1 - ((limit - p) / window) ** 2 * DECAY), -p) for p in near]
            if decayed and (cut := -max(decayed)[1]) > at:
                end = cut
        out.append((at, end))
        if end >= n:
            return out
        at = end - overlap if end - overlap > at else end


def chunked(docs: DataFrame, *, text: str = "text", size: int = SIZE, overlap: int = OVERLAP, window: int = WINDOW) -> DataFrame:
    """docs with one row per chunk: seq, pos and chunk (null and empty texts are one chunk)."""

    @F.pandas_udf("array<struct<seq:int,pos:int,chunk:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"seq": i, "pos": a, "chunk": (t or "")[a:b]} for i, (a, b) in enumerate(chunk_bounds(t or "", size, overlap, window))])

    return docs.withColumn("_c", F.explode(cut(F.col(text)))).select(*docs.columns, "_c.seq", "_c.pos", "_c.chunk")
