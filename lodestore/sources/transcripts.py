"""Transcript sidecars (.transcript.json, .srt, .vtt, .txt) as segment rows."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CUE = re.compile(r"(\d+:\d{2}:\d{2}[.,]\d+|\d{1,2}:\d{2}[.,]\d+)\s*-->\s*(\d+:\d{2}:\d{2}[.,]\d+|\d{1,2}:\d{2}[.,]\d+)[^\n]*\n(.*?)(?:\n\s*\n|\Z)", re.S)
SEGMENTS = "array<struct<seq:int,start:double,end:double,text:string>>"


def clean(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", text)).strip()


def seconds(stamp: str) -> float:
    total = 0.0
    for part in stamp.replace(",", ".").split(":"):
        total = total * 60 + float(part)
    return total


def _number(value) -> float | None:
    try:
        return None if value is None else float(value)
    except (TypeError, ValueError):
        return None


def segments_of(path: str, raw: str | None) -> list[dict]:
    """Numbered segments of a sidecar; a JSON without any falls back to its description, plain text is one segment."""
    raw = (raw or "").replace("\r\n", "\n")
    found: list[tuple] = []
    if path.endswith(".json"):
        try:
            payload = json.loads(raw)
        except json.JSONDecodeError:
            return []
        given = payload if isinstance(payload, list) else payload.get("segments", []) if isinstance(payload, dict) else []
        for s in given if isinstance(given, list) else []:
            if isinstance(s, dict) and (text := clean(str(s.get("text", "")))):
                found.append((_number(s.get("start", s.get("start_seconds"))) or 0.0, _number(s.get("end", s.get("end_seconds"))), text))
        if not found and isinstance(payload, dict) and (text := clean(str(payload.get("description", "")))):
            found.append((0.0, None, text))
    elif path.endswith((".srt", ".vtt")):
        found = [(seconds(a), seconds(b), t) for a, b, body in _CUE.findall(raw) if (t := clean(body))]
    elif text := clean(raw):
        found.append((0.0, None, text))
    return [{"seq": i, "start": a, "end": b, "text": t} for i, (a, b, t) in enumerate(found, 1)]


def transcripts(files: DataFrame, *, path: str = "path", text: str = "text") -> DataFrame:
    """files (path, text) with one row per segment: seq, start, end, segment."""

    @F.pandas_udf(SEGMENTS)
    def parse(paths: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([segments_of(p.lower(), t) for p, t in zip(paths, texts, strict=True)])

    rows = files.withColumn("_s", F.explode(parse(F.col(path), F.col(text))))
    return rows.select(*[c for c in files.columns if c != text], "_s.seq", "_s.start", "_s.end", F.col("_s.text").alias("segment"))


#: Sidecars of a media file, the preferred one first.
PRIORITY = [".transcript.json", ".srt", ".vtt", ".txt"]


def preferred_sidecars(files: DataFrame, path: str = "path") -> DataFrame:
    """One sidecar per media stem, by priority."""
    from pyspark.sql import Window

    rank = F.coalesce(*[F.when(F.lower(path).endswith(s), i) for i, s in enumerate(PRIORITY)])
    stem = F.regexp_replace(F.col(path), r"(?i)(\.transcript\.json|\.srt|\.vtt|\.txt)$", "")
    w = Window.partitionBy("_stem").orderBy("_rank", path)
    rows = files.withColumns({"_rank": rank, "_stem": stem}).where("_rank is not null")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_rank", "_stem")
