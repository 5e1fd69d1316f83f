"""Folders as tables: recursive listing with globs, size guard, routing by type and robust decoding."""

from __future__ import annotations

import fnmatch
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Folders that are never entered; extensions of each type.
PRUNED = [".git", "node_modules", "__pycache__", ".venv", "venv"]
TYPES = {
    "image": ["png", "jpg", "jpeg", "gif", "webp", "bmp", "tiff", "tif", "heic"],
    "video": ["mp4", "mov", "avi", "mkv", "webm", "m4v"],
    "audio": ["mp3", "wav", "m4a", "flac", "ogg", "aac", "opus", "wma"],
    "document": ["pdf", "docx", "pptx"],
}
MAX_MB = 100
HEAD = 8192
#: Characters of names that readers would take for patterns.
GLOB, escaped = r"([\[\]{}*?\\])", r"\\\1"


def matches_any(path: Column, globs: list[str]) -> Column:
    """fnmatch on a relative path: * crosses /; a pattern `**/x` also fits x at the top."""
    every = [g for g in globs] + [g[3:] for g in globs if g.startswith("**/")]
    return reduce(lambda a, b: a | b, [path.rlike("^" + re.sub(r"\\Z$|\\z$", "", fnmatch.translate(g)).replace("(?>", "(?:") + r"\z") for g in every])


def content_type(path: Column) -> Column:
    out = None
    for kind, extensions in TYPES.items():
        fits = F.lower(path).rlike(r"\.(" + "|".join(extensions) + r")$")
        out = F.when(fits, kind) if out is None else out.when(fits, kind)
    return out.otherwise("text")


def list_folder(
    spark: SparkSession, folder: str, *, recursive: bool = True, include: list[str] | None = None, exclude: list[str] | None = None, content: bool = True, only: list[str] | None = None
) -> DataFrame:
    """path, rel_path, length, modified_ms, content_type, (content) of the files under a folder; of those named only, if any are, which must be there."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(folder if only is None else [f"{folder.rstrip('/')}/{re.sub(GLOB, escaped, p)}" for p in only])
    base = re.sub(r"/+$", "", folder.split("://", 1)[-1].removeprefix("file:"))
    full = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"^[a-z0-9]+:/*", "/")
    rows = files.withColumn("rel_path", F.substring(full, F.lit(len("/" + base.lstrip("/")) + 2), F.length(full)))
    if recursive:
        rows = rows.where(~F.col("rel_path").rlike(r"(^|/)(\.[^/]+|" + "|".join(re.escape(p) for p in PRUNED) + ")/"))
    if include:
        rows = rows.where(matches_any(F.col("rel_path"), include))
    if exclude:
        rows = rows.where(~matches_any(F.col("rel_path"), exclude))
    kept = ["path", "rel_path", "length", (F.col("modificationTime").cast("double") * 1000).cast("long").alias("modified_ms"), content_type(F.col("rel_path")).alias("content_type")]
    return rows.select(*kept, *["content"] * content)


@F.pandas_udf(StringType())
def decoded(data: pd.Series) -> pd.Series:
    """UTF-8 with or without a mark, else Latin-1."""

    def one(b):
        raw = bytes(b or b"")
        try:
            return raw.decode("utf-8-sig")
        except UnicodeDecodeError:
            return raw.decode("latin-1")

    return data.map(one)


def is_text(content: Column) -> Column:
    """No zero byte near the start: the head's hex digits hold no 00 at an even place."""
    return ~F.hex(F.substring(content, 1, HEAD)).rlike(r"^(?:..)*00")


def routed(files: DataFrame, *, types: list[str] | None = None, max_mb: float = MAX_MB, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """files with status, the log of a run: glob_mismatch, too_large, type_excluded, binary (a text file with a zero byte near its start) or ok.

    include and exclude are for listings that keep all files; a file without content counts as no binary.
    """
    status = F.when(F.lit(False), "")
    if include:
        status = status.when(~matches_any(F.col("rel_path"), include), "glob_mismatch")
    if exclude:
        status = status.when(matches_any(F.col("rel_path"), exclude), "glob_mismatch")
    status = status.when(F.col("length") > F.lit(int(max_mb * 1024 * 1024)), "too_large")
    if types:
        status = status.when(~F.col("content_type").isin(types), "type_excluded")
    status = status.when((F.col("content_type") == "text") & ~is_text(F.col("content")), "binary").otherwise("ok")
    return files.withColumn("status", status)


def ingest_summary(routed_files: DataFrame) -> DataFrame:
    return routed_files.groupBy("content_type", "status").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
