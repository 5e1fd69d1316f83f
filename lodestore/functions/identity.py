"""Content hashes, memory identities and child paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the url namespace of RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def content_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def doc_key(hash_: Column) -> Column:
    return F.substring(hash_, 1, 6)


def hash_seq(hash_: Column, seq: Column) -> Column:
    return F.concat(hash_, F.lit("_"), seq.cast("string"))


def name_uuid(name: Column) -> Column:
    """Version 5 uuid of a name in the url namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )


def memory_id(collection: Column, user: Column, session: Column, project: Column, profile: Column, root: Column) -> Column:
    """Stable id of a memory from its namespaces and root path; nulls count as empty."""
    parts = [F.coalesce(c, F.lit("")) for c in (collection, user, session, project, profile, root)]
    return name_uuid(F.concat_ws("::", *parts))


def file_key(*parts: Column) -> Column:
    """128-bit key of what a chunk's file is known by: collection, namespaces and path. Null and empty parts differ."""
    return F.md5(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in parts]))


def root_path(path: Column, root: Column | None = None) -> Column:
    """The given root, else the part of a path before its first '::'."""
    own = F.substring_index(path, "::", 1)
    return own if root is None else F.coalesce(F.when(root != "", root), own)


def role(path: Column, root: Column) -> Column:
    return F.when(path == root, "root").otherwise("child")


def child_path(root: Column, kind: str, index: Column) -> Column:
    return F.concat(root, F.lit(f"::{kind}:"), F.lpad(index.cast("string"), 4, "0"))


def graph_id(*parts: Column) -> Column:
    return F.sha2(F.encode(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), "UTF-8"), 256)


def corpus_path(path: Column, corpus: str = "") -> Column:
    """A result's path within a corpus: without scheme and collection, the corpus folder, white space runs and leading dots and slashes; null is empty."""
    raw = F.trim(F.coalesce(path, F.lit("")))
    named = F.regexp_extract(raw, r"^[a-z][a-z0-9+.-]*://[^/]*/(.+)$", 1)
    bare = F.regexp_replace(F.when(named != "", named).otherwise(F.regexp_replace(raw, r"^[a-z][a-z0-9+.-]*://", "")), r"\s+", " ")
    folder = corpus.rstrip("/") + "/"
    inside = F.when(F.lit(bool(corpus)) & bare.startswith(folder), F.substring(bare, len(folder) + 1, 1 << 30)).otherwise(bare)
    return F.when(inside.startswith("/"), inside).otherwise(F.regexp_replace(inside, r"^[./]+", ""))


def memory_key(path: Column, corpus: str = "") -> Column:
    """The path of the memory that a path belongs to: a transcript stands for its video, a child for its root."""
    own = corpus_path(path, corpus)
    return F.when(own.endswith(".transcript.json"), F.regexp_replace(own, r"\.transcript\.json$", ".mp4")).otherwise(F.substring_index(own, "::", 1))
