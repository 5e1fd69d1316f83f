"""Ingestion: texts, conversations, folders and extracted sections to rows of the store's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity
from ..functions import text as tx
from ..functions.chunking import chunked
from ..functions.entities import mentions
from ..functions.generated import media_tags, parent_summary
from ..operators import memories as mem
from ..operators.filters import expiry
from ..operators.graph import co_mentions
from ..schema import NAMESPACES
from ..sources.folder import decoded
from ..sources.office import office_sections
from ..sources.transcripts import preferred_sidecars, transcripts


def _col(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def memory_rows(texts: DataFrame, *, now_ms: int, embed=None, model: str = "none", batch: str | None = None) -> dict[str, DataFrame]:
    """Rows of all five tables for texts: collection, file_path, text and any of memory_root_path, title, importance, ttl_seconds, tags and namespaces.

    embed maps a text column to a vector column (a pandas UDF for a model). With batch the
    rows are staged: not active until promoted.
    """
    root = identity.root_path(F.col("file_path"), _col(texts, "memory_root_path"))
    ns = [_col(texts, n) for n in NAMESPACES]
    text = F.coalesce("text", F.lit(""))
    title = F.coalesce(_col(texts, "title"), tx.title(text, F.col("file_path")))
    rows = texts.select(
        "collection", "file_path", text.alias("text"), F.coalesce(_col(texts, "content_type"), F.lit("text")).alias("content_type"), title.alias("title"),
        *[c.alias(n) for c, n in zip(ns, NAMESPACES, strict=True)], root.alias("memory_root_path"), _col(texts, "importance", "float").alias("importance"),
        _col(texts, "ttl_seconds", "int").alias("ttl_seconds"), _col(texts, "tags", "array<string>").alias("tags"),
    ).withColumns({
        "content_hash": identity.content_hash(F.col("text")), "memory_role": identity.role(F.col("file_path"), F.col("memory_root_path")),
        "memory_id": identity.memory_id(F.col("collection"), *[F.col(n) for n in NAMESPACES], F.col("memory_root_path")),
        "active": F.lit(0 if batch else 1), "index_batch_id": F.lit(batch).cast("string"), "now": F.lit(now_ms),
    })
    chunks = chunked(rows).withColumns({
        "hash_seq": identity.hash_seq(F.col("content_hash"), F.col("seq")), "text_body": F.col("chunk"), "model": F.lit(model), "embedded_at": F.col("now"),
        "expires_at": expiry(F.col("now"), F.col("ttl_seconds")),
    })
    chunks = chunks.withColumn("vector", embed(F.col("text_body")) if embed else F.lit(None).cast("array<float>"))
    kept = ["collection", "file_path", "content_hash", "hash_seq", "seq", "memory_id", "memory_role", "memory_root_path", *NAMESPACES, "active", "index_batch_id"]
    found = mentions(chunks.select(*kept, "text_body")).withColumn("created_at", F.lit(now_ms))
    found = found.withColumn("id", identity.graph_id(F.col("memory_id"), F.col("file_path"), F.col("hash_seq"), F.col("entity_key")))
    found = found.withColumn("unit", F.concat_ws("\x1f", "memory_id", "file_path", "hash_seq"))
    edges = co_mentions(found, key="unit").join(found.where("ord = 1").select("unit", *kept, "created_at"), "unit")
    return {
        "embeddings": chunks,
        "documents": rows.withColumns({"id": identity.name_uuid(F.concat_ws("::", "memory_id", "file_path")), "created_at": F.col("now"), "updated_at": F.col("now")}),
        "content": rows.select(F.col("content_hash").alias("hash"), F.col("text").alias("doc"), "content_type", F.col("now").alias("created_at")).dropDuplicates(["hash"]),
        "entities": found,
        "relations": edges,
    }


def conversation_texts(turns: DataFrame, collection: str) -> DataFrame:
    """Root and child texts of conversations (conv_id, turn, role, text), for memory_rows."""
    children = mem.conversation_turns(turns)
    roots = mem.conversation_roots(children)
    child = children.select("file_path", F.col("root_path").alias("memory_root_path"), "title", F.col("text_body").alias("text"), F.lit(None).cast("array<string>").alias("tags"))
    root = roots.select("file_path", F.col("file_path").alias("memory_root_path"), "title", F.col("text_body").alias("text"), "tags")
    return root.unionByName(child).withColumn("collection", F.lit(collection))


def section_texts(sections: DataFrame, collection: str) -> DataFrame:
    """Child texts of documents from rows of rel_path, seq, kind and text."""
    return sections.select(
        F.lit(collection).alias("collection"), F.concat("rel_path", F.lit("::"), "kind", F.lit(":"), F.lpad(F.col("seq").cast("string"), 4, "0")).alias("file_path"),
        F.col("rel_path").alias("memory_root_path"), "text", F.lit("document").alias("content_type"),
    )


def segment_texts(segments: DataFrame, collection: str) -> DataFrame:
    """Child texts of media from transcript rows of path, seq, start and segment."""
    stamp = F.concat(F.lit("@"), F.format_string("%.2f", F.col("start")), F.lit("s"))
    place = F.concat("path", F.lit("::transcript:"), F.lpad(F.col("seq").cast("string"), 4, "0"), stamp)
    return segments.select(F.lit(collection).alias("collection"), place.alias("file_path"), F.col("path").alias("memory_root_path"), F.col("segment").alias("text"), F.lit("video").alias("content_type"))


SIDECAR = r"(?i)(\.transcript\.json|\.srt|\.vtt|\.txt)$"


def stem(path: Column) -> Column:
    """What a media file and its transcripts have in common."""
    return F.regexp_replace(path, r"(?i)(\.transcript\.json|\.[^./]+)$", "")


def folder_texts(files: DataFrame, collection: str, *, caption=None) -> DataFrame:
    """Texts of files of every kind (rel_path, content_type, content, status of sources.folder.routed), for memory_rows.

    Text files are one text. Documents are a child per section and a root that sums up the
    first ones. Images, videos and audio files are a root of caption and transcript, which
    names the file where there is neither, and a child per segment of the transcript
    beside them; such transcripts are no texts of their own, but for .txt files. Files of
    another status and documents without a section have no text.
    """
    usable = files.where("status = 'ok'").select(F.col("rel_path").alias("path"), "content_type", "content")
    nothing = F.lit(None).cast("array<string>")
    media = usable.where(F.col("content_type").isin("image", "video", "audio"))
    sides = usable.where((F.col("content_type") == "text") & F.col("path").rlike(SIDECAR)).withColumn("_stem", stem(F.col("path")))
    owners = media.where("content_type <> 'image'").select(F.col("path").alias("_media"), stem(F.col("path")).alias("_stem"))
    beside = preferred_sidecars(sides.join(owners, "_stem").select("_media", "path", decoded(F.col("content")).alias("text")), "path")
    segments = transcripts(beside).select(F.col("_media").alias("path"), "seq", "start", "segment")
    told = media.withColumn("caption", F.lit(None).cast("string")).withColumn("content_type", F.when(F.col("content_type") == "audio", "video").otherwise(F.col("content_type")))
    spoken = media_texts(told, segments, collection, caption=caption).select("collection", "file_path", "memory_root_path", "text", "content_type", "tags")
    plain = usable.where("content_type = 'text'").withColumn("_stem", stem(F.col("path"))).join(owners.select("_stem").distinct().withColumn("_owned", F.lit(True)), "_stem", "left")
    plain = plain.where(~(F.coalesce("_owned", F.lit(False)) & F.col("path").rlike(SIDECAR) & ~F.lower("path").endswith(".txt")))
    plain = plain.select(F.lit(collection).alias("collection"), F.col("path").alias("file_path"), F.col("path").alias("memory_root_path"), decoded(F.col("content")).alias("text"), "content_type", nothing.alias("tags"))
    sections = office_sections(usable.where("content_type = 'document'").select("path", "content")).withColumnRenamed("path", "rel_path")
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("seq") <= 2, F.struct("seq", "text")))), lambda x: x["text"])
    roots = sections.groupBy("rel_path").agg(first.alias("_first")).withColumn("text", parent_summary(F.col("_first"), F.element_at(F.split("rel_path", "/"), -1)))
    roots = roots.select(F.lit(collection).alias("collection"), F.col("rel_path").alias("file_path"), F.col("rel_path").alias("memory_root_path"), "text", F.lit("document").alias("content_type"), nothing.alias("tags"))
    children = section_texts(sections, collection).withColumn("tags", nothing)
    return plain.unionByName(spoken).unionByName(roots).unionByName(children)


def media_texts(media: DataFrame, segments: DataFrame, collection: str, *, caption=None, tagger=None) -> DataFrame:
    """Root and child texts of images, videos and audio files, for memory_rows.

    media: path, content_type and caption, or content for caption (a column function of
    the bytes, for a model a pandas UDF). segments: path, seq, start, segment of their
    transcripts, if any. A root's text sums up caption and first segments, else names the
    file; tagger maps that text to generated tags.
    """
    named = media.withColumn("_said", caption(F.col("content")) if caption else F.col("caption"))
    told = segments.groupBy("path").agg(F.array_sort(F.collect_list(F.when(F.col("seq") <= 2, F.struct("seq", "segment")))).alias("_first"))
    first = F.transform(F.coalesce("_first", F.array().cast("array<struct<seq:int,segment:string>>")), lambda x: x["segment"])
    text = parent_summary(F.concat(F.array(F.col("_said")), first), F.element_at(F.split("path", "/"), -1))
    root = named.join(told, "path", "left").withColumn("text", text)
    tags = media_tags(tagger(F.col("text"))) if tagger else F.lit(None).cast("array<string>")
    root = root.select(F.lit(collection).alias("collection"), F.col("path").alias("file_path"), F.col("path").alias("memory_root_path"), "text", "content_type", tags.alias("tags"))
    child = segment_texts(segments, collection).drop("content_type").join(media.select(F.col("path").alias("memory_root_path"), "content_type"), "memory_root_path")
    return root.unionByName(child.withColumn("tags", F.lit(None).cast("array<string>")))
