"""Hybrid search as one plan: lexical and vector branches, fusion, rerank, blend, roll-up, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.generated import query_variants
from ..operators import fusion, retrieval
from ..operators.filters import live, visible, within
from ..schema import NAMESPACES

PROBE = 20
#: A fused hit in memory, at most: keys, names of branches and numbers.
HIT_BYTES = 512
DETAILS = ["file_key", "hash_seq", "content_type", "title", "text_body", "memory_id", "memory_role", "memory_root_path", "tags"]


def searchable(chunks: DataFrame, as_of_ms: int, **scope: str | None) -> DataFrame:
    return chunks.where(visible() & live(as_of_ms) & within(**scope))


def expanded(queries: DataFrame, generated=None) -> DataFrame:
    """queries (query_id, query) with variant 0 and up to two other wordings as variants 1 and 2.

    Visual queries get a description of what the image shows; others what a generator
    says (a column of its text or a column function of the query) or, without usable
    text, rewrites by rule. Null queries have no variants.
    """
    others = queries.select("*", F.posexplode(query_variants(F.col("query"), generated)).alias("_n", "_v"))
    others = others.withColumns({"query": F.col("_v"), "variant": F.col("_n") + 1}).drop("_n", "_v")
    return queries.withColumn("variant", F.lit(0)).unionByName(others)


def branches(
    chunks: DataFrame, queries: DataFrame, *, as_of_ms: int, probe: int = PROBE, modes=("vec", "fts"), blocks: bool = False, variants: DataFrame | None = None,
    posted: DataFrame | None = None, texts: DataFrame | None = None,
) -> tuple[DataFrame, list[str]]:
    """(query_id, branch, file_key, file_path, hash_seq, score, rank0) and the branch names in insertion order.

    queries may have a mode of their own: vec, fts or hybrid (the default, null too).
    variants: query_id, variant (1, 2) and vector, query or both: each variant adds a
    branch original_vec_exp<variant> by its vector and original_fts_exp<variant> by its words.
    texts: the same chunks without their vectors, where that spares them a join.
    """
    texts = chunks if texts is None else texts
    exp = (1, 2) if variants is not None else ()
    by_vector, by_terms = queries, queries
    if "mode" in queries.columns:
        mode = F.coalesce("mode", F.lit("hybrid"))
        by_vector, by_terms = queries.where(mode != "fts"), queries.where(mode != "vec")
    by_words = [k for k in exp if "query" in variants.columns and "fts" in modes]
    parts, order = [], []
    if "vec" in modes:
        parts.append(retrieval.vector_search(chunks, by_vector, as_of_ms=as_of_ms, limit=probe, blocks=blocks).withColumn("branch", F.lit("original_vec")))
        order.append("original_vec")
        for k in exp if variants is not None and "vector" in variants.columns else ():
            own = variants.where(F.col("variant") == k)
            parts.append(retrieval.vector_search(chunks, own, as_of_ms=as_of_ms, limit=probe, blocks=blocks).withColumn("branch", F.lit(f"original_vec_exp{k}")))
            order.append(f"original_vec_exp{k}")
    if "fts" in modes:
        parts.append(retrieval.bm25(texts, by_terms, as_of_ms=as_of_ms, limit=probe, posted=posted).withColumn("branch", F.lit("original_fts")))
        order.append("original_fts")
        for k in by_words:
            own = variants.where(F.col("variant") == k).select("query_id", "query")
            parts.append(retrieval.bm25(texts, own, as_of_ms=as_of_ms, limit=probe, posted=posted).withColumn("branch", F.lit(f"original_fts_exp{k}")))
            order.append(f"original_fts_exp{k}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, order


def hybrid(
    chunks: DataFrame,
    queries: DataFrame,
    *,
    as_of_ms: int,
    limit: int = 10,
    intent: str | None = None,
    content_type: str | None = None,
    rerank_top_k: int = 20,
    scope: dict | None = None,
    modes=("vec", "fts"),
    probe: int = PROBE,
    rolled: bool = True,
    posted: DataFrame | None = None,
    variants: DataFrame | None = None,
    texts: DataFrame | None = None,
    **rerank_options,
) -> DataFrame:
    """Results of every query (query_id, query, vector, and on demand intent and mode of its own) with their provenance; rolled=False stops before the roll-up.

    posted: stored postings of the chunks. texts: the same chunks without their vectors,
    where that spares them a join. The hits, of which each query has
    candidate_limit at most, are broadcast to the chunks if that bound is small enough.
    """
    rows, told = (retrieval.keyed(searchable(x, as_of_ms, content_type=content_type, **(scope or {}))) for x in (chunks, chunks if texts is None else texts))
    found, order = branches(rows, queries, as_of_ms=as_of_ms, probe=probe, modes=modes, posted=posted, variants=variants, texts=told)
    media = told.select("file_key", "content_type").distinct() if content_type in ("image", "video") else None
    fused = fusion.fuse(found, order, intent=intent, content_type=content_type, limit=limit, media=media, intents=queries.select("query_id", "intent") if "intent" in queries.columns else None)
    if queries.count() * fusion.candidate_limit(limit) * HIT_BYTES <= retrieval.MAX_BROADCAST_BYTES:
        fused = F.broadcast(fused)
    reranked = fusion.rerank(fused, told.select(*DETAILS, *[c for c in ("collection", *NAMESPACES) if c in told.columns]), queries, top_k=rerank_top_k, **rerank_options)
    blended = fusion.blend(reranked)
    return fusion.roll_up(blended, limit) if rolled else blended


MAX_PROBE = 2000


def media_probes(media: DataFrame) -> DataFrame:
    """media (query_id, vector and caption, transcript or both) as queries: the probe text is the transcript and the caption, 2000 characters at most.

    Equal parts count once. Without any text only the vector searches; without a vector only the text.
    """
    kept = [F.when(F.trim(F.col(c)) != "", F.trim(F.col(c))) for c in ("transcript", "caption") if c in media.columns]
    parts = F.array_distinct(F.array_compact(F.array(*kept)))
    return media.select("query_id", "vector", F.trim(F.substring(F.array_join(parts, " "), 1, MAX_PROBE)).alias("query"))


def search_media(chunks: DataFrame, media: DataFrame, *, expand: bool = False, generated=None, embed=None, **options) -> DataFrame:
    """Search by images or videos: their vectors, and the words of captions and transcripts, through the pipeline of hybrid().

    expand adds branches for other wordings of the probe text; embed maps their text
    column to vectors. Reranking is capped and gated as for media queries.
    """
    queries = media_probes(media)
    variants = None
    if expand:
        variants = expanded(queries.select("query_id", "query"), generated).where("variant > 0")
        variants = variants.withColumn("vector", embed(F.col("query"))) if embed else variants
    return hybrid(chunks, queries, query_is_media=True, variants=variants, **options)


def with_bodies(results: DataFrame, chunks: DataFrame, content: DataFrame) -> DataFrame:
    """results (file_key, hash_seq) with their body: the chunk's text or, where that is empty, the whole content of its hash."""
    text = retrieval.keyed(chunks).select("file_key", "hash_seq", "content_hash", F.when(F.col("text_body") != "", F.col("text_body")).alias("_body"))
    found = F.broadcast(results).join(text, ["file_key", "hash_seq"])
    empty = found.where("_body is null").select("content_hash").distinct()
    whole = content.join(F.broadcast(empty), content["hash"] == empty["content_hash"], "left_semi").select(F.col("hash").alias("content_hash"), "doc")
    return found.join(whole, "content_hash", "left").select(*results.columns, F.coalesce("_body", "doc", F.lit("")).alias("body"))


def explain(chunks: DataFrame, queries: DataFrame, **options) -> DataFrame:
    """Provenance per result: scores of every stage, weights, path and boost, rounded to 4 digits for display, and all of it as a JSON payload.

    The payload has the place of the result (path, collection, namespaces, evidence and
    supporting paths), rank and score in every branch that found it, and the numbers of
    fusion, reranking, blending and roll-up.
    """
    out = hybrid(chunks, queries, **options)
    shown = {c: F.round(c, 4) for c in ("score", "rrf", "rerank_score", "rrf_weight", "boost", "rrf_norm", "rerank_norm")}
    shown["by_branch"] = F.transform("by_branch", lambda b: F.struct(b["branch"].alias("branch"), b["rank"].alias("rank"), F.round(b["score"], 4).alias("score")))
    told = [c for c in ("collection", *NAMESPACES) if c in out.columns]
    numbers = ("score", "by_branch", "sources", "compensated", "rrf", "rrf_rank", "rerank_path", "rerank_score", "rrf_norm", "rerank_norm", "rrf_weight", "hit_count", "boost")
    return out.withColumns(shown).withColumn("payload", F.to_json(F.struct("path", "title", *told, "evidence_path", "supporting_paths", "tags", *numbers)))


def search_batch(chunks: DataFrame, queries: DataFrame, *, as_of_ms: int, limit: int = 10, **options) -> DataFrame:
    """One merged ranking of several queries (query_id, query, vector, weight) by rank fusion over their own results."""
    each = hybrid(chunks, queries, as_of_ms=as_of_ms, limit=limit * 3, **options)
    return fusion.merge_batch(each.select("query_id", "memory_key", "path", "rank", "score"), queries.select("query_id", "weight"), limit)
