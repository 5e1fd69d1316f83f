"""Weighted reciprocal-rank fusion, rerank gates, blending by tier and roll-up to parent memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PLAIN_WORD, words
from ..functions.vectors import jaccard
from ..schema import NAMESPACES
from .retrieval import FILE

RRF_K = 60
# Branch weights by intent, and by requested content type without one.
INTENT_WEIGHTS = {
    "exact_lookup": {"original_fts": 2.5, "original_vec": 0.8},
    "semantic": {"original_fts": 0.8, "original_vec": 2.5},
    "broad": {"original_fts": 1.0, "original_vec": 1.0},
}
TYPE_WEIGHTS = {
    "text": {"original_vec": 2.5, "original_fts": 1.5},
    "image": {"original_vec": 1.5, "original_fts": 2.5},
    "video": {"original_vec": 1.5, "original_fts": 2.5},
}
EXPANDED = 0.5
# The weight of the fused rank up to rank 3, up to rank 10 and beyond, for texts and for others.
TEXT_TIERS, MEDIA_TIERS = (0.90, 0.85, 0.75), (0.75, 0.60, 0.40)


def branch_weight(branch: str, intent: str | None = None, content_type: str | None = None) -> float:
    """Weight of a branch; an expansion `<parent>_expN` has half its parent's."""
    parent, _, n = branch.rpartition("_exp")
    expanded = bool(parent) and n.isdigit()
    name = parent if expanded else branch
    if intent in INTENT_WEIGHTS:
        own = INTENT_WEIGHTS[intent]
        if branch in own:
            return own[branch]
        return own.get(name, 1.0) * EXPANDED
    return TYPE_WEIGHTS.get(content_type, {}).get(name, 2.0) * (EXPANDED if expanded else 1.0)


def given(df: DataFrame, **defaults: Column) -> DataFrame:
    """df with the columns that it lacks."""
    return df.withColumns({n: c for n, c in defaults.items() if n not in df.columns})


def _by_file(df: DataFrame) -> DataFrame:
    """Where files have no key, their path is their key."""
    return given(df, file_key=F.col("file_path"))


def candidate_limit(limit: int, overfetch: int = 10, most: int = 200) -> int:
    return min(max(limit, most), limit * max(2, overfetch))


def fuse(
    branches: DataFrame,
    order: list[str],
    *,
    intent: str | None = None,
    content_type: str | None = None,
    k: int = RRF_K,
    limit: int = 10,
    media: DataFrame | None = None,
    intents: DataFrame | None = None,
) -> DataFrame:
    """One row per query and file: rrf, sources (names joined by +), best_rank, compensated, rrf_rank from 1, by_branch (branch, rank from 1, score).

    branches: query_id, branch, file_key, file_path, hash_seq, score, rank0. order: all branches that were asked, in
    insertion order, which also breaks ties of equal scores. media (file_key,
    content_type) is needed for content type image or video: files that no lexical branch
    found get the missing branches' weight back. intents (query_id, intent): queries with
    an intent of their own, in the place of `intent` where it is not null.
    """
    weights = {b: branch_weight(b, intent, content_type) for b in order}
    of_branch = lambda w: F.element_at(F.create_map(*[F.lit(x) for b in order for x in (b, w[b])]), F.col("branch"))
    weight = of_branch(weights)
    if intents is not None:
        branches = branches.join(intents.select("query_id", F.col("intent").alias("_intent")), "query_id", "left")
        for name in INTENT_WEIGHTS:
            weight = F.when(F.col("_intent") == name, of_branch({b: branch_weight(b, name, content_type) for b in order})).otherwise(weight)
    else:
        branches = branches.withColumn("_intent", F.lit(None).cast("string"))
    position = F.element_at(F.create_map(*[F.lit(x) for i, b in enumerate(order) for x in (b, i)]), F.col("branch"))
    lexical = F.col("branch").contains("fts") | F.col("branch").contains("bm25")
    fused = (
        given(_by_file(branches), score=F.lit(None).cast("double"))
        .withColumn("w", weight / (F.lit(k + 1) + F.col("rank0")))
        .groupBy("query_id", *FILE)
        .agg(
            F.array_sort(F.collect_list(F.struct("branch", (F.col("rank0") + 1).alias("rank"), "score"))).alias("by_branch"),  # a row per branch
            F.sum("w").alias("rrf"),
            F.array_join(F.array_sort(F.collect_set("branch")), "+").alias("sources"),
            F.min("rank0").alias("best_rank"),
            F.min(F.struct(position.alias("branch"), F.col("rank0"), F.col("hash_seq"))).alias("seen"),
            F.max(lexical).alias("lexical"),
            F.max("_intent").alias("_intent"),
        )
    )
    text_weight = sum(w for b, w in weights.items() if "fts" in b or "bm25" in b)
    rest = sum(weights.values()) - text_weight
    compensated: Column = F.lit(False)
    if content_type in ("image", "video") and text_weight > 0 and rest > 0 and media is not None:
        fused = fused.join(_by_file(media).select("file_key", "content_type"), "file_key")
        compensated = F.col("content_type").isin("image", "video") & ~F.col("lexical")

    def regained(w: dict[str, float]) -> float:
        """All weights over those of branches without words."""
        other = sum(x for b, x in w.items() if "fts" not in b and "bm25" not in b)
        return sum(w.values()) / other if other else 1.0

    factor = F.lit(regained(weights))
    for name in INTENT_WEIGHTS if intents is not None else ():
        factor = F.when(F.col("_intent") == name, regained({b: branch_weight(b, name, content_type) for b in order})).otherwise(factor)
    fused = fused.withColumn("compensated", compensated).withColumn("rrf", F.round(F.when(compensated, F.col("rrf") * factor).otherwise(F.col("rrf")), 12))
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "seen", *reversed(FILE))
    ranked = fused.withColumn("rrf_rank", F.row_number().over(w)).where(F.col("rrf_rank") <= candidate_limit(limit))
    return ranked.select("query_id", *FILE, "by_branch", "rrf", "sources", "best_rank", "compensated", "rrf_rank", F.col("seen.hash_seq").alias("hash_seq"))


def is_media(kind: str = "content_type") -> Column:
    return F.coalesce(F.col(kind).isin("image", "video"), F.lit(False))


def overlap_scorer(query: Column, text: Column) -> Column:
    """Default scorer: share of common words."""
    return jaccard(F.array_distinct(words(query, PLAIN_WORD)), F.array_distinct(words(text, PLAIN_WORD)))


def rerank(
    fused: DataFrame,
    details: DataFrame,
    queries: DataFrame,
    *,
    top_k: int = 20,
    enabled: bool = True,
    media_enabled: bool = False,
    query_is_media: bool = False,
    query_media_top_k: int = 5,
    result_media_top_k: int = 10,
    require_ambiguity: bool = True,
    min_margin: float = 0.25,
    scorer=overlap_scorer,
) -> DataFrame:
    """fused plus details of its first-seen chunk (file_key, hash_seq, content_type, ..., without text_body), rerank_score and rerank_path.

    The gates run in order: no reranker (text), top_k 0 (skipped), media present but
    disabled, caps for media, a confident margin between the first two (media only),
    nothing to rerank. Rows that are not reranked score 0.5. scorer(query, text) is a
    column function, for models a pandas UDF. It sees the texts of the first top_k
    ranks only, where they are read: texts enter no exchange of this function.
    """
    joined = _by_file(fused).join(_by_file(details).drop("file_path"), ["file_key", "hash_seq"]).join(queries.select("query_id", F.col("query").alias("_q")), "query_id")
    by_query = Window.partitionBy("query_id")
    half = F.lit(0.5)
    if not enabled or top_k <= 0:
        return joined.drop("_q", "text_body").withColumns({"rerank_score": half, "rerank_path": F.lit("text" if not enabled else "skipped")})
    rank = F.col("rrf_rank")
    seen = F.when(rank <= top_k, F.col("text_body"))
    joined = joined.withColumns({"_told": F.length(F.trim(F.coalesce("text_body", F.lit("")))) > 0, "_own": F.when(rank <= top_k, scorer(F.col("_q"), seen))}).drop("text_body", "_q")
    preview_media = F.max((rank <= top_k) & is_media()).over(by_query)
    media = F.lit(query_is_media) | preview_media
    cap = F.when(F.lit(query_is_media), min(top_k, query_media_top_k)).when(preview_media, min(top_k, result_media_top_k)).otherwise(top_k)
    first, second = (F.max(F.when(rank == i, F.col("rrf"))).over(by_query) for i in (1, 2))
    confident = media & F.lit(require_ambiguity) & second.isNotNull() & (cap >= 2) & (first > 0) & ((first - second) / first >= min_margin)
    content = F.col("_told") | is_media()
    gated = joined.withColumns({"_media": media, "_cap": cap, "_confident": confident})
    gated = gated.withColumn("_in", (rank <= F.col("_cap")) & content)
    gated = gated.withColumn("_some", F.max("_in").over(by_query))
    path = (
        F.when(F.col("_media") & F.lit(not media_enabled), "media_disabled")
        .when(F.col("_cap") <= 0, "skipped")
        .when(F.col("_confident"), "media_confident_skip")
        .when(~F.col("_some") & F.col("_media"), "media_no_rerankable_candidates")
        .when(~F.col("_some"), "no_rerankable_candidates")
        .when(F.lit(query_is_media), "vl_image")
        .when(F.col("_media"), F.when(F.max(F.col("_in") & (F.col("content_type") == "image")).over(by_query), "vl_image").when(F.max(F.col("_in") & (F.col("content_type") == "video")).over(by_query), "vl_video").otherwise("text"))
        .otherwise("text")
    )
    scored = gated.withColumn("rerank_path", path)
    runs = F.col("rerank_path").isin("text", "vl_image", "vl_video") & F.col("_in")
    out = scored.withColumn("rerank_score", F.when(runs, F.col("_own")).otherwise(half))
    return out.drop("_told", "_own", "_media", "_cap", "_confident", "_in", "_some")


def _scaled(value: Column, window, neutral: float) -> Column:
    low, high = F.min(value).over(window), F.max(value).over(window)
    return F.when(high - low < 1e-9, F.lit(neutral)).otherwise((value - low) / (high - low))


def blend(reranked: DataFrame) -> DataFrame:
    """Adds rrf_norm, rerank_norm, rrf_weight and score: a mix of both by rank tier.

    Rerank scores are scaled per modality. Where reranking said nothing (all scores 0.5)
    the scaled rrf is the score.
    """
    by_query = Window.partitionBy("query_id")
    by_kind = Window.partitionBy("query_id", is_media())
    score = F.col("rerank_score")
    low, high = F.min(score).over(by_query), F.max(score).over(by_query)
    meaningful = (low != high) | (low != 0.5)
    all_text = ~F.max(is_media()).over(by_query) & (F.col("rerank_path") == "text")
    tier = lambda a, b, c: F.when(F.col("rrf_rank") <= 3, a).when(F.col("rrf_rank") <= 10, b).otherwise(c)
    out = reranked.withColumns({
        "rrf_norm": _scaled(F.col("rrf"), by_query, 0.0),
        "rerank_norm": _scaled(score, by_kind, 0.5),
        "rrf_weight": F.when(~meaningful, 1.0).when(all_text, tier(*TEXT_TIERS)).otherwise(tier(*MEDIA_TIERS)),
    })
    mixed = F.col("rrf_weight") * F.col("rrf_norm") + (1 - F.col("rrf_weight")) * F.col("rerank_norm")
    return out.withColumn("score", F.round(mixed, 10))


def roll_up(blended: DataFrame, limit: int) -> DataFrame:
    """One row per query and memory: the root hit stands for it if there is one, with the best hit's score and a boost.

    Needs memory_id, memory_role, memory_root_path and tags (array, may be null). Score
    is the best hit's times 1 + min(0.15, 0.03 per further hit). Collection and namespaces
    of the best hit are kept where there are such columns.
    """
    owner = [c for c in ("collection", *NAMESPACES) if c in blended.columns]
    unknown = F.lit(None).cast("double")
    blended = given(_by_file(blended), rrf_norm=unknown, rerank_norm=unknown, by_branch=F.lit(None).cast("array<struct<branch:string,rank:int,score:double>>"))
    hit = F.struct(
        (-F.col("score")).alias("o"), F.col("rrf_rank"), F.col("file_path"), F.col("memory_role"), F.col("memory_root_path"), F.col("title"),
        F.col("tags"), F.col("rrf"), F.col("rerank_score"), F.col("rrf_weight"), F.col("sources"), F.col("rerank_path"), F.col("compensated"),
        F.col("rrf_norm"), F.col("rerank_norm"), F.col("by_branch"), *[F.col(c) for c in owner],
    )
    grouped = blended.groupBy("query_id", F.coalesce("memory_id", "file_key").alias("memory_key")).agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    top = F.col("hits")[0]
    root = F.get(F.filter("hits", lambda h: h["memory_role"] == "root"), F.lit(0))
    canonical = F.coalesce(root["memory_root_path"], top["memory_root_path"], root["file_path"], top["file_path"])
    n = F.size("hits")
    boost = F.lit(1.0) + F.when(n > 1, F.least(F.lit(0.15), (n - 1) * 0.03)).otherwise(0.0)
    rows = grouped.withColumns({"top": top, "root": root, "path": canonical, "n": n, "boost": boost})
    tags = F.array_distinct(F.filter(F.flatten(F.transform("hits", lambda h: F.coalesce(F.transform(h["tags"], lambda t: F.lower(F.trim(t))), F.array().cast("array<string>")))), lambda t: t != ""))
    supporting = F.slice(F.filter(F.transform("hits", lambda h: h["file_path"]), lambda p: (p != F.col("path")) & (p != F.col("top")["file_path"])), 1, 5)
    out = rows.select(
        "query_id", "memory_key", "path",
        F.when(F.col("root").isNotNull(), F.col("root")["title"]).otherwise(F.element_at(F.split("path", "/"), -1)).alias("title"),
        F.round(-F.col("top")["o"] * F.col("boost"), 9).alias("score"),
        F.col("n").alias("hit_count"), F.col("boost"),
        F.col("top")["file_path"].alias("evidence_path"), supporting.alias("supporting_paths"), F.slice(tags, 1, 8).alias("tags"),
        *[F.col("top")[c].alias(c) for c in ("rrf_rank", "rrf", "rerank_score", "rrf_weight", "sources", "rerank_path", "compensated", "rrf_norm", "rerank_norm", "by_branch", *owner)],
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rrf_rank", "path", "memory_key")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def merge_batch(ranked: DataFrame, weights: DataFrame, limit: int, k: int = RRF_K) -> DataFrame:
    """Fuse the results of several queries: ranked (query_id, memory_key, path, rank from 1, score), weights (query_id, weight)."""
    rows = given(ranked, memory_key=F.col("path")).join(weights, "query_id")
    merged = rows.groupBy("memory_key", "path").agg(
        F.round(F.sum(F.col("weight") / (F.lit(k) + F.col("rank"))), 12).alias("score"),
        F.array_join(F.transform(F.array_sort(F.collect_set("query_id")), lambda q: q.cast("string")), ",").alias("source"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("query_id", F.col("score"))))).alias("query_scores"),
        F.max(F.col("score")).alias("best_score"),
        F.min(F.struct("query_id", "rank")).alias("seen"),
    )
    return merged.orderBy(F.desc("score"), "seen", "memory_key").limit(limit).drop("seen")
