"""Retrieval metrics and stage metrics as aggregates."""

from __future__ import annotations

from math import ceil, inf

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def query_metrics(ranked: DataFrame, judged: DataFrame, *, grades: int = 2) -> DataFrame:
    """Per query: hit_at_1/5/10, rr (all ranks), rr_at_10, ndcg_retrieved, precision_at_5/10.

    ranked: query_id, item, rank from 1. judged: query_id, item, relevance (0..grades).
    The ideal order of ndcg is that of the retrieved items. Graded precision is divided by
    the best grade and the number of items shown, at most k. Queries without results score 0.
    """
    rows = ranked.join(judged.select("query_id", "item", "relevance"), ["query_id", "item"], "left").fillna(0, ["relevance"])
    asked = judged.select("query_id").distinct()
    hit = lambda k: F.max(((F.col("rank") <= k) & (F.col("relevance") > 0)).cast("double"))
    first = F.min(F.when(F.col("relevance") > 0, F.col("rank")))
    top = F.array_sort(F.collect_list(F.when(F.col("rank") <= 10, F.struct("rank", "relevance"))))
    gain = lambda a: F.aggregate(F.transform(a, lambda r, i: r / F.log2(i + 2.0)), F.lit(0.0), lambda s, x: s + x)
    grouped = rows.groupBy("query_id").agg(
        *[hit(k).alias(f"hit_at_{k}") for k in (1, 5, 10)], first.alias("first"), top.alias("top"),
        *[(F.sum(F.when(F.col("rank") <= k, F.col("relevance"))) / grades / F.least(F.lit(k), F.count("*"))).alias(f"precision_at_{k}") for k in (5, 10)],
    )
    found = F.transform("top", lambda t: t["relevance"].cast("double"))
    ideal = F.reverse(F.array_sort(found))
    scored = grouped.select(
        "query_id", *[f"hit_at_{k}" for k in (1, 5, 10)], F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"),
        F.when(F.col("first") <= 10, 1.0 / F.col("first")).otherwise(0.0).alias("rr_at_10"),
        F.when(gain(ideal) > 0, gain(found) / gain(ideal)).otherwise(0.0).alias("ndcg_retrieved"), *[f"precision_at_{k}" for k in (5, 10)],
    )
    return asked.join(scored, "query_id", "left").fillna(0.0)


def mean_metrics(per_query: DataFrame) -> DataFrame:
    return per_query.agg(*[F.avg(c).alias(c) for c in per_query.columns if c != "query_id"], F.count("*").alias("queries"))


#: Parts that a stretch of values is cut into per pass.
PROBES = 1024


def selected(values: DataFrame, column: str, ranks: list[int]) -> list[float | None]:
    """The values of the given ranks (from 0; nulls and NaN do not count) in a numeric column, exactly; None beyond the last.

    Each pass counts, per rank that is still open, the values of its stretch in PROBES
    equal parts, with the least and greatest of each part: a few numbers per part, by
    partial sums. The part with the rank is the next stretch; it is settled once its
    least and greatest are one value, however many rows have it.
    """
    rows = values.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    finite = F.abs("v") < float("inf")
    whole = rows.agg(
        F.min(F.when(finite, F.col("v"))).alias("a"), F.max(F.when(finite, F.col("v"))).alias("b"), F.count("*").alias("n"),
        F.count_if(~finite & (F.col("v") < 0)).alias("low"), F.count_if(~finite & (F.col("v") > 0)).alias("high"),
    ).first()
    rows = rows.where(finite)
    found: dict[int, float | None] = {r: None for r in ranks if not 0 <= r < whole.n}
    found |= {r: -inf for r in ranks if 0 <= r < whole.low} | {r: inf for r in ranks if whole.n - whole.high <= r < whole.n}
    stretch = {r: (whole.a, whole.b, whole.low) for r in ranks if r not in found}  # least, greatest, values below
    while stretch:
        found |= {r: a for r, (a, b, _) in stretch.items() if a == b}
        stretch = {r: x for r, x in stretch.items() if r not in found}
        if not stretch:
            break
        spans = sorted({(a, b) for a, b, _ in stretch.values()})

        def part(a: float, b: float) -> Column:
            """0 for a, the last for b; scaled, as the difference of large values can be infinite and that of small ones vanish."""
            s = 0.5 if b - a == inf else 2.0**500 if b - a < 1e-290 else 1.0
            return F.least(F.floor((F.col("v") * s - a * s) / (b * s - a * s) * PROBES), F.lit(PROBES - 1))

        spot = F.array_compact(F.array(*[F.when(F.col("v").between(a, b), F.struct(F.lit(i).alias("span"), part(a, b).alias("part"))) for i, (a, b) in enumerate(spans)]))
        got = rows.select("v", F.inline(spot)).groupBy("span", "part").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("*").alias("n"))
        counts: dict[tuple[float, float], list] = {}
        for x in got.orderBy("span", "part").collect():  # PROBES rows per open rank at most
            counts.setdefault(spans[x.span], []).append((x.a, x.b, x.n))
        for r, (a, b, below) in stretch.items():
            for low, high, n in counts[a, b]:
                if r < below + n:
                    stretch[r] = (low, high, below)
                    break
                below += n
    return [found[r] for r in ranks]


def percentiles(values: DataFrame, column: str, shares=(0.5, 0.95)) -> DataFrame:
    """Nearest-rank percentiles (element ceil(p n)) and the plain-index ones (element int(p n), from 0), null without values."""
    n = values.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).count()
    ranks = {f"p{round(p * 100)}": max(0, ceil(p * n) - 1) for p in shares} | {f"i{round(p * 100)}": min(int(p * n), n - 1) for p in shares}
    got = selected(values, column, list(ranks.values()))
    return values.sparkSession.createDataFrame([tuple(got)], ", ".join(f"{name} double" for name in ranks))


def stage_metrics(hits: DataFrame) -> DataFrame:
    """Count, least, greatest and mean score by stage and content type."""
    return hits.groupBy("stage", "content_type").agg(
        F.count("*").alias("n"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.round(F.avg("score"), 9).alias("mean_score")
    )


def neighbour_recall(neighbours: DataFrame, ks=(1, 5, 10)) -> DataFrame:
    """Share of queries with a neighbour of their own label among the first k. neighbours: query_id, label, found_label, rank."""
    per = neighbours.groupBy("query_id").agg(*[F.max(((F.col("rank") <= k) & (F.col("label") == F.col("found_label"))).cast("double")).alias(f"recall_at_{k}") for k in ks])
    return per.agg(*[F.avg(f"recall_at_{k}").alias(f"recall_at_{k}") for k in ks], F.count("*").alias("queries"))


def diagnostics(per_group: DataFrame, target: float = 0.6) -> DataFrame:
    """Rule-coded issue and priority per group: group, hit_at_1, hit_at_5, hit_at_10, mrr."""
    gap = F.greatest(F.lit(0.0), F.lit(target) - F.col("hit_at_5"))
    issue = F.when(F.col("hit_at_10") < target, "recall").when(F.col("hit_at_1") < F.col("hit_at_10") - 0.25, "ranking").when(F.col("mrr") < 0.4, "depth").otherwise("none")
    extra = F.when(issue == "recall", 0.15).otherwise(0.0) + F.when(issue == "ranking", 0.05).otherwise(0.0) + F.when(F.col("mrr") < 0.4, 0.05).otherwise(0.0)
    return per_group.withColumns({"issue": issue, "priority": F.round(gap + extra, 9)})


#: Roles of stages in the order in which results pass them.
STAGES = ["vector", "bm25", "rrf", "hybrid"]


def stage_diagnostics(
    hits: DataFrame, targets: DataFrame, categories: DataFrame, *, media: tuple[str, ...] = (), least: int = 10, weak: float = 0.6, delta: float = 0.05
) -> DataFrame:
    """Per category: queries, the share of them that each stage finds among 5 and 10, the best stage, issues and a priority.

    hits: stage (one of STAGES), query_id, item, rank from 1. targets: query_id, item.
    categories: query_id, category; a query may be in several. A stage that has no hit at all
    is null, one without hits for a query misses it. Issues are the codes that apply: under_sampled (fewer
    than `least` queries), embedding_gap (a weak vector stage in a media category), fusion_lift
    or fusion_no_lift (what rrf adds to vector), rerank_regression or rerank_no_lift (what
    hybrid adds to rrf). priority is the best stage's distance to `weak`, plus 0.15 if under
    sampled and 0.05 for media. Repeated rows count once; nulls match nothing.
    """
    found = hits.where("rank <= 10").join(targets.select("query_id", "item").distinct(), ["query_id", "item"]).groupBy("query_id", "stage").agg(F.min("rank").alias("rank"))
    ran = F.broadcast(hits.where(F.col("stage").isin(STAGES)).agg(*[F.coalesce(F.bool_or(F.col("stage") == s), F.lit(False)).alias(f"has_{s}") for s in STAGES]))
    per = found.groupBy("query_id").agg(*[F.min(F.when(F.col("stage") == s, F.col("rank"))).alias(s) for s in STAGES])
    asked = categories.select("query_id", "category").distinct().join(per, "query_id", "left")
    share = lambda s, k: F.avg(F.coalesce(F.col(s) <= k, F.lit(False)).cast("double"))
    rows = asked.groupBy("category").agg(F.count("*").alias("queries"), *[share(s, k).alias(f"{s}_at_{k}") for s in STAGES for k in (5, 10)])
    rows = rows.crossJoin(ran)  # one row
    rows = rows.withColumns({f"{s}_at_{k}": F.when(F.col(f"has_{s}"), F.col(f"{s}_at_{k}")) for s in STAGES for k in (5, 10)})
    best = F.coalesce(F.greatest(*[f"{s}_at_5" for s in STAGES]), F.lit(0.0))
    rows = rows.withColumn("best", best).withColumn("best_stage", F.coalesce(*[F.when(F.col(f"{s}_at_5") == F.col("best"), s) for s in STAGES]))
    gained = lambda a, b, k: F.round(F.col(f"{a}_at_{k}") - F.col(f"{b}_at_{k}"), 9)
    visual, poor, few = F.col("category").isin(list(media)), F.col("best") < weak, F.col("queries") < least
    lift = (gained("rrf", "vector", 5) >= delta) | (gained("rrf", "vector", 10) >= delta)
    turned = gained("hybrid", "rrf", 5)
    fits = {
        "under_sampled": few, "embedding_gap": visual & (F.col("vector_at_5") < weak), "fusion_lift": lift, "fusion_no_lift": ~lift & visual & poor,
        "rerank_regression": turned <= -delta, "rerank_no_lift": poor & (F.abs(turned) < delta),
    }
    issues = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in fits.items()]))
    priority = F.greatest(F.lit(0.0), weak - F.col("best")) + F.when(few, 0.15).otherwise(0.0) + F.when(visual, 0.05).otherwise(0.0)
    return rows.withColumns({"issues": issues, "priority": F.round(priority, 9)}).drop("best", *[f"has_{s}" for s in STAGES])


def query_categories(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, category): a query counts in every category that fits.

    queries: query_id, query. targets: query_id, content_type of its relevant items.
    text_only and image_only by all targets, cross_modal where words and targets differ
    in kind, short_query up to 2 words, long_query from 6.
    """
    kinds = targets.groupBy("query_id").agg(F.max(F.col("content_type") == "image").alias("image"), F.max(F.col("content_type") == "text").alias("text"))
    image, text = (F.coalesce(F.col(c), F.lit(False)) for c in ("image", "text"))
    says = F.lower("query").rlike("diagram|visual|image|picture|photo")
    words = F.size(F.filter(F.split("query", r"\s+"), lambda w: w != ""))
    fits = {"image_only": image & ~text, "text_only": text & ~image, "cross_modal": image != says, "short_query": words <= 2, "long_query": words >= 6}
    named = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in fits.items()]))
    return queries.join(kinds, "query_id", "left").select("query_id", F.explode(named).alias("category"))


def with_typo(query: Column, seed: int = 42) -> Column:
    """A query with two neighbouring letters of one word swapped, both chosen by a hash; short words and single words stay."""
    words = F.split(query, r"\s+")
    at = F.pmod(F.xxhash64(query, F.lit(seed)), F.size(words)).cast("int")
    word = F.get(words, at)
    place = (F.pmod(F.xxhash64(query, F.lit(seed + 1)), F.greatest(F.length(word) - 1, F.lit(1))) + 1).cast("int")
    swapped = F.concat(F.substring(word, F.lit(1), place - 1), F.substring(word, place + 1, F.lit(1)), F.substring(word, place, F.lit(1)), F.substring(word, place + 2, F.length(word)))
    turned = F.array_join(F.transform(words, lambda w, i: F.when(i == at, swapped).otherwise(w)), " ")
    return F.when((F.size(words) < 2) | (F.length(word) < 3), query).otherwise(turned)
