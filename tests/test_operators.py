import pytest
from pyspark.sql import functions as F

from lodestore.operators import evaluate, filters, fusion, graph, memories

DETAIL = "file_path string, hash_seq string, content_type string, title string, text_body string, memory_id string, memory_role string, memory_root_path string, tags array<string>"


def ranked(spark, *branches):
    rows = [(1, b, f"doc{d}.md", f"h{d}", i) for b, docs in branches for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "query_id int, branch string, file_path string, hash_seq string, rank0 int")


def details(spark, kinds, memory=None, texts=None):
    rows = [(f"doc{d}.md", f"h{d}", k, f"t{d}", (texts or {}).get(d, f"text {d}"), (memory or {}).get(d), "root", None, ["A ", "b"]) for d, k in kinds.items()]
    return spark.createDataFrame(rows, DETAIL)


QUERY = [(1, "text 1")]


def test_branch_weights():
    w = fusion.branch_weight
    assert w("original_vec") == 2.0 and w("original_vec", content_type="text") == 2.5 and w("original_fts", content_type="image") == 2.5
    assert w("original_fts", "exact_lookup") == 2.5 and w("original_vec", "exact_lookup") == 0.8
    assert w("original_vec_exp1") == 1.0 and w("original_vec_exp2", "semantic") == 1.25 and w("other", "broad") == 0.5


@pytest.mark.parametrize("intent, fts, vec", [("exact_lookup", 2.5, 0.8), ("semantic", 0.8, 2.5), ("broad", 1.0, 1.0)])
def test_rank_zero_scores_weight_over_61(spark, intent, fts, vec):
    df = fusion.fuse(ranked(spark, ("original_vec", [1]), ("original_fts", [2])), ["original_vec", "original_fts"], intent=intent)
    got = {r.file_path: r.rrf for r in df.collect()}
    assert got["doc2.md"] == pytest.approx(fts / 61) and got["doc1.md"] == pytest.approx(vec / 61)


def test_ties_follow_insertion_order(spark):
    df = fusion.fuse(ranked(spark, ("original_fts", [5, 6]), ("original_vec", [7, 8])), ["original_vec", "original_fts"])
    assert [r.file_path for r in df.orderBy("rrf_rank").collect()] == ["doc7.md", "doc5.md", "doc8.md", "doc6.md"]


def test_media_compensation_only_without_lexical_hit(spark):
    media = spark.createDataFrame([(f"doc{i}.md", "image") for i in (1, 2)], "file_path string, content_type string")
    df = fusion.fuse(ranked(spark, ("original_vec", [1, 2]), ("original_fts", [2])), ["original_vec", "original_fts"], content_type="image", media=media)
    got = {r.file_path: (r.rrf, r.compensated) for r in df.collect()}
    assert got["doc1.md"] == (pytest.approx(1.5 / 61 * 4 / 1.5), True) and got["doc2.md"] == (pytest.approx(1.5 / 62 + 2.5 / 61), False)


def blended(spark, docs, kinds=None, **options):
    fused = fusion.fuse(ranked(spark, ("original_vec", docs)), ["original_vec"], limit=20)
    q = spark.createDataFrame(QUERY, "query_id int, query string")
    return fusion.blend(fusion.rerank(fused, details(spark, kinds or {d: "text" for d in docs}), q, **options))


def test_text_tiers(spark):
    rows = {r.rrf_rank: r.rrf_weight for r in blended(spark, list(range(1, 13))).collect()}
    assert rows[1] == rows[3] == 0.90 and rows[4] == rows[10] == 0.85 and rows[11] == 0.75


def test_media_gates(spark):
    kinds = {1: "image", 2: "text", 3: "video"}
    off = blended(spark, [1, 2, 3], kinds).collect()
    assert {r.rerank_path for r in off} == {"media_disabled"} and {r.rerank_score for r in off} == {0.5} and {r.rrf_weight for r in off} == {1.0}
    on = blended(spark, [1, 2, 3], kinds, media_enabled=True).collect()
    assert {r.rerank_path for r in on} == {"vl_image"} and {r.rrf_weight for r in on} == {0.75}
    sure = blended(spark, [1, 2, 3], kinds, media_enabled=True, min_margin=0.001).collect()
    assert {r.rerank_path for r in sure} == {"media_confident_skip"}
    assert {r.rerank_path for r in blended(spark, [1, 2], enabled=False).collect()} == {"text"}
    assert {r.rerank_path for r in blended(spark, [1, 2], top_k=0).collect()} == {"skipped"}


def test_single_candidate_scores_zero_in_embed_mode(spark):
    assert blended(spark, [1], enabled=False).first().score == 0.0


def test_roll_up_boost(spark):
    fused = fusion.fuse(ranked(spark, ("original_vec", [1, 2, 3])), ["original_vec"])
    q = spark.createDataFrame(QUERY, "query_id int, query string")
    rows = fusion.blend(fusion.rerank(fused, details(spark, dict.fromkeys((1, 2, 3), "text"), {1: "m", 2: "m", 3: "n"}), q, enabled=False))
    got = {r.memory_key: r for r in fusion.roll_up(rows, 10).collect()}
    assert got["m"].boost == pytest.approx(1.03) and got["n"].boost == 1.0 and got["m"].hit_count == 2
    assert got["m"].tags == ["a", "b"] and got["m"].evidence_path == "doc1.md" and got["m"].score == pytest.approx(1.03)


def test_filters(spark):
    df = spark.createDataFrame([("c", "u", "a_b", None, 1, None), ("c", None, "a_b::x", "a_b", 0, 5), ("d", "u", "axb::y", None, None, 20)], "collection string, user_id string, file_path string, memory_root_path string, active int, expires_at long")
    n = lambda c: df.where(c).count()
    assert n(filters.visible()) == 2 and n(filters.live(10)) == 2 and n(filters.in_family("a_b")) == 2
    assert n(filters.within(collection="c", user_id="u")) == 1 and n(filters.within(collection="", user_id=None)) == 3
    with pytest.raises(ValueError):
        filters.within(collection="x' OR 1=1")


def test_policy(spark):
    day = 86_400_000
    df = spark.createDataFrame([(2.0, 100 * day), (-1.0, 95 * day), (None, 75 * day), (0.5, 10 * day), (None, 101 * day)], "importance double, embedded_at long")
    assert [round(r[0], 9) for r in df.select(filters.policy(100 * day)).collect()] == [1.2, 1.05, 1.025, 1.075, 1.0]


def test_co_mentions_and_related(spark):
    rows = [("c1", "m1", "p1", "f1", i, f"k{i}", f"n{i}", "e" * i) for i in range(1, 16)] + [("c2", "m2", "p2", "f2", 1, "k1", "n1", "e"), ("c3", "m3", "p3", "f3", 1, "zz", "z", "e")]
    df = spark.createDataFrame(rows, "hash_seq string, memory_id string, path string, file_path string, ord int, entity_key string, name string, evidence string")
    edges = graph.co_mentions(df)
    assert edges.count() == 48 and edges.where("subject_key = 'k1'").count() == 11
    got = graph.related_memories(df, spark.createDataFrame([("m1",)], "memory_id string")).collect()
    assert [(r.memory_id, r.score) for r in got] == [("m2", 11)]


def test_conversations(spark):
    df = spark.createDataFrame([(1, 0, "User", "hi  there"), (1, 1, None, "ok"), (1, 2, "user", " ")], "conv_id long, turn long, role string, text string")
    turns = memories.conversation_turns(df)
    assert [(r.file_path, r.role, r.total) for r in turns.orderBy("seq").collect()] == [("conv/1::turn:0001", "user", 2), ("conv/1::turn:0002", "speaker", 2)]
    root = memories.conversation_roots(turns).first()
    assert root.tags == ["conversation", "turns:2", "role:user", "role:speaker"] and "- Turn 1 user: hi there" in root.text_body


def test_metrics(spark):
    ranked_ = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "x", 1)], "query_id int, item string, rank int")
    judged = spark.createDataFrame([(1, "b", 2), (1, "c", 1), (2, "y", 1), (3, "z", 1)], "query_id int, item string, relevance int")
    got = {r.query_id: r for r in evaluate.query_metrics(ranked_, judged).collect()}
    assert got[1].hit_at_1 == 0 and got[1].hit_at_5 == 1 and got[1].rr == 0.5 and got[2].rr == 0 and got[3].rr == 0
    assert got[1].ndcg_retrieved == pytest.approx((2 / 1.5849625 + 1 / 2) / (2 + 1 / 1.5849625)) and got[1].precision_at_5 == pytest.approx(3 / 2 / 3)
    values = spark.createDataFrame([(float(i),) for i in range(1, 21)], "v double")
    assert tuple(evaluate.percentiles(values, "v").first()) == (10.0, 19.0, 11.0, 20.0)


def test_diagnostics(spark):
    df = spark.createDataFrame([("a", 0.1, 0.3, 0.5, 0.2), ("b", 0.9, 1.0, 1.0, 0.9)], "group string, hit_at_1 double, hit_at_5 double, hit_at_10 double, mrr double")
    got = {r.group: (r.issue, r.priority) for r in evaluate.diagnostics(df).collect()}
    assert got == {"a": ("recall", 0.5), "b": ("none", 0.0)}
    assert df.select(F.lit(1)).count() == 2


def test_stage_diagnostics(spark):
    """Stages that gain and lose, a category of one query, repeated rows, a query without hits, a stage that did not run, an empty table."""
    hits = [("vector", q, f"i{q}", 1 if q < 4 else 7) for q in range(10)] + [("rrf", q, f"i{q}", 1 if q < 8 else 7) for q in range(10)] + [("hybrid", q, f"i{q}", 1 if q < 5 else 11) for q in range(10)]
    hits += [*hits[:5], ("rrf", 0, None, 1), ("other", 0, "i0", 1)]
    df = spark.createDataFrame(hits, "stage string, query_id int, item string, rank int")
    targets = spark.createDataFrame([(q, f"i{q}") for q in range(11)] * 2 + [(0, None)], "query_id int, item string")
    categories = spark.createDataFrame([(q, "all") for q in range(10)] + [(0, "one"), (0, "one"), (10, "none")], "query_id int, category string")
    got = {r.category: r for r in evaluate.stage_diagnostics(df, targets, categories, media=("all", "none")).collect()}
    whole = got["all"]
    assert (whole.queries, whole.vector_at_5, whole.vector_at_10, whole.rrf_at_5, whole.hybrid_at_5, whole.bm25_at_5) == (10, 0.4, 1.0, 0.8, 0.5, None)
    assert whole.issues == ["embedding_gap", "fusion_lift", "rerank_regression"] and whole.best_stage == "rrf" and whole.priority == 0.05
    assert got["one"].issues == ["under_sampled"] and got["one"].best_stage == "vector" and got["one"].priority == 0.15
    assert got["none"].issues == ["under_sampled", "embedding_gap", "fusion_no_lift", "rerank_no_lift"] and got["none"].priority == 0.8
    empty = evaluate.stage_diagnostics(df.limit(0), targets, categories).collect()
    assert all(r.vector_at_5 is None and r.best_stage is None for r in empty) and len(empty) == 3
    assert evaluate.stage_diagnostics(df, targets, categories.limit(0)).count() == 0


def test_graph_equals_plain_python(spark):
    """Co-mentions, related memories and listed entities of many mentions against loops."""
    import random
    from itertools import combinations

    r = random.Random(3)
    rows = []
    for c in range(30):
        keys = r.sample([f"k{i}" for i in range(40)], r.randint(1, 20))
        rows += [(f"c{c}", f"m{c % 9}", f"p{c % 9}", f"f{c}", i + 1, k, k.upper(), "e" * r.randint(0, 9)) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "hash_seq string, memory_id string, path string, file_path string, ord int, entity_key string, name string, evidence string").repartition(4)
    want = set()
    for c in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == c), key=lambda x: x[4])[:12]
        for n, (a, b) in enumerate(list(combinations(own, 2))[:48], 1):
            want.add((c, a[5], b[5], n, a[7] if len(a[7]) >= len(b[7]) else b[7]))
    assert {(e.hash_seq, e.subject_key, e.object_key, e.pair, e.evidence) for e in graph.co_mentions(df).collect()} == want
    mine = {x[5] for x in rows if x[1] == "m0"}
    score = {m: 10 * len(mine & {x[5] for x in rows if x[1] == m}) + sum(x[1] == m and x[5] in mine for x in rows) for m in {x[1] for x in rows} - {"m0"}}
    order = sorted(((-s, m.replace("m", "p")) for m, s in score.items() if s))[:4]
    got = graph.related_memories(df, spark.createDataFrame([("m0",)], "memory_id string"), 4).collect()
    assert [(-x.score, x.path) for x in got] == order
    listed = [(x.name, x.path, x.ord) for x in graph.list_entities(df, 25).collect()]
    assert listed == sorted(((x[6], x[2], x[4]) for x in rows), key=lambda x: (x[0].lower(), x[1], x[2]))[:25]


@pytest.mark.parametrize("seed", range(3))
def test_ranks_are_selected_over_partitions(spark, monkeypatch, seed):
    import random

    r = random.Random(seed)
    monkeypatch.setattr(evaluate, "PROBES", 4)  # several passes
    values = [r.choice([7.0, 7.0, r.gauss(0, 1), r.gauss(0, 1e6), 1e-300, 5e-324, 0.0, -1e308, 1e308, None, float("nan"), float("inf"), float("-inf")]) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    known = sorted(v for v in values if v is not None and v == v)
    ranks = [0, 40, 70, len(known) // 3, len(known) // 2, len(known) - 1, len(known), -1]
    assert evaluate.selected(df, "x", ranks) == [*(known[k] for k in ranks[:6]), None, None]
    assert evaluate.selected(df.where("x is null"), "x", [0]) == [None]
