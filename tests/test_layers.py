"""The store's layers, delete vectors and versions, and searches over them: keys, segments, other writers."""

import re
import threading

import pytest
from pyspark.sql import functions as F

from lodestore.operators import retrieval
from lodestore.plans import index, search
from lodestore.plans.store import MAX_GONE, Conflict, Store

TEXTS = "collection string, file_path string, user_id string, text string"
NOW = 5000


def texts(spark, *rows):
    return spark.createDataFrame([(c, p, None, t) for c, p, t in rows], TEXTS)


def filled(spark, root):
    s = Store(spark, str(root))
    s.upsert_memory(texts(spark, ("c", "a.md", "apple apple durian"), ("c", "b.md", "apple apple durian"), ("k", "a.md", "apple cherry"), ("c", "d.md", "durian fig"), ("k", "z.md", "grape")), now_ms=NOW)
    return s


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    return filled(spark, tmp_path_factory.mktemp("layers") / "s")


def asked(spark, *queries):
    return spark.createDataFrame([(i, q, None) for i, q in enumerate(queries)], "query_id int, query string, vector array<float>")


def hits(spark, found, *queries, posted=True, **scope):
    rows = search.searchable(found.chunks, NOW, **scope)
    got = retrieval.bm25(rows, asked(spark, *queries), as_of_ms=NOW, posted=found.postings if posted else None)
    owner = found.chunks.select("file_key", "collection").distinct()
    return sorted((r.query_id, r.rank0, r.collection, r.file_path, round(r.score, 9)) for r in got.join(owner, "file_key").collect())


def plain(spark, db):
    """The same without the index: postings are made from the chunks, whose keys do not matter."""
    return index.Index(db.table("embeddings"), None)


def test_equal_texts_at_two_paths_are_two_hits(spark, store):
    found = index.of_store(store)
    for scope in ({}, {"collection": "c"}):
        got = hits(spark, found, "apple durian", **scope)
        assert got == hits(spark, plain(spark, store), "apple durian", posted=False, **scope)
        assert {(c, p) for _, _, c, p, _ in got} >= {("c", "a.md"), ("c", "b.md"), ("c", "d.md")}


def test_one_path_in_two_collections_is_two_memories(spark, store):
    found = index.of_store(store)
    got = search.hybrid(found.chunks, asked(spark, "apple"), as_of_ms=NOW, posted=found.postings).collect()
    assert sorted((r.collection, r.path) for r in got) == [("c", "a.md"), ("c", "b.md"), ("k", "a.md")]
    merged = search.search_batch(found.chunks, asked(spark, "apple", "cherry").withColumn("weight", F.lit(1.0)), as_of_ms=NOW, posted=found.postings).collect()
    assert sorted(r.path for r in merged) == ["a.md", "a.md", "b.md"]


def test_blocks_tell_collections_apart(spark, store):
    rows = store.table("embeddings").withColumn("vector", F.array(F.length("text_body").cast("float"), F.lit(1.0).cast("float")))
    q = spark.createDataFrame([(0, [1.0, 0.1])], "query_id int, vector array<float>")
    told = lambda **o: sorted((r.file_key, r.file_path, r.rank0, r.score) for r in retrieval.vector_search(rows, q, as_of_ms=NOW, **o).collect())
    assert told() == told(blocks=True) and len(told()) == 5


def test_ranking_keeps_few_rows_before_its_exchange(spark, store):
    found = index.of_store(store)
    plan = retrieval.bm25(found.chunks, asked(spark, "apple"), as_of_ms=NOW, posted=found.postings)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4


def test_an_upsert_writes_one_segment_and_a_delete_none(spark, tmp_path):
    db = filled(spark, tmp_path / "s")
    before = index.segments(db)
    layers = {y["place"]: y["bytes"] for x in db.manifest()["tables"]["embeddings"].values() for y in x["layers"]}
    db.upsert_memory(texts(spark, ("c", "a.md", "apple kiwi")), now_ms=NOW + 1)
    after = index.segments(db)
    assert set(before) < set(after) and len(after) == len(before) + 1  # what was there stays, with the replaced row in it
    assert hits(spark, index.of_store(db), "apple durian kiwi") == hits(spark, plain(spark, db), "apple durian kiwi", posted=False)
    db.upsert_memory(texts(spark, ("c", "a.md", "apple apple durian")), now_ms=NOW + 2)  # the first text again: its old postings must not come back
    assert hits(spark, index.of_store(db), "apple durian kiwi") == hits(spark, plain(spark, db), "apple durian kiwi", posted=False)
    assert db.delete_path("b.md", "c") == 1
    assert set(index.segments(db)) >= set(after) and len(index.segments(db)) == len(after) + 1
    now = hits(spark, index.of_store(db), "apple durian")
    assert now == hits(spark, plain(spark, db), "apple durian", posted=False) and ("c", "b.md") not in {x[2:4] for x in now}
    assert all(db.manifest()["tables"]["embeddings"]["c"]["layers"][0]["place"] in layers for _ in (0,))
    version = db.version()
    old = db.table("embeddings", version=1).where("file_path = 'b.md'").count()
    assert old == 1 and db.table("embeddings").where("file_path = 'b.md'").count() == 0
    assert db.fold(every=True) > 0 and db.version() == version + 1
    assert all(len(x["layers"]) <= 1 and not x["gone"] for parts in db.manifest()["tables"].values() for x in parts.values())
    assert hits(spark, index.of_store(db), "apple durian") == now
    assert db.compact() > 0 and index.sweep(db) >= 1 and hits(spark, index.of_store(db), "apple durian") == now


def test_rows_of_one_key_in_a_call_are_one(spark, tmp_path):
    db = Store(spark, str(tmp_path / "s"))
    db.upsert({"cache": spark.createDataFrame([("k", "v", 1), ("k", "v", 1)], "key string, value string, created_at long")})
    assert db.table("cache").count() == 1


def test_many_small_writes_fold(spark, tmp_path):
    db = Store(spark, str(tmp_path / "s"))
    for i in range(MAX_GONE + 2):
        db.upsert({"cache": spark.createDataFrame([("same", str(i), i), (f"k{i}", "v", i)], "key string, value string, created_at long")})
        db.fold()
    held = db.manifest()["tables"]["cache"]["all"]
    assert len(held["layers"]) < 9 and db.table("cache").where("key = 'same'").first().value == str(MAX_GONE + 1) and db.table("cache").count() == MAX_GONE + 3


def test_writers_of_other_collections_both_land(spark, tmp_path):
    one, two = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    base = one.manifest()
    rows = lambda c: spark.createDataFrame([(f"i{c}", c, "p", "h", "text", 1, 1, 1)], "id string, collection string, file_path string, content_hash string, content_type string, active byte, created_at long, updated_at long")
    first = one.stage({"documents": rows("c")}, {"documents": []}, base=base)
    other = two.stage({"documents": rows("d")}, {"documents": []}, base=base)
    same = two.stage({"documents": rows("c")}, {"documents": []}, base=base)
    assert (one.promote(first), two.promote(other)) == (1, 2)
    with pytest.raises(Conflict):
        two.promote(same)
    two.abort(same)
    assert sorted(r.collection for r in one.table("documents").collect()) == ["c", "d"]


def test_concurrent_writers_of_one_part_all_land(spark, tmp_path):
    stores = [Store(spark, str(tmp_path / "s")) for _ in range(3)]
    row = lambda i: spark.createDataFrame([(f"k{i}", "v", i), ("both", str(i), i)], "key string, value string, created_at long")
    threads = [threading.Thread(target=s.upsert, args=({"cache": row(i)},)) for i, s in enumerate(stores)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    held = {r.key: r.value for r in stores[0].table("cache").collect()}
    assert set(held) == {"k0", "k1", "k2", "both"} and stores[0].table("cache").count() == 4
    assert stores[0].version() == 3 and sum(s.published for s in stores) == 3 and sum(s.retried for s in stores) >= 1


def test_queries_of_a_batch_have_intents_and_modes_of_their_own(spark, store):
    found = index.of_store(store)
    rows = found.chunks.withColumn("vector", F.array(F.length("text_body").cast("float"), F.lit(3.0).cast("float")))
    kinds = [(0, "apple durian", None, None), (1, "apple durian", "exact_lookup", None), (2, "apple durian", "semantic", "hybrid"), (3, "apple durian", None, "fts"), (4, "apple durian", "broad", "vec")]
    queries = spark.createDataFrame([(i, q, [1.0, 0.5], n, m) for i, q, n, m in kinds], "query_id int, query string, vector array<float>, intent string, mode string")
    told = lambda df: sorted((r.query_id, r.collection, r.path, r.sources, round(r.rrf, 9)) for r in df.collect())
    got = told(search.hybrid(rows, queries, as_of_ms=NOW, posted=found.postings))
    want = []
    for i, _, intent, mode in kinds:
        modes = {"fts": ("fts",), "vec": ("vec",)}.get(mode, ("vec", "fts"))
        want += told(search.hybrid(rows, queries.where(F.col("query_id") == i).drop("intent", "mode"), as_of_ms=NOW, posted=found.postings, intent=intent, modes=modes))
    assert got == sorted(want) and len({x[4] for x in got}) > 5


def test_postings_of_a_store_travel_as_one_row_per_chunk(spark, store):
    """a search over segments exchanged every posting with its chunk's id, and writing them dealt all of them out by term."""
    found = index.of_store(store)
    plan = retrieval.bm25(found.chunks, asked(spark, "apple durian"), as_of_ms=NOW, posted=found.postings)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" in plan and not re.search(r"Exchange hashpartitioning\(_segment", plan)
    assert hits(spark, found, "apple durian apple") == hits(spark, plain(spark, store), "apple durian apple", posted=False)
