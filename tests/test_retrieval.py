"""Search branches over written indexes and in blocks against the plain paths and plain Python."""

import math
import re

import pytest
from pyspark.sql import functions as F

from lodestore import catalogue
from lodestore.operators import retrieval
from lodestore.plans import index, search

NOW = 1_000_000


@pytest.fixture(scope="module")
def chunks(spark):
    said = ["red fox red", "the lazy dog", "", None, "Fox and dog and fox", "red red red dog", "über fox_1 99", "dog"]
    rows = [(f"h{i}", f"f{i % 5}", t, [math.sin(i + 1), math.cos(i), 0.5] if i != 3 else None, 0.5 if i % 2 else None, NOW - i, "text") for i, t in enumerate(said)]
    made = spark.createDataFrame(rows, "hash_seq string, file_path string, text_body string, vector array<float>, importance float, embedded_at long, content_type string").repartition(3)
    return made.select("hash_seq", "file_path", F.coalesce("text_body", F.lit("")).alias("text_body"), "vector", "importance", "embedded_at", "content_type")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "red dog dog", [1.0, 0.0, 0.2]), (2, "", [0.0, 1.0, 0.0]), (3, "absent", None), (4, None, [0.0, 0.0, 0.0])], "query_id int, query string, vector array<float>")


def got(df):
    return sorted(map(tuple, df.select("query_id", "file_path", "hash_seq", "rank0", F.round("score", 8)).collect()))


def test_stored_postings_change_nothing(spark, chunks, queries, tmp_path):
    plain = got(retrieval.bm25(chunks, queries, as_of_ms=NOW, limit=3))
    kept = index.written(spark, chunks, str(tmp_path / "i"))
    assert plain and got(retrieval.bm25(kept.chunks, queries, as_of_ms=NOW, limit=3, posted=kept.postings)) == plain
    some = chunks.where("hash_seq <> 'h0'")  # postings may hold more than what is searched
    assert got(retrieval.bm25(some, queries, as_of_ms=NOW, limit=3, posted=kept.postings)) == got(retrieval.bm25(some, queries, as_of_ms=NOW, limit=3))
    none = kept.chunks.where("false")
    assert retrieval.bm25(none, queries, as_of_ms=NOW, posted=kept.postings).count() == 0


def test_blocks_equal_the_expression_path(spark, chunks, queries, monkeypatch):
    plain = got(retrieval.vector_search(chunks, queries, as_of_ms=NOW, limit=2))
    assert plain and got(retrieval.vector_search(chunks, queries, as_of_ms=NOW, limit=2, blocks=True)) == plain
    monkeypatch.setattr(retrieval, "MAX_BROADCAST_QUERIES", 1)  # more query blocks than one
    assert got(retrieval.vector_search(chunks, queries, as_of_ms=NOW, limit=2, blocks=True)) == plain
    assert retrieval.vector_search(chunks, queries.where("false"), as_of_ms=NOW, blocks=True).count() == 0


def test_neighbours(spark):
    vecs = [(i, [math.sin(i), math.cos(2 * i), 1.0]) for i in range(40)] + [(50, [math.sin(3), math.cos(6), 1.0]), (51, None)]
    rows = spark.createDataFrame(vecs, "vec_id long, embedding array<double>").repartition(3)
    asked = rows.where("vec_id in (3, 7, 50)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    want = {(q, v, r + 1) for q in (3, 7, 50) for r, (_, v) in enumerate(sorted((-round(cos(dict(vecs)[q], e), 9), v) for v, e in vecs if e and v != q)[:4])}
    for blocks in (False, True):
        assert {(r.query_id, r.vec_id, r["rank"]) for r in retrieval.neighbours(rows, asked, 4, blocks=blocks).collect()} == want


def test_many_neighbours_by_products(spark, monkeypatch):
    """more queries than a few met every row in an expression; they are multiplied in bounded products, with ties, zero vectors and copies."""
    vecs = [(i, [float(i % 7), float(i % 3), 1.0]) for i in range(90)] + [(200, [0.0, 0.0, 0.0]), (201, None)]
    rows = spark.createDataFrame(vecs, "vec_id long, embedding array<double>").repartition(3)
    asked = rows.where("vec_id < 30 or vec_id = 200").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    assert retrieval.FEW_QUERIES < 31
    size = lambda a: math.sqrt(sum(x * x for x in a))
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / (size(a) * size(b)), 9) if size(a) * size(b) else 0.0
    ids = [*range(30), 200]
    want = {(q, v, r + 1) for q in ids for r, (_, v) in enumerate(sorted((-cos(dict(vecs)[q], e), v) for v, e in vecs if e and v != q)[:5])}
    for cells in (1 << 22, 100):
        monkeypatch.setattr(retrieval, "PRODUCT", cells)
        found = retrieval.neighbours(rows, asked, 5)
        assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
        assert {(r.query_id, r.vec_id, r["rank"]) for r in found.collect()} == want


def test_only_what_is_small_is_broadcast(spark):
    wide = spark.range(100).select(F.col("id").alias("query_id"), F.array_repeat(F.lit(1.0), 1000).alias("vector"))
    rows, size = retrieval.measured(wide)
    assert rows == 100 and size > 800_000
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(retrieval.small(wide)) and not hinted(retrieval.small(wide, size=100_000)) and not hinted(retrieval.small(wide, rows=99))


def test_texts_enter_no_exchange_of_a_search(spark, chunks, queries, tmp_path):
    more = chunks.withColumns({"active": F.lit(1), "expires_at": F.lit(None).cast("long"), "title": F.lit("t"), "memory_id": F.col("file_path"), "memory_role": F.lit("root"), "memory_root_path": F.col("file_path"), "tags": F.array(F.lit("a"))})
    kept = index.written(spark, more, str(tmp_path / "i"))
    plan = search.hybrid(kept.chunks, queries, as_of_ms=NOW, posted=kept.postings)
    said = plan._jdf.queryExecution().executedPlan().toString()
    assert "text_body" in said and plan.count() > 0
    for line in said.split("\n"):
        if "Exchange" in line:
            assert "text_body" not in line


def test_blocks_over_many_slices(spark):
    """More rows in a task than one product takes."""
    made = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.sin(F.col("id") * 0.37 + i))
    rows = spark.range(9500, numPartitions=1).select(F.concat(F.lit("h"), "id").alias("hash_seq"), F.concat(F.lit("f"), F.col("id") % 4000).alias("file_path"), made.alias("vector"), F.lit(0.5).alias("importance"), F.lit(NOW).alias("embedded_at"))
    asked = spark.createDataFrame([(1, [1.0, 0.5, -1.0, 0.2]), (2, [0.0, 1.0, 0.0, 0.0])], "query_id int, vector array<double>")
    plain = got(retrieval.vector_search(rows, asked, as_of_ms=NOW, limit=15))
    assert len(plain) == 30 and got(retrieval.vector_search(rows, asked, as_of_ms=NOW, limit=15, blocks=True)) == plain


def test_words_are_counted_where_they_are_read(spark, chunks, queries):
    """without stored postings, no posting of a chunk enters an exchange; a search's exchanges hold sums per query and chunk."""
    for df in (retrieval.bm25(chunks, queries, as_of_ms=NOW), retrieval.postings(chunks)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Exchange hashpartitioning\(term#\d+L?, chunk_id", plan) and not re.search(r"Exchange hashpartitioning\(chunk_id#\d+, term", plan)
    said = {(r.term, r.hash_seq): r.tf for r in retrieval.postings(chunks).collect()}
    assert said[("red", "h0")] == 2 and said[("fox", "h4")] == 2 and said[("über", "h6")] == 1 and ("dog", "h2") not in said


def test_repeated_rows_are_one_posting(spark, chunks):
    twice = chunks.unionByName(chunks.where("hash_seq = 'h0'"))
    said = {(r.term, r.hash_seq): r.tf for r in retrieval.postings(twice).collect()}
    assert said[("red", "h0")] == 4 and said[("fox", "h0")] == 2 and said[("red", "h5")] == 3


def test_queries_of_one_search_write_no_index(spark):
    """searches over the supplied tables read chunks from their tables, and their joins move no text."""
    held = len(index._OPEN)
    for name in ("blend_media_tiers", "vector_topk", "bm25_topk_batch", "corpus_stats"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Exchange [^\n]*text_body", plan)
        told = [x for x in plan.split("\n") if "FileScan parquet" in x and "/index-" in x]
        assert not told
    assert len(index._OPEN) == held
