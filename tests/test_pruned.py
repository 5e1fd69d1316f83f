"""Searches by bounds against the full ones, and that they leave work out."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestore.operators import pruned, retrieval
from lodestore.plans import index

NOW = 1_000_000


def told(df):
    return sorted((r.query_id, r.file_path, r.hash_seq, r.rank0, round(r.score, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def chunks(spark):
    r = random.Random(5)
    common, rare = [f"w{i}" for i in range(20)], [f"rare{i}" for i in range(150)]
    rows = []
    for i in range(1500):
        said = [r.choice(common) for _ in range(r.choice([3, 10, 40, 200]))] + ([r.choice(rare)] * r.randint(1, 3) if r.random() < 0.3 else [])
        around = r.randrange(12)
        vector = None if i == 9 else [0.0] * 4 if i in (3, 700) else [math.cos(around + j) + r.gauss(0, 0.02) for j in range(4)]
        rows.append((f"c{i % 3}", f"f{i // 2}", f"h{i}", " ".join(said), vector, r.choice([None, 0.2, 1.0]), NOW - i))
    rows += [("c0", "same", "h0", "rare1 rare1", rows[0][4], None, NOW), ("c1", "same", "h0", "rare1 rare1", rows[0][4], None, NOW)]
    return spark.createDataFrame(rows, "collection string, file_path string, hash_seq string, text_body string, vector array<double>, importance double, embedded_at long").repartition(3)


def test_blocks_of_postings(spark, chunks, tmp_path):
    kept = index.written(spark, chunks, str(tmp_path / "i"))
    blocks = pruned.write_blocks(spark, kept.chunks, kept.postings, str(tmp_path / "b"), as_of_ms=NOW, block_chunks=8)
    asked = spark.createDataFrame([(1, "rare1 w0"), (2, "w1 w2 w3"), (3, "rare3 rare4 w5 w5 w6"), (4, "absent"), (5, None), (6, "rare7")], "query_id int, query string")
    for limit in (5, 20):
        rows, counts = pruned.bm25_pruned(blocks, asked, limit=limit)
        assert told(rows) == told(retrieval.bm25(kept.chunks, asked, as_of_ms=NOW, limit=limit, posted=kept.postings))
    seen = {r.query_id: (r.postings, r.scored) for r in counts.collect()}
    assert seen[1][1] < 0.6 * seen[1][0] and all(b <= a for a, b in seen.values()) and 4 not in seen
    terms = {r.term: r.df for r in blocks.terms.collect()}
    assert seen[2][0] == terms["w1"] + terms["w2"] + terms["w3"]


def test_cells_of_vectors(spark, chunks, tmp_path):
    cells = pruned.write_cells(spark, chunks, str(tmp_path / "c"), as_of_ms=NOW)
    assert cells.size.sum() == chunks.where("vector is not null").count() and cells.size[-1] == 2
    asked = spark.createDataFrame([(1, [1.0, 0.5, -0.4, -0.9]), (2, [0.0, 0.0, 0.0, 0.0]), (3, None), (4, [-0.5, -1.0, -0.6, 0.4])], "query_id int, vector array<double>")
    for limit in (3, 20):
        rows, visits = pruned.vector_cells(cells, asked, limit=limit)
        assert told(rows) == told(retrieval.vector_search(chunks, asked, as_of_ms=NOW, limit=limit))
    rows, visits = pruned.vector_cells(cells, asked.where("query_id in (1, 4)"), limit=20)
    assert visits.visited < 0.6 * visits.cells and visits.visited_rows < 0.6 * visits.rows
    assert pruned.vector_cells(cells, asked.where("false"))[0].count() == 0


def test_empty_views(spark, chunks, tmp_path):
    none = chunks.where("false")
    kept = index.written(spark, none, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "w1", [1.0, 0.0, 0.0, 0.0])], "query_id int, query string, vector array<double>")
    blocks = pruned.write_blocks(spark, kept.chunks, kept.postings, str(tmp_path / "b"), as_of_ms=NOW)
    assert pruned.bm25_pruned(blocks, asked)[0].count() == 0
    assert pruned.vector_cells(pruned.write_cells(spark, none, str(tmp_path / "c"), as_of_ms=NOW), asked)[0].count() == 0
