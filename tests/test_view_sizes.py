"""What the views of pruned searches write: no texts, and of vectors no postings; blocks made where texts are read."""

from pathlib import Path

import pyarrow.parquet as pq
import pytest

from lodestore import catalogue
from lodestore.operators import pruned, retrieval
from lodestore.plans import index

SF = "/root/testdata/sf0.01"
NOW = 1_000_000


@pytest.fixture
def written(tmp_path, monkeypatch):
    """Files that a query leaves in the shared folder, with their columns."""
    monkeypatch.setattr(index, "own_folder", lambda spark, name: str(tmp_path / name))
    for name in ("_OPEN", "_VIEWS", "_BLOCKS", "_CELLS"):
        if hasattr(index, name):
            monkeypatch.setattr(index, name, {})
    return lambda: {f: set(pq.read_schema(f).names) for f in tmp_path.rglob("*.parquet")}


def told(df):
    return sorted((r.query_id, r.rank0, r.file_path, r.score) for r in df.collect())


def test_blocks_hold_no_texts(spark, written):
    got = told(catalogue.QUERIES["bm25_topk_pruned"](spark, SF))
    files = written()
    assert files and not any("text_body" in columns for columns in files.values())
    assert sum(f.stat().st_size for f in files) < 1.5 * Path(f"{SF}/documents.parquet").stat().st_size
    assert got == told(catalogue.QUERIES["bm25_topk_batch"](spark, SF))


def test_cells_hold_no_texts_and_no_postings(spark, written):
    got = told(catalogue.QUERIES["vector_topk_cells"](spark, SF))
    files = written()
    assert files and not any(columns & {"text_body", "term"} for columns in files.values())
    assert sum(f.stat().st_size for f in files) < Path(f"{SF}/documents.parquet").stat().st_size
    assert got == told(catalogue.QUERIES["vector_topk_batch"](spark, SF))


@pytest.mark.parametrize("held", [1 << 14, 16])
def test_blocks_of_texts(spark, tmp_path, monkeypatch, held):
    """Without stored postings: rows that share a chunk count as one, empty texts are in no block; tasks that hold few chunks cut more blocks."""
    monkeypatch.setattr(pruned, "HELD_CHUNKS", held)
    rows = [(f"f{i}", f"h{i}", f"w{i % 3} w{i % 7} " * (i % 5), NOW) for i in range(60)] + [("f1", "h1", "w1 w1 ", NOW), ("f2", "h9", None, NOW)]
    for copies in (rows, [*rows, rows[4], rows[4]]):
        chunks = retrieval.keyed(spark.createDataFrame(copies, "file_path string, hash_seq string, text_body string, embedded_at long")).selectExpr("*", "cast(null as double) as importance")
        asked = spark.createDataFrame([(1, "w1 w2 w2"), (2, "w6"), (3, "none"), (4, None)], "query_id int, query string")
        blocks = pruned.write_blocks(spark, chunks, None, str(tmp_path / f"{held}-{len(copies)}"), as_of_ms=NOW, block_chunks=4)
        for limit in (3, 100):
            assert told(pruned.bm25_pruned(blocks, asked, limit=limit)[0]) == told(retrieval.bm25(chunks, asked, as_of_ms=NOW, limit=limit))
