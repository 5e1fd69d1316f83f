import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from lodestore.plans import ingest, store
from lodestore.sources import folder, office, transcripts
from lodestore.streaming import watch

NOW = 1_706_745_600_000


def texts(spark, rows):
    return spark.createDataFrame(rows, "collection string, file_path string, text string, user_id string, ttl_seconds int, tags array<string>")


def paths(df):
    return sorted((r.file_path, r.active) for r in df.select("file_path", "active").collect())


@pytest.fixture
def db(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    rows = [("c", "a.md", "# Alice\nAlice Smith met Bob Jones", "u", 60, ["x"]), ("c", "b.md", "Bob Jones alone", None, None, None), ("d", "a.md", "# Alice\nAlice Smith met Bob Jones", "v", 0, None)]
    s.upsert(ingest.memory_rows(texts(spark, rows), now_ms=NOW))
    return s


def test_ingest_and_upsert(spark, db):
    assert db.version() == 1
    chunks = db.table("embeddings")
    assert chunks.count() == 3 and db.table("content").count() == 2  # equal texts share content, not chunks
    first = chunks.where("collection = 'c' and file_path = 'a.md'").first()
    assert first.expires_at == NOW + 60_000 and first.memory_role == "root" and first.title == "Alice"
    assert db.table("entities").where("entity_key = 'bob_jones'").count() == 3 and db.table("relations").count() == 2
    was = {r.file_path: r.id for r in db.table("documents").where("collection = 'c'").collect()}
    again = ingest.memory_rows(texts(spark, [("c", "a.md", "new text", "u", None, None)]), now_ms=NOW + 5)
    db.upsert({"documents": again["documents"], "content": again["content"]})
    doc = db.table("documents").where("collection = 'c' and file_path = 'a.md'").first()
    assert doc.id == was["a.md"] and doc.created_at == NOW and doc.updated_at == NOW + 5
    assert db.version() == 2 and db.table("content").count() == 3


def test_staged_rows_show_on_promotion(spark, db):
    before = db.version()
    staged = db.stage({"content": spark.createDataFrame([("h", "t", "text", 1)], "hash string, doc string, content_type string, created_at long")})
    assert db.table("content").count() == 2 and db.version() == before
    db.promote(staged)
    assert db.table("content").count() == 1
    dropped = db.stage({"content": db.table("content")})
    db.abort(dropped)
    assert db.table("content").count() == 1 and db.compact() >= 1


def test_delete_and_collections(spark, db):
    assert db.delete_path("a.md", "c", user_id="v") == 0
    assert db.delete_path("a.md", "c") == 1
    assert db.table("embeddings").where("collection = 'd'").count() == 1
    assert db.table("documents").where("collection = 'c' and file_path = 'a.md'").first().active == 0
    with pytest.raises(ValueError):
        db.rename_collection("c", "d")
    db.rename_collection("d", "e")
    assert db.table("embeddings").where("collection = 'e'").count() == 1
    db.delete_collection("e")
    assert sorted(r.collection for r in db.table("documents").select("collection").distinct().collect()) == ["c"]
    assert store.orphans(db.table("content"), db.table("embeddings"), db.table("documents")).count() == 0


def test_conversation_replaces_its_family(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    turns = spark.createDataFrame([(1, i, "user", f"turn {i} of talk") for i in range(3)], "conv_id long, turn long, role string, text string")
    for part in (turns, turns.where("turn < 2")):
        rows = ingest.memory_rows(ingest.conversation_texts(part, "talk"), now_ms=NOW)
        s.replace_family("conv/1", "talk", {n: rows[n] for n in ("embeddings", "documents")})
    assert paths(s.table("documents")) == [("conv/1", 1), ("conv/1::turn:0001", 1), ("conv/1::turn:0002", 1)]
    assert s.table("embeddings").select("memory_id").distinct().count() == 1


def test_promoted_and_aborted_rows(spark):
    df = spark.createDataFrame([("p", None, 1, None), ("p::x", "p", 1, None), ("p::y", "p", 0, "b"), ("q", None, 1, None)], "file_path string, memory_root_path string, active byte, index_batch_id string")
    assert paths(store.promoted(df, "b", "p")) == [("p", 0), ("p::x", 0), ("p::y", 1), ("q", 1)]
    assert store.aborted(df, "b").count() == 3


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in files.items():
            z.writestr(n, t)
    return out.getvalue()


W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"


def test_office_files(spark, tmp_path):
    para = lambda *runs: "<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"
    docx = zipped({"word/document.xml": f'<w:document xmlns:w="{W}"><w:body>{para("one", "two")}{para("x" * 1590)}{para("")}{para("last")}</w:body></w:document>'})
    slide = lambda t: f'<s xmlns:a="{A}"><a:t>{t}</a:t></s>'
    pptx = zipped({"ppt/slides/slide10.xml": slide("ten"), "ppt/slides/slide2.xml": slide("two")})
    pdf = b"%PDF\nstream\n" + zlib.compress(b"BT (Hello \\(world\\)) Tj [(a) -5 (b)] TJ ET") + b"\nendstream\nstream\n(plain) Tj\nendstream"
    for name, data in {"a.docx": docx, "b.pptx": pptx, "c.pdf": pdf, "d.docx": b"broken", "e.txt": b"text"}.items():
        (tmp_path / name).write_bytes(data)
    files = folder.list_folder(spark, str(tmp_path))
    got = {(r.rel_path, r.seq): (r.kind, r.text) for r in office.office_sections(files).collect()}
    assert got[("a.docx", 1)] == ("section", "one two\n" + "x" * 1590) and got[("a.docx", 2)][1] == "last"
    assert got[("b.pptx", 1)] == ("slide", "two") and got[("b.pptx", 2)][1] == "ten"
    assert got[("c.pdf", 1)] == ("page", "Hello (world) ab") and got[("c.pdf", 2)][1] == "plain" and len(got) == 6
    rows = ingest.section_texts(office.office_sections(files), "docs")
    assert "b.pptx::slide:0002" in {r.file_path for r in rows.collect()}


def test_folder_listing_and_routing(spark, tmp_path):
    for name, data in {"top.md": b"\xef\xbb\xbfhi", "sub/x.png": b"img", "sub/bin.dat": b"a\0b", "sub/latin.txt": b"caf\xe9", ".git/y.md": b"no", "node_modules/z.md": b"no", "sub/.hid/w.md": b"no", "big.txt": b"x" * 3000}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    files = folder.list_folder(spark, str(tmp_path))
    assert sorted(r.rel_path for r in files.select("rel_path").collect()) == ["big.txt", "sub/bin.dat", "sub/latin.txt", "sub/x.png", "top.md"]
    assert sorted(r.rel_path for r in folder.list_folder(spark, str(tmp_path), include=["**/*.md", "sub/*"], exclude=["*.dat"]).collect()) == ["sub/latin.txt", "sub/x.png", "top.md"]
    status = {r.rel_path: r.status for r in folder.routed(files, max_mb=0.002).collect()}
    assert status == {"top.md": "ok", "sub/x.png": "ok", "sub/bin.dat": "binary", "sub/latin.txt": "ok", "big.txt": "too_large"}
    read = {r.rel_path: r.t for r in files.select("rel_path", folder.decoded("content").alias("t")).collect()}
    assert read["top.md"] == "hi" and read["sub/latin.txt"] == "café"
    assert folder.ingest_summary(folder.routed(files)).agg(F.sum("files")).first()[0] == 5


def test_transcripts(spark):
    files = [
        ("v.transcript.json", '{"segments": [{"start": 1, "end": "2.5", "text": "<b>one</b>  two"}, {"text": " "}], "description": "d"}'),
        ("w.transcript.json", '{"description": "only <i>this</i>"}'), ("bad.json", "{"),
        ("a.srt", "1\n00:00:01,500 --> 00:00:02,000\nHello\n<i>there</i>\n\n2\n00:01:00,000 --> 00:01:02,000\nBye\n"),
        ("a.vtt", "WEBVTT\n\n00:05.000 --> 00:06.000 align:start\nHey\n"), ("a.txt", "plain\ntext"),
    ]
    df = spark.createDataFrame(files, "path string, text string")
    got = {(r.path, r.seq): (r.start, r.end, r.segment) for r in transcripts.transcripts(df).collect()}
    assert got == {
        ("v.transcript.json", 1): (1.0, 2.5, "one two"), ("w.transcript.json", 1): (0.0, None, "only this"), ("a.srt", 1): (1.5, 2.0, "Hello there"),
        ("a.srt", 2): (60.0, 62.0, "Bye"), ("a.vtt", 1): (5.0, 6.0, "Hey"), ("a.txt", 1): (0.0, None, "plain text"),
    }
    assert sorted(r.path for r in transcripts.preferred_sidecars(df).collect()) == ["a.srt", "v.transcript.json", "w.transcript.json"]
    assert "a.srt::transcript:0001@1.50s" in {r.file_path for r in ingest.segment_texts(transcripts.transcripts(df), "c").collect()}


def test_watch_diff_and_batches(spark):
    kind = "path string, length long, modified_ms long"
    got = watch.snapshot_diff(spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], kind), spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], kind))
    assert sorted(map(tuple, got.collect())) == [("b", "modified"), ("c", "deleted"), ("d", "created")]
    events = spark.createDataFrame([("a", "created", 1, 1), ("a", "deleted", 2, 2), ("b", "modified", 1, 3)], "path string, change string, ts long, event_id long")
    assert [(r.path, r.change, r.batch) for r in watch.batches(watch.latest_changes(events), 1).orderBy("batch").collect()] == [("b", "modified", 0), ("a", "deleted", 1)]


def test_watch_stream_applies_each_change_once(spark, tmp_path):
    kind = "path string, change string, ts long, event_id long"
    source, seen = str(tmp_path / "events"), []
    spark.createDataFrame([("a", "created", 1, 1), ("a", "modified", 2, 2)], kind).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(kind).parquet(source)
        watch.watch(stream, lambda df, i: seen.extend(tuple(r)[:2] for r in df.collect()), str(tmp_path / "check")).awaitTermination(60)

    run()
    spark.createDataFrame([("b", "deleted", 3, 3)], kind).write.mode("append").parquet(source)
    run()
    assert seen == [("a", "modified"), ("b", "deleted")]
