"""Writes, reads, watching, file queries and caches over a store in a temporary folder."""

import json
import shutil
import zipfile
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from lodestore import __main__ as cli
from lodestore.engine import Config, Engine, Storage
from lodestore.plans import index, ingest, probes, search, watching
from lodestore.plans.store import Store
from lodestore.sources import folder

TEXTS = "collection string, file_path string, user_id string, text string, tags array<string>"


def opened(spark, root, now_ms=5000):
    vector = lambda c: F.array(F.length(c).cast("float"), F.lit(1.0).cast("float"))
    return Engine(spark, Config(root=str(root), model="m1"), embed=vector, now_ms=lambda: now_ms)


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("base") / "store"
    opened(spark, root).add(spark.createDataFrame([
        ("c", "a.md", "u", "# Alpha\nAlice Smith wrote about Acme Robotics", ["X"]), ("c", "a.md::section:0001", "u", "Alice Smith again", ["y"]),
        ("c", "b.md", None, "Bob Jones knows Acme Robotics", None), ("d", "b.md", None, "", None),
    ], TEXTS))
    return root


@pytest.fixture
def engine(spark, written, tmp_path):
    """An engine over a copy of the written store: its manifest names places within its root."""
    return opened(spark, shutil.copytree(written, tmp_path / "store"))


def paths(df):
    return sorted((r.collection, r.file_path) for r in df.collect())


def test_an_upsert_replaces_chunks_and_graph_of_its_paths(spark, engine):
    before = {(r.collection, r.file_path): (r.id, r.created_at) for r in engine.store.table("documents").collect()}
    engine.now_ms = lambda: 9000
    version = engine.store.version()
    engine.add(spark.createDataFrame([("c", "b.md", None, "Carol Stone only", None)], TEXTS))
    assert engine.store.version() == version + 1
    rows = engine.store.table("documents").collect()
    assert {(r.collection, r.file_path): (r.id, r.created_at) for r in rows} == before
    assert {r.updated_at for r in rows if r.file_path == "b.md" and r.collection == "c"} == {9000}
    assert [r.text_body for r in engine.store.table("embeddings").where("collection = 'c' and file_path = 'b.md'").collect()] == ["Carol Stone only"]
    assert {r.entity_key for r in engine.store.table("entities").where("file_path = 'b.md'").collect()} == {"carol_stone"}
    assert engine.store.table("relations").where("file_path = 'b.md'").count() == 0
    same = engine.store.table("documents").where("file_path = 'a.md'").first().id
    engine.add(spark.createDataFrame([("c", "a.md", "u", "other", None)], TEXTS))
    assert engine.store.table("documents").where("file_path = 'a.md'").first().id == same


def test_a_write_touches_its_collections_only(spark, engine):
    def places():
        return {(n, p): place for n, parts in engine.store.manifest()["tables"].items() for p, place in parts.items()}

    before = places()
    engine.add(spark.createDataFrame([("c", "new.md", None, "Dora", None)], TEXTS))
    after = places()
    assert all(after[k] == v for k, v in before.items() if k[0] != "content" and k[1] == "d")
    assert all(after[k] != v for k, v in before.items() if k[0] in ("embeddings", "documents") and k[1] == "c")
    engine.rename_collection("d", "e/f")
    assert paths(engine.memories().where("collection = 'e/f'")) == [("e/f", "b.md")] and ("documents", "d") not in places()
    engine.delete_collection("c")
    assert {r.collection for r in engine.collections().collect()} == {"e/f"} and engine.store.compact() > 0
    assert [r.text_body for r in engine.store.table("embeddings").collect()] == [""] and engine.store.table("content").count() == 1


def test_get_and_delete_by_id(engine):
    got = engine.get(path="a.md").first()
    assert got.path == "a.md" and got.title == "Alpha" and [c.path for c in got.children] == ["a.md::section:0001"] and got.tags == ["x", "y"]
    assert [s.path for s in got.snippets] == ["a.md", "a.md::section:0001"] and got.summary.startswith("# Alpha Alice")
    assert engine.get(got.memory_id).first().memory_id == got.memory_id
    assert engine.get("nobody").count() == 0 and engine.get(got.memory_id, user_id="v").count() == 0
    assert engine.delete(got.memory_id, user_id="v") == 0 and engine.delete(got.memory_id) == 2
    assert engine.get(got.memory_id).count() == 0 and engine.store.table("entities").where("memory_root_path = 'a.md'").count() == 0
    assert paths(engine.memories()) == [("c", "b.md"), ("d", "b.md")]
    with pytest.raises(ValueError):
        engine.delete("x' OR 1=1")


def test_search_and_batch(engine):
    assert engine.search("Acme Robotics", collection="c").first().path in ("a.md", "b.md")
    out = engine.batch([{"op": "search", "query": "Alice"}, {"op": "batch"}, {"op": "rename_collection", "old": "d", "new": "c"}, {"op": "collections"}, {"op": "status"}])
    assert out[0]["result"][0]["path"] == "a.md" and "unknown operation" in out[1]["error"] and "exists" in out[2]["error"]
    assert sorted(r["collection"] for r in out[3]["result"]) == ["c", "d"] and out[4]["result"]["chunks"] == 4
    related = engine.related(engine.get(path="a.md").first().memory_id).collect()
    assert [r.path for r in related] == ["b.md"] and [r.name for r in engine.entities(2).collect()] == ["Acme Robotics", "Acme Robotics"]
    merged = engine.search_batch([{"query": "Alice", "weight": 2.0}, {"query": "Bob"}]).collect()
    assert {r.path for r in merged} == {"a.md", "b.md"}
    engine.config = engine.config.changed(expand=True, limit=1)
    assert engine.search("what is Alice Smith").count() == 1
    for bad in ([], [{"op": "status"}] * 21):
        with pytest.raises(ValueError):
            engine.batch(bad)


def test_settings():
    c = Config(root="r")
    assert c.changed(limit=3).limit == 3
    for bad in ({"limit": 0}, {"mode": "x"}, {"root": "s"}, {"nothing": 1}, {"rerank_top_k": -1}):
        with pytest.raises(ValueError):
            c.changed(**bad)


def test_a_watched_folder_reaches_the_store(spark, engine, tmp_path):
    folder = tmp_path / "notes"
    (folder / "sub").mkdir(parents=True)
    (folder / "one.md").write_text("# One\nfirst")
    (folder / "sub/two.md").write_text("second")
    (folder / "raw.md").write_bytes(b"\0\1")
    assert engine.scan_folder(str(folder), "w") == {"deleted": 0, "written": 2}
    assert engine.scan_folder(str(folder), "w") == {"deleted": 0, "written": 0}
    (folder / "one.md").unlink()
    (folder / "sub/two.md").write_text("second, longer")
    engine.now_ms = lambda: 6000
    assert engine.scan_folder(str(folder), "w") == {"deleted": 1, "written": 1}
    shown = {r.file_path: r.text_body for r in engine.store.table("embeddings").where("collection = 'w'").collect()}
    assert shown == {"sub/two.md": "second, longer"} and paths(engine.memories().where("collection = 'w'")) == [("w", "sub/two.md")]


def test_a_watched_folder_takes_files_of_every_kind(spark, engine, tmp_path):
    folder = tmp_path / "kinds"
    folder.mkdir()

    def docx(*said):
        with zipfile.ZipFile(folder / "d.docx", "w") as z:
            w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
            z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>' + "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in said) + "</w:body></w:document>")

    docx("x" * 1590, "second part")
    (folder / "talk.mp4").write_bytes(b"\1")
    (folder / "talk.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nhello there\n")
    (folder / "[p]ic.png").write_bytes(b"\1")
    (folder / "n.md").write_text("plain")
    shown = lambda: {r.file_path: r.text_body for r in engine.store.table("embeddings").where("collection = 'k'").collect()}
    assert engine.scan_folder(str(folder), "k") == {"deleted": 0, "written": 4}
    first = shown()
    assert first["talk.mp4"] == "hello there" and first["n.md"] == "plain" and "[p]ic.png" in first and "talk.srt" not in first
    assert first["d.docx::section:0002"] == "second part" and any(p.startswith("talk.mp4::transcript:0001") for p in first)
    docx("short now")
    (folder / "talk.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nsomething else, longer\n")
    (folder / "n.md").write_bytes(b"\0 no text any more")
    (folder / "[p]ic.png").unlink()
    engine.now_ms = lambda: 6000
    assert engine.scan_folder(str(folder), "k") == {"deleted": 1, "written": 2}
    now = shown()
    assert now["talk.mp4"] == "something else, longer" and "n.md" not in now and "[p]ic.png" not in now and "d.docx::section:0002" not in now and now["d.docx::section:0001"] == "short now"
    hidden = {r.file_path for r in engine.store.table("documents").where("collection = 'k' and active = 0").collect()}
    assert hidden == {"n.md", "[p]ic.png", "d.docx::section:0002"}


def test_a_stream_of_changes_reaches_the_store(spark, engine, tmp_path):
    folder, events = tmp_path / "f", tmp_path / "events"
    folder.mkdir()
    events.mkdir()
    (folder / "a.txt").write_text("now")
    rows = [{"path": "a.txt", "change": "deleted", "ts": 1, "event_id": 1}, {"path": "a.txt", "change": "created", "ts": 2, "event_id": 2}, {"path": "gone.txt", "change": "deleted", "ts": 3, "event_id": 3}]
    (events / "1.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("path string, change string, ts long, event_id long").json(str(events))
    watching.follow(engine.store, stream, str(folder), "s", str(tmp_path / "ckpt"), now_ms=7000).awaitTermination()
    assert [(r.file_path, r.text_body) for r in engine.store.table("embeddings").where("collection = 's'").collect()] == [("a.txt", "now")]


def test_files_as_queries(spark, tmp_path):
    (tmp_path / "q.md").write_text("find  this\n" + "word " * 2000)
    (tmp_path / "bad.md").write_bytes(b"x\0y")
    (tmp_path / "empty.md").write_text(" \n")
    (tmp_path / "talk.mp3").write_bytes(b"\1")
    (tmp_path / "talk.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nhello there\n\n2\n00:00:02,000 --> 00:00:03,000\nfriend\n")
    (tmp_path / "mute.wav").write_bytes(b"\1")
    (tmp_path / "p.png").write_bytes(b"\1")
    got = {r.rel_path: r for r in probes.file_queries(spark, str(tmp_path)).collect()}
    assert got["q.md"].query.startswith("find this word") and len(got["q.md"].query) <= 4000 and got["q.md"].error is None
    assert got["bad.md"].error == "binary" and got["empty.md"].error == "no text" and got["mute.wav"].error == "no transcript"
    assert got["talk.mp3"].query == "hello there friend" and got["p.png"].kind == "image" and "talk.srt" not in got


def test_vectors_are_made_once(spark, engine, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    class Model:
        def embed_texts(self, texts):
            calls.add(len(texts))
            return [[float(len(t)), 0.5] for t in texts]

    store = Store(spark, str(tmp_path / "v"))
    asked = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "abc"), (4, None)], "query_id int, query string")
    embed = probes.embedder(Model())
    for _ in range(2):
        got = {r.query_id: r.vector for r in probes.embedded_queries(store, asked, embed, model="m", now_ms=1).collect()}
        assert got == {1: [2.0, 0.5], 2: [2.0, 0.5], 3: [3.0, 0.5], 4: None}
    made = store.table("cache").count()
    probes.embedded_queries(store, asked, embed, model="other", now_ms=1)
    assert made == 2 and store.table("cache").count() == 4
    held = probes.VectorCache(2)
    assert [held.get(k, lambda k=k: [k]) for k in "abaca"] == [["a"], ["b"], ["a"], ["c"], ["a"]]
    assert held.stats() == {"size": 2, "most": 2, "hits": 2, "misses": 3}


def test_cache_keeps_what_was_used_last(spark, tmp_path):
    """Rounds of lookups against a simulated cache: made vectors, eviction in order of use, ties by hash, a call larger than the cache."""
    made = spark.sparkContext.accumulator(0)

    class Model:
        def embed_texts(self, texts):
            made.add(len(texts))
            return [[float(len(t))] for t in texts]

    store, embed, most = Store(spark, str(tmp_path / "lru")), probes.embedder(Model()), 3
    key = lambda q: sha256(f'{{"data":"{q}","index_version":"0","model":"m","namespace":"","type":"text"}}'.encode()).hexdigest()
    tie = lambda q: int(sha256(key(q).encode()).hexdigest()[:13], 16)
    held: dict[str, int] = {}
    for now, asked in enumerate(["ab", "bc", "d", "", "bde", "abcdef", "x"]):
        rows = spark.createDataFrame([(i, q) for i, q in enumerate([*asked, *asked[:1], None])], "query_id int, query string")
        before = made.value
        got = probes.embedded_queries(store, rows, embed, model="m", now_ms=now, most=most).collect()
        assert all((r.vector is None) if r.query is None else (r.vector == [1.0]) for r in got) and len(got) == len(asked) + len(asked[:1]) + 1
        assert made.value - before >= len(set(asked) - set(held))
        rest = sorted(set(held) - set(asked), key=lambda q: (held[q], tie(q)), reverse=True)
        if asked:
            held = dict.fromkeys(asked, now) | {q: held[q] for q in rest[: max(0, most - len(asked))]}
        assert {r.key: r.used_at for r in store.table("cache").collect()} == {key(q): t for q, t in held.items()}
    # Rows without a stamp count from when they were made; other cached values leave by the same rule.
    store.upsert({"cache": spark.createDataFrame([("old", "v", -5)], "key string, value string, created_at long")})
    store.remember(spark.createDataFrame([("new", "v", 9)], "key string, value string, created_at long"), now_ms=9, most=2)
    assert {r.key for r in store.table("cache").collect()} == {"new", key("x")}


def test_media_probes(spark):
    rows = [(1, [1.0], "a cat", "said so"), (2, None, " ", None), (3, [1.0], "x", "x"), (4, None, "c" * 3000, None)]
    got = {r.query_id: r.query for r in search.media_probes(spark.createDataFrame(rows, "query_id int, vector array<float>, caption string, transcript string")).collect()}
    assert got == {1: "said so a cat", 2: "", 3: "x", 4: "c" * 2000}


def test_media_search_with_variants(engine, spark):
    media = spark.createDataFrame([(1, None, "how to find Alice Smith")], "query_id int, vector array<float>, caption string")
    got = search.search_media(engine.store.table("embeddings"), media, as_of_ms=5000, expand=True, embed=engine.embed)
    first = got.orderBy("rank").first()
    assert first.path == "a.md" and "original_fts_exp1" in first.sources and got.where("rerank_path <> 'media_disabled'").count() == 0


def test_searches_read_an_index_that_follows_the_store(engine, spark):
    engine.search("Alice")
    first = index.of_store(engine.store)
    assert first.postings.where("term = 'alice'").count() == 2 and index.of_store(engine.store).postings.inputFiles() == first.postings.inputFiles()
    engine.add(spark.createDataFrame([("c", "z.md", None, "Alice three", None)], TEXTS))
    assert index.of_store(engine.store).postings.where("term = 'alice'").count() == 3
    engine.store.compact()
    assert engine.search("three").first().path == "z.md"


def test_media_become_memories(engine, spark):
    media = spark.createDataFrame([("v.mp4", "video", "a dog runs"), ("p.png", "image", None)], "path string, content_type string, caption string")
    segments = spark.createDataFrame([("v.mp4", 1, 0.0, "Hello there"), ("v.mp4", 2, 2.5, "again"), ("v.mp4", 3, 4.0, "more")], "path string, seq int, start double, segment string")
    tagger = lambda c: F.concat(F.lit('["Dog", "'), F.substring(c, 1, 1), F.lit('"]'))
    engine.add(ingest.media_texts(media, segments, "m", tagger=tagger).withColumn("user_id", F.lit(None).cast("string")))
    rows = {r.file_path: r for r in engine.store.table("embeddings").where("collection = 'm'").collect()}
    assert rows["v.mp4"].text_body == "a dog runs\n\nHello there" and rows["v.mp4"].tags == ["dog", "a"] and rows["p.png"].text_body == "p.png"
    child = rows["v.mp4::transcript:0002@2.50s"]
    assert (child.text_body, child.content_type, child.memory_role, child.memory_id) == ("again", "video", "child", rows["v.mp4"].memory_id)
    assert engine.get(path="v.mp4").first().children[0].path.startswith("v.mp4::transcript:0001")


def test_the_log_of_a_listing(spark, tmp_path):
    for name, data in {"a.md": b"x", "b.log": b"x", "c.png": b"x", "d.md": b"\0", "e.md": b"x" * 3000}.items():
        (tmp_path / name).write_bytes(data)
    got = folder.routed(folder.list_folder(spark, str(tmp_path)), types=["text"], max_mb=0.002, exclude=["*.log"])
    assert {r.rel_path: r.status for r in got.collect()} == {"a.md": "ok", "b.log": "glob_mismatch", "c.png": "type_excluded", "d.md": "binary", "e.md": "too_large"}
    summary = {(r.content_type, r.status): r.files for r in folder.ingest_summary(got).collect()}
    assert summary[("text", "ok")] == 1 and sum(summary.values()) == 5


def test_the_command_line(spark, engine, tmp_path, capsys):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/n.md").write_text("# Zebra\nstripes")
    root = engine.config.root

    def said(*given):
        cli.main([root, *given], spark)
        return [json.loads(x) for x in capsys.readouterr().out.splitlines()]

    assert said("scan", str(tmp_path / "docs"), "z") == [{"deleted": 0, "written": 1}]
    assert said("search", "stripes", "--collection", "z")[0]["path"] == "n.md"
    memory = said("get", "--path", "n.md")[0]
    assert memory["title"] == "Zebra" and {"collection": "z"} in said("collections")
    assert said("delete", memory["memory_id"]) == [{"chunks": 1}] and said("get", "--path", "n.md") == []
    assert said("status")[0]["chunks"] == 4 and len(said("list")) == 3 and said("compact")[0]["folders"] > 0
    assert isinstance(engine.store, Storage)
    steps = []
    engine.scan_folder(str(tmp_path / "docs"), "z", progress=steps.append)
    assert steps == ["listed", "applied", "kept"]
