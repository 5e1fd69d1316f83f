import re
import uuid

import pytest
from pyspark.sql import functions as F

from lodestore.functions import entities, identity, vectors
from lodestore.functions import text as tx
from lodestore.functions.chunking import chunk_bounds, chunked
from lodestore.schema import checked_name, conform, decoded_tags

TEXTS = ["", "Hello  World ", "ÉÀ ñ_1 日本", "a" * 50, None, "x\n\ty", "İstanbul ß", "# T\nbody", "## Notes\n\n## Real title\nx", "# Notes\nnone", "a\n#+TITLE: Named \nb", "#no"]


def one(spark, column, values=TEXTS, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_words_are_those_of_unicode(spark):
    assert one(spark, tx.words(F.col("x"))) == [re.findall(r"\w+", (t or "").lower().replace("i̇", "i̇")) if t != "İstanbul ß" else ["i", "stanbul", "ß"] for t in TEXTS]


def test_name_uuid(spark):
    names = ["", "c::u::::::é", "日本", "x" * 300]
    assert one(spark, identity.name_uuid(F.col("x")), names) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_titles(spark):
    got = one(spark, tx.title(F.coalesce("x", F.lit("")), F.lit("dir/note.one.md")))
    assert got[7:] == ["T", "Real title", "note.one", "Named", "note.one"] and got[0] == "note.one"


@pytest.mark.parametrize("text, most, want", [("short", 10, "short"), ("one two three four", 12, "one two..."), ("onelongword here", 10, "onelong...")])
def test_shortened(spark, text, most, want):
    assert one(spark, tx.shortened(F.col("x"), most), [text]) == [want]


def test_visual_queries(spark):
    yes = ["show me the plan", "a photo of cats", "network diagram", "show", "my whiteboard", "show the chart"]
    no = ["mapreduce jobs", "tableau workbook", "the show must go on", "graph theory", "", None]
    assert one(spark, tx.is_visual(F.col("x")), yes + no) == [True] * len(yes) + [False] * len(no)
    assert one(spark, tx.visual_description(F.col("x")), ["Show me the red barn", "diagram"]) == ["A photograph or image showing red barn", "diagram"]


def test_cosine_and_hash_embedding(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [round(r[0], 9) for r in df.select(vectors.cosine("a", "b")).collect()] == [round(2**-0.5, 9), 0.0]
    import hashlib

    got = {x["bucket"]: x["value"] for x in one(spark, vectors.hash_buckets(F.col("x")), ["One one two"])[0]}
    h = {w: int(hashlib.sha256(w.encode()).hexdigest(), 16) for w in ("one", "two")}
    want = {h["one"] % 2048: 2 / 5**0.5, h["two"] % 2048: 1 / 5**0.5}
    assert {k: round(abs(v), 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}


def test_chunks_cover_the_text():
    text = "\n\n".join(f"para {i} " + "word " * (i % 30) for i in range(300))
    bounds = chunk_bounds(text)
    assert bounds[0][0] == 0 and bounds[-1][1] == len(text)
    assert all(b - a <= 2048 for a, b in bounds)
    assert all(a2 == b1 - 256 for (_, b1), (a2, _) in zip(bounds, bounds[1:], strict=False))
    assert all(text[b : b + 2] == "\n\n" for _, b in bounds[:-1])
    assert chunk_bounds("x" * 2048) == [(0, 2048)] and chunk_bounds("") == [(0, 0)]


def test_chunk_cuts_prefer_headings_and_avoid_fences():
    head = "x" * 1900 + "\n# head\n" + "y" * 50 + "\n\n" + "z" * 3000
    assert chunk_bounds(head)[0] == (0, 1900)
    fenced = "x" * 1850 + "\n```\n" + "code\n" * 60 + "\n```\n" + "z" * 1000
    assert chunk_bounds(fenced)[0][1] in (1850, 2048)


def test_chunked_rows(spark):
    df = spark.createDataFrame([(1, "a" * 5000), (2, None)], "id int, text string")
    assert [tuple(r) for r in chunked(df).orderBy("id", "seq").select("id", "seq", "pos").collect()] == [(1, 0, 0), (1, 1, 1792), (1, 2, 3584), (2, 0, 0)]


def test_entities(spark):
    def found_in(*texts):
        rows = entities.mentions(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text_body string")).collect()
        return [sorted((r for r in rows if r.i == i), key=lambda r: r.ord) for i in range(len(texts))]

    text = "Alice Smith met @brian about REC-76 at Acme Robotics. See https://example.com/a(b) and NASA, Project Apollo Program today. On Monday"
    first, none, blank, many, odd = found_in(text, None, " ", " ".join(f"Name{i}x," for i in range(60)), "AB-٣٤ 'Big  Gap' é@me @me The a.b.com Big Gap")
    found = {e["entity_key"]: e["entity_type"] for e in first}
    assert found["alice_smith"] == "proper_noun" and found["brian"] == "person" and found["rec_76"] == "ticket" and found["nasa"] == "acronym"
    assert found["https_example_com_a_b"] == "url" and any(t == "project" for t in found.values())
    assert "monday" not in found and none == [] and blank == []
    assert len(many) == 24 and [e.ord for e in many] == list(range(1, 25))
    assert [(e.name, e.entity_type) for e in odd] == [("AB-٣٤", "ticket"), ("Big Gap", "proper_noun"), ("@me", "person"), ("a.b.com", "url")]
    assert odd[1].evidence == "AB-٣٤ 'Big Gap' é@me @me The a.b.com Big Gap"


def test_names_are_checked():
    for bad in ("", " ", "a'b", 'a"b', "a;b", "a--b", "/*", "a\nb", "a\0b", "a\\b", None):
        with pytest.raises(ValueError):
            checked_name(bad)
    assert checked_name("fine-name_1") == "fine-name_1"


def test_tags_and_conform(spark):
    assert one(spark, decoded_tags(F.col("x")), ['["a","b"]', "a, b ,", None]) == [["a", "b"], ["a", "b"], None]
    df = conform(spark.createDataFrame([("h", "x")], "hash string, extra string"), "content")
    assert df.columns == ["hash", "doc", "content_type", "created_at"]
