"""Parsing of generated text and query variants against plain Python."""

import pytest
from pyspark.sql import functions as F

from lodestore.functions import generated, identity
from lodestore.operators import evaluate


def each(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


@pytest.mark.parametrize(
    "raw, want",
    [
        ('["Red Car", "image", "red car", "night_sky"]', ["red car", "night sky"]),
        ('Sure:\n```json\n["a b", "c"]\n```', ["a b", "c"]),
        ('{"tags": ["one", "two."]}', ["one", "two"]),
        ("tags: alpha, #beta;\n- gamma\n2) delta", ["alpha", "beta", "gamma", "delta"]),
        ("  ", []), (None, []), ("[]", []), ("[not json", ["[not json"]),
        ("x" * 60, ["x" * 48]), ("word " * 20, [("word " * 9).strip()]),
        (",".join(f"t{i}" for i in range(20)), [f"t{i}" for i in range(8)]),
    ],
)
def test_media_tags(spark, raw, want):
    assert each(spark, [raw], generated.media_tags(F.col("x"))) == [want]


@pytest.mark.parametrize(
    "query, said, want",
    [
        ("how to bake bread", None, ["guide for bake bread"]),
        ("Tell me WHAT IS tea", None, ["tell me definition of tea"]),
        ("the difference between a and b", "", ["the comparison of a and b"]),
        ("what about old maps", None, ["old maps", "information about old maps"]),
        ("how many", None, []), ("plain words", None, []), ("", None, []), (None, None, []),
        ("plain words", 'Here are two:\n1. Other words\n- other WORDS\n* third', ["Other words", "third"]),
        ("plain words", '["plain Words", "a", "b", "c"]', ["a", "b"]),
        ("how to bake", "here are\nquery: How To Bake", ["guide for bake"]),
        ("show me a whale", '["ignored"]', ["A photograph or image showing whale"]),
    ],
)
def test_query_variants(spark, query, said, want):
    df = spark.createDataFrame([(query, said)], "q string, g string")
    assert df.select(generated.query_variants(F.col("q"), F.col("g"))).first()[0] == want


def test_parent_summary(spark):
    texts = [["a  b", "A B", None, "c", "d"], ["x" * 600, "y"], ["", None], None]
    got = each(spark, texts, generated.parent_summary(F.coalesce("x", F.array().cast("array<string>")), F.lit(" the  title ")), "array<string>")
    assert got == ["a b\n\nc", "x" * 600, "the title", "the title"]


def test_paths_of_a_corpus(spark):
    paths = ["memo://c/doc/1::a", "memo://only", "/corpus/x.md", "/else/x.md", "./../x  y.md", "v/a.transcript.json", "", None]
    assert each(spark, paths, identity.corpus_path(F.col("x"), "/corpus/")) == ["doc/1::a", "only", "x.md", "/else/x.md", "x y.md", "v/a.transcript.json", "", ""]
    assert each(spark, paths, identity.memory_key(F.col("x"), "/corpus")) == ["doc/1", "only", "x.md", "/else/x.md", "x y.md", "v/a.mp4", "", ""]


def test_typos(spark):
    asked = ["two words here", "single", "a b", "", None, "repeat repeat repeat"]
    got = each(spark, asked, evaluate.with_typo(F.col("x")))
    assert got[1] == "single" and got[2] == "a b" and got[3] == "" and got[4] is None
    for a, b in ((asked[0], got[0]), (asked[5], got[5])):
        assert sorted(a) == sorted(b) and sum(x != y for x, y in zip(a.split(), b.split(), strict=True)) <= 1
    assert got == each(spark, asked, evaluate.with_typo(F.col("x")))


def test_categories(spark):
    asked = spark.createDataFrame([(1, "photo of it"), (2, "one two three four five six"), (3, "short"), (4, "none at all")], "query_id int, query string")
    targets = spark.createDataFrame([(1, "text"), (2, "image"), (3, "text"), (3, "image")], "query_id int, content_type string")
    got = {(r.query_id, r.category) for r in evaluate.query_categories(asked, targets).collect()}
    assert got == {(1, "text_only"), (1, "cross_modal"), (2, "image_only"), (2, "cross_modal"), (2, "long_query"), (3, "short_query"), (3, "cross_modal")}
