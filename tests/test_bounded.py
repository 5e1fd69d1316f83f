"""First rows of groups kept down before the exchange, and what is made of them."""

import pytest
from pyspark.sql import functions as F

from lodestore.operators import bounded, memories


def test_firsts_equal_a_sort_of_each_group(spark):
    rows = [(i % 3 if i % 7 else None, (i * 37) % 50, i) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, v int, i int").repartition(5)
    got = sorted((r.g is None, r.g or 0, r.v, r.i) for r in bounded.firsts(df, ["g"], ["v", "i"], 4).collect())
    want = [(g is None, g or 0, v, i) for g in {r[0] for r in rows} for v, i in sorted((v, i) for h, v, i in rows if h == g)[:4]]
    assert got == sorted(want)
    different = bounded.firsts_different(df, ["g"], "v", ["v", "i"], 4)
    for g in {r[0] for r in rows}:
        firsts = {}
        for h, v, i in sorted(rows, key=lambda r: r[1:]):
            if h == g:
                firsts.setdefault(v, i)
        assert sorted((r.v, r.i) for r in different.where(F.col("g").eqNullSafe(F.lit(g))).collect()) == sorted(firsts.items())[:4]
    assert "WindowGroupLimit" in bounded.firsts(df, ["g"], ["v"], 2)._jdf.queryExecution().executedPlan().toString()
    for n in (0, bounded.MOST + 1):
        with pytest.raises(ValueError):
            bounded.firsts(df, ["g"], ["v"], n)


def test_summaries_of_long_memories(spark):
    """Repeated, blank and null texts and tags, a null memory and an empty table; only the first different ones show."""
    kind = "memory_id string, memory_role string, pos int, seq int, file_path string, text_body string, tags array<string>, title string"
    many = [("m", "child", 0, i, "m/a", ["One", "one", " ", None][i % 4] if i < 400 else f"text {i}", ["B ", "a", None, f"t{i}"], None) for i in range(500)]
    rows = [*many, ("m", "root", 0, 0, "m", None, None, "Root"), (None, None, None, None, "x", "  Said   so ", [], None), ("blank", "root", 0, 0, "b", " ", [""], None)]
    df = spark.createDataFrame(rows, kind).repartition(4)
    got = {r.memory_id: (r.summary, r.tags, r.snippets) for r in memories.summaries(df).collect()}
    assert got == {"m": ("One text 400", ["b", "a", *[f"t{i}" for i in range(6)]], 501), None: ("Said so", [], 1), "blank": ("", [], 1)}
    parents = {r.memory_id: r.summary for r in memories.parent_summaries(df).collect()}
    assert parents == {"m": "One\n\ntext 400", None: "Said so", "blank": ""}
    blank = df.where("memory_id = 'm' and text_body is null")
    assert [r.summary for r in memories.parent_summaries(blank).collect()] == ["Root"]
    assert memories.summaries(df.limit(0)).count() == 0 == memories.parent_summaries(df.limit(0)).count()
