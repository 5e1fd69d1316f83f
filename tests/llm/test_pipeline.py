import pytest

from lodestore.llm import line_dedup as ld
from lodestore.llm import quality, simhash
from lodestore.llm.suffix_dedup import PASSAGE

from .cases import documents

pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's rows over the small documents table, with the first stage's input in front."""
    folder = str(tmp_path_factory.mktemp("sf"))
    documents(spark).select(*COLUMNS).write.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 7 != 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    out = [spark.read.parquet(f"{folder}/documents.parquet")]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, out[-1], folder).write.parquet(f"{folder}/out-{k}")
        out.append(spark.read.parquet(f"{folder}/out-{k}"))
    return folder, out


def rows(df):
    return sorted(map(repr, df.collect()))


def test_stages_return_documents(stages):
    _, out = stages
    for df in out[1:-1]:
        assert df.columns == COLUMNS and df.count() > 0
    assert "sequence_id" in out[-1].columns


def test_quality_stage_keeps_what_the_rules_keep(spark, stages):
    folder, out = stages
    judged = quality.quality_rules(out[0], spark.read.parquet(f"{folder}/labels.parquet"))
    assert sorted(map(str, (r.doc_id for r in judged.where("kept").collect()))) == sorted(str(r.doc_id) for r in out[1].collect())


def test_line_stage(stages):
    _, out = stages
    want = ld.line_dedup(out[1]).select(*COLUMNS[:-1])
    assert rows(want) == rows(out[2].select(*COLUMNS[:-1]))
    assert all(r.n_chars == len(r.text) for r in out[2].collect())


def test_simhash_stage_leaves_one_of_each_group(stages):
    _, out = stages
    groups = simhash.near_copies(out[2])
    assert {r.doc_id for r in out[3].where("doc_id is not null").collect()} == {r.component_id for r in groups.collect()}


def test_suffix_stage_leaves_no_repeat(stages):
    from collections import Counter

    _, out = stages
    seen = Counter()
    for r in out[3].collect():
        raw = r.text.encode()
        seen.update(raw[i : i + PASSAGE] for i in range(len(raw) - PASSAGE + 1))
    for before, after in zip(sorted(out[3].collect(), key=repr), sorted(out[4].collect(), key=repr), strict=True):
        raw = before.text.encode()
        if not any(seen[raw[i : i + PASSAGE]] > 1 for i in range(len(raw) - PASSAGE + 1)):
            assert before == after
        else:
            assert len(after.text) < len(before.text)


def test_run_equals_the_stages(spark, stages):
    folder, out = stages
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows(pipeline.run(spark, folder).select(*columns)) == rows(out[-1].select(*columns))


def line_dedup_brute(data):
    from collections import Counter, defaultdict

    pages, seen = Counter(), defaultdict(Counter)
    for _, text, source in data:
        if source is not None:
            pages[source] += 1
            seen[source].update({x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")})
    out = []
    for d, text, source in data:
        bad = {x for x, n in seen[source].items() if n >= 2 and n > 0.1 * pages[source]} if source is not None else set()
        lines = (text or "").split("\n")
        kept = [x for x in lines if x not in bad]
        out.append((d, None if text is None else "\n".join(kept), len(lines) if text else 0, len(lines) - len(kept)))
    return out


def test_line_dedup_equals_brute_force(spark):
    docs = documents(spark)
    data = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    for limit in (ld.BROADCAST_BYTES, 0):
        got = ld.line_dedup(docs, broadcast_bytes=limit)
        assert sorted(map(repr, ((r["doc_id"], r["text"], r["n_lines_"], r["n_removed"]) for r in got.collect()))) == sorted(map(repr, line_dedup_brute(data)))
    assert ld.line_dedup(documents(spark, empty=True)).count() == 0


def test_run_leaves_only_its_result(spark, stages):
    import os
    import re

    out = pipeline.run(spark, stages[0])
    folder = re.sub("^file:/*", "/", os.path.dirname(out.inputFiles()[0]))
    assert os.listdir(os.path.dirname(folder)) == [str(len(pipeline.STAGES) - 1)]


def test_awkward_tables_pass_every_stage(spark, tmp_path):
    """Nulls in every column, empty and long texts, ties, repeated rows, an empty table, columns with other names' clashes."""
    folder = str(tmp_path)
    extra = documents(spark).select(*COLUMNS, "Verdict", "component", "line")
    nulls = spark.createDataFrame([(None, None, None, None, None, None, None, None), (900, "", None, "s0", 0, "v", "c", "l"), (901, None, "en", None, None, None, None, None)], extra.schema)
    docs = extra.unionByName(nulls)
    labels = spark.createDataFrame([(0, 1, 0), (None, None, None), (1, 0, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        for given in (docs, docs.where("false")):
            got = stage(spark, given, folder)
            assert got.columns == docs.columns and got.count() <= given.count()
    packed = pipeline.STAGES[-1][1](spark, docs, folder)
    assert packed.count() >= docs.count() and pipeline.STAGES[-1][1](spark, docs.where("false"), folder).count() == 0
