"""The Merkle manifest against a tree built in one list, and the forest as a monoid."""

import random
import zlib
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestore.llm.merkle import TOP, Forest, joined, merkle_manifest

from .cases import documents

def spoilt_rows():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaf(*fields):
    return sha256("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields).encode()).hexdigest()


def climb(nodes):
    """Levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([joined(levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    for level in levels[:-1]:
        yield level[i // 16 * 16 : i // 16 * 16 + 16], i % 16
        i //= 16


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (own := sorted(by[s], key=lambda x: x[:3]), climb([x[2] for x in own])) for s in order}
    top = climb([trees[s][1][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        own, levels = trees[s]
        for i, (_, _, digest, r) in enumerate(own):
            way = [*path(levels, i), *path(top, k)]
            proof = sha256("".join(d for run, at in way for j, d in enumerate(run) if j != at).encode()).hexdigest()
            spoilt = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            back = leaf(*r[:4], r[4].translate(LOWER)) if spoilt else digest
            for run, at in way:
                back = joined([*run[:at], back, *run[at + 1 :]])
            out.append((r[0], digest, levels[-1][0], top[-1][0], proof, back, back == top[-1][0]))
    return sorted(out, key=str)


def told(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize(("rows", "fan"), [(2048, 16), (7, 2), (40, 3)])
def test_equals_one_list(spark, rows, fan):
    docs = documents(spark)
    want = brute([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()])
    assert told(merkle_manifest(docs, tampered=spoilt_rows(), partition_rows=rows, fan_in=fan)) == want
    assert any(not w[-1] for w in want) and any(w[-1] for w in want)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 700])
def test_sizes_around_runs(spark, n):
    r = random.Random(n)
    rows = [(i, r.choice([None, "", "a", "Zé", "hot", "hot", "hot"]) if n > 2 else "a", "en", i, f"Text {i}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert told(merkle_manifest(docs, tampered=spoilt_rows(), partition_rows=30, fan_in=4)) == brute(rows)


def test_many_sources_and_one_row_repeated(spark):
    rows = [(i, f"s{i % 290}", None, None, "T") for i in range(400)] + [(5, "s5", "en", 1, "Same")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert told(merkle_manifest(docs, tampered=spoilt_rows(), partition_rows=50, fan_in=2)) == brute(rows)


def test_empty_table(spark):
    assert merkle_manifest(documents(spark, empty=True), tampered=spoilt_rows()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=20), st.randoms(use_true_random=False))
def test_merging_is_associative(sizes, r):
    """Any stretches, merged in any order, close the same runs and leave the root alone."""
    leaves = [((t, 0, i), joined([f"{t} {i}"])) for t, n in enumerate(sizes) for i in range(n)]
    of = lambda t: len(sizes) if t == TOP else sizes[t]
    whole = Forest(of).add(leaves)
    cuts = sorted({0, len(leaves), *(r.randrange(len(leaves) + 1) for _ in range(6))})
    parts = [Forest(of).add(leaves[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    assert all(len(p.nodes) <= 2 * 15 * 12 for p in parts)
    while len(parts) > 1:
        a, b = parts.pop(r.randrange(len(parts))), parts.pop(r.randrange(len(parts)))
        parts.append(Forest(of).add([*a.nodes.items(), *b.nodes.items()]))
    assert parts[0].nodes == whole.nodes and len(whole.nodes) == 1
    assert next(iter(whole.nodes))[0] == TOP
