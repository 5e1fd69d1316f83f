import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from lodestore.llm import suffix_dedup as sd

from .cases import documents


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[: len(r)]
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((len(r), int(gone.sum()), len(edges) // 2, sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(1, 8)))
    say = lambda n: " ".join(word() for _ in range(n))
    shared = [say(n) for n in (9, 12, 20, 40, 90)]
    out = [None, "", "short", "a" * 450, "ab" * 300, "z" * 59, "z" * 60]
    for _ in range(60):
        parts = [say(r.randint(0, 30))]
        for _ in range(r.randint(0, 4)):
            parts += [r.choice(shared), say(r.randint(0, 12))]
        out.append(" ".join(parts))
    out += [out[10], out[10], out[11][3:], out[12] + "x", "q" + out[13], out[14][:-1]]
    return out


@pytest.mark.parametrize("seed, limit", [(1, 8000), (2, 3)])
def test_equals_brute_force(spark, seed, limit):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i // 2, t, i, b"k") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int, kept binary").repartition(3)
    rows = sd.suffix_dedup(docs, length=60, gram=16, max_segments=limit).collect()
    want = {i: w for i, w in enumerate(brute(texts, 60))}
    assert {r["n_bytes"]: (r["n_bytes_"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == want
    assert all(sha256(r["kept_"]).hexdigest() == r["kept_sha256"] and sum(s.b - s.a for s in r["spans"]) == r["n_removed"] for r in rows)


def test_awkward_rows_at_the_production_length(spark):
    docs = documents(spark)
    rows = docs.collect()
    want = Counter((r.doc_id, *w) for r, w in zip(rows, brute([r.text for r in rows], 400), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.suffix_dedup(docs).collect()) == want
    assert sd.suffix_dedup(documents(spark, empty=True)).count() == 0


def test_merged_transforms_find_repeats_of_any_shard_size():
    r = random.Random(4)
    shared = bytes(r.choice(b"ab") for _ in range(300))
    segments = []
    for _ in range(25):
        a = r.randint(0, 150)
        segments.append(bytes(r.choice(b"abc") for _ in range(r.randint(0, 40))) + shared[a : a + r.randint(60, 140)] + bytes(r.choice(b"abc") for _ in range(r.randint(0, 40))))
    seen = Counter(s[i : i + 60] for s in segments for i in range(len(s) - 59))
    want = []
    for s in segments:
        hits = [i for i in range(len(s) - 59) if seen[s[i : i + 60]] > 1]
        want.append((min(hits, default=-1), max(hits, default=-1)))
    for shard in (1, 300, 1 << 20):
        lo, hi = sd.repeated_starts(np.frombuffer(b"".join(segments), np.uint8), np.cumsum([len(s) for s in segments]), 60, shard_bytes=shard)
        assert list(zip(lo.tolist(), hi.tolist(), strict=True)) == want


def test_long_texts_are_cut_into_overlapping_units():
    r = np.random.default_rng(0)
    raw = r.integers(97, 100, 5000, dtype=np.uint8).tobytes()
    starts = []
    for _, offsets, data, ends in sd._units([raw], 400, most=700):
        _, _, s, c, _ = sd.runs_of(data, ends, 400, 64)
        unit = np.searchsorted(ends, s, side="right")
        for a, k in zip(s - np.concatenate([[0], ends[:-1]])[unit] + np.array(offsets)[unit], c, strict=True):
            starts += range(a, a + k)
    assert sorted(starts) == list(range(5000 - 399))


def test_passages_of_over_fifty_words_go_and_clean_texts_stay(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 6)))
    say = lambda n: " ".join(word() for _ in range(n))
    passages = [p for p in (say(r.randint(51, 70)) for _ in range(60)) if 250 <= len(p) < 400][:25]
    rows = [(i, f"{say(r.randint(0, 60))} {passages[i % 25]} {say(r.randint(1, 60))}") for i in range(75)]
    clean = [(100 + i, say(r.randint(1, 300))) for i in range(40)]
    docs = spark.createDataFrame(rows + clean, "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.text for x in sd.suffix_dedup_text(docs).collect()}
    assert len(passages) == 25 and all(passages[i % 25] not in got[i] and len(got[i]) < len(t) - 200 for i, t in rows)
    assert all(got[i] == t for i, t in clean)


def test_two_lengths_in_one_scan(spark):
    texts = corpus(5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {x.doc_id: x for x in sd.suffix_dedup(docs, length=60, passage=32, gram=8, replace=True).collect()}
    assert {i: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for i, x in rows.items()} == dict(enumerate(brute(texts, 60)))
    short = {x.doc_id: x.text for x in sd.suffix_dedup_text(docs, length=32, gram=8).collect()}
    assert {i: x.passage_text for i, x in rows.items()} == short and short[0] is None
    for i, x in rows.items():
        raw = (x.text or "").encode()
        assert sha256(raw).hexdigest() == x.kept_sha256 or len(raw) < x.n_bytes - x.n_removed  # the text is what the row describes
    for i, (_, _, _, digest) in enumerate(brute(texts, 32)):
        raw = (short[i] or "").encode()
        assert sha256(raw).hexdigest() == digest or len(raw) < len((texts[i] or "").encode())  # split characters go as a whole
    for bad in ({"length": 61}, {"passage": 400}, {"length": 512}):
        with pytest.raises(ValueError):
            sd.suffix_dedup(docs, **bad)
