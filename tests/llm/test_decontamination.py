"""Benchmark passages in documents, against a scan for every window."""

import random
import re
from hashlib import sha256

import pytest

from lodestore.llm.decontamination import contamination, decontaminated, with_matches

from .cases import documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    """docs, items: (id, text)."""
    found = {}
    for i, text in items:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            found.setdefault(tuple(w[k : k + n]), set()).add(i)
    sizes = {len(k) for k in found}
    told = [words(t) for _, t in items]
    out = []
    for d, text in docs:
        w, hit, ids = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (own := found.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    ids |= own
        longest = 0
        for k in range(len(w)) if hit else ():
            for t in told:
                for j in range(len(t)):
                    n = 0
                    while k + n < len(w) and j + n < len(t) and w[k + n] == t[j + n]:
                        n += 1
                    longest = max(longest, n if n >= min(window, len(t)) else 0)
        names = sorted(str(i) for i in ids if i is not None)
        out.append((d, len(w), len(hit), len(names), sha256(",".join(names).encode()).hexdigest(), bool(hit), longest))
    return sorted(out, key=str)


def told(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest").collect()), key=str)


def cases(seed):
    r = random.Random(seed)
    vocabulary = ["the", "of", "is", "é", "ß9", "日本", "x", "yes", "no", "word"]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(r.randint(8, 40)))) for i in range(12)]
    items += [(20, "Unusual short one"), (21, "Unusual short one"), (22, "...!"), (23, ""), (24, None), (None, "nobody owns these four"), (25, "x " * 30), (26, items[0][1])]
    docs = []
    for i in range(60):
        w = say(r.randint(0, 50))
        at = r.randint(0, len(w))
        piece = r.choice(items)[1] or ""
        cut = piece.split()[r.randint(0, 3) :][: r.randint(5, 40)]
        docs.append((i, r.choice([" ", "\n", ", ", "--"]).join(x.upper() if x.isascii() and r.random() < 0.2 else x for x in w[:at] + cut + w[at:])))
    docs += [(100, None), (101, ""), (102, "x " * 500), (103, "a UNUSUAL, short one."), (103, "a UNUSUAL, short one."), (104, "nobody owns these four"), (None, items[1][1]), (105, " ".join(say(6000)))]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_scan(spark, seed):
    docs, items = cases(seed)
    got = told(contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert [r for r in got if r[0] != 105] == brute([d for d in docs if d[0] != 105], items)
    assert [r[:6] for r in got if r[0] == 105] == [of_one(105, docs[-1][1], items)]


def of_one(doc_id, text, items, window=10):
    """The row of a long text, without its longest match."""
    w, hit, ids = words(text), set(), set()
    places = {}
    for k in range(len(w) - window + 1):
        places.setdefault(tuple(w[k : k + window]), []).append(k)
    for i, t in items:
        x = words(t)
        n = min(window, len(x))
        for j in range(len(x) - n + 1 if n else 0):
            own = places.get(tuple(x[j : j + n]), []) if n == window else [k for k in range(len(w) - n + 1) if w[k : k + n] == x[j : j + n]]
            for k in own:
                hit.update(range(k, k + n))
                ids.add(i)
    names = sorted(str(i) for i in ids if i is not None)
    return doc_id, len(w), len(hit), len(names), sha256(",".join(names).encode()).hexdigest(), bool(hit)


def test_blocks_of_the_benchmark_give_the_same(spark):
    docs, items = cases(3)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert told(contamination(d, b, block_bytes=300)) == told(contamination(d, b))


def test_places_of_the_longest_match(spark):
    items = spark.createDataFrame([(7, "one two three four five six seven eight nine ten eleven twelve thirteen")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Well: two three four five six seven eight nine ten eleven twelve end. two three")], "doc_id long, text string")
    found = with_matches(docs, items).first().found
    assert (found.spans, found.longest, found.longest_at, found.longest_item, found.longest_item_at) == ([1, 12], 11, 1, "7", 1)


def test_affected_documents_leave(spark):
    docs = documents(spark)
    passage = " ".join(docs.where("doc_id = 14").first().text.split()[60:75])
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    clean = decontaminated(docs, items)
    assert clean.columns == docs.columns
    gone = {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in clean.select("doc_id").collect()}
    assert gone == {13, 14, 15, 16}


def test_empty_tables(spark):
    docs, none = documents(spark), spark.createDataFrame([], "item_id long, text string")
    got = contamination(docs, none)
    assert got.where("contaminated or n_items > 0 or n_hit > 0").count() == 0 and got.count() == docs.count()
    assert {r.doc_id: r.n_words for r in got.collect() if r.doc_id == 10} == {10: 2}
    assert contamination(documents(spark, empty=True), spark.createDataFrame([(1, "x")], "item_id long, text string")).count() == 0
