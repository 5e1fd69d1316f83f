import random
from itertools import combinations

import corpus_pipeline
from lodestore.llm import simhash


def own_words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


def test_pair_behind_an_unlike_smallest_text(spark):
    """A table bar gives all texts one fingerprint; only the two that are not the smallest are alike."""
    bar = " |" * 400
    first, other = own_words(1, 100), own_words(2, 100)
    near = [*other[:50], "changed", *other[51:]]
    rows = [(k, " ".join(w) + bar) for k, w in enumerate([first, other, near])]
    assert len({simhash.fingerprint(t) for _, t in rows}) == 1
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(0, 0), (1, 1), (2, 1)]


def test_stage_leaves_no_pair_of_the_required_similarity(spark):
    """Against plain Jaccard similarity, without any fingerprint."""
    r, rows = random.Random(4), []
    for i in range(30):
        base = own_words(100 + i, 200)
        for changes in (0, 4, 4, 5, 9):
            w = list(base)
            for at in r.sample(range(200), changes):
                w[at] = f"new{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w), f"s{i}"))
    sets = []
    for _, t, _ in rows:
        w = t.split()
        sets.append({" ".join(w[k : k + 5]) for k in range(len(w) - 4)})
    least = list(range(len(rows)))
    pairs = [(i, j) for i, j in combinations(range(len(rows)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in rows:
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = corpus_pipeline.simhash_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(least)) and len(set(least)) < len(rows)
