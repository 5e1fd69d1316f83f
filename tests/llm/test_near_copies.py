import random
from itertools import combinations

from lodestore.llm import components, simhash

from .cases import documents


def brute(rows):
    """Components of rows (doc_id, text), all doc_ids different, by plain Jaccard similarity of five-word shingles."""
    sets, keys = [], []
    for _, t in rows:
        words = (t or "").encode().lower().split()
        keys.append(b" ".join(words))
        sets.append({b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        union = len(sets[i] | sets[j])
        if keys[i] == keys[j] or not union or len(sets[i] & sets[j]) >= 0.8 * union:
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, least[find(i)]) for i, (d, _) in enumerate(rows))


def edited(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(500)]
    out = []
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.randint(80, 300))]
        out.append(" ".join(base))
        for changes in (0, 1, 1, 2, 3, 6, 20):
            own = list(base)
            for _ in range(changes):
                own[r.randrange(len(own))] = r.choice(words)
            out.append(" ".join(own))
    r.shuffle(out)
    return out


def test_groups_equal_brute_force(spark):
    rows = list(enumerate(edited(3) + ["", None, " \n", "one", "One", "two words", "three small words"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_copies(docs).collect())
    assert got == brute(rows)


def test_light_edits_are_found(spark):
    r = random.Random(9)
    say = lambda n: [f"w{r.randint(0, 5000)}" for _ in range(n)]
    rows = []
    for i in range(60):
        base = say(300)
        rows.append((2 * i, " ".join(base)))
        base[r.randrange(300)] = "changed"
        rows.append((2 * i + 1, " ".join(base)))
    groups = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(groups[2 * i + 1] == 2 * i for i in range(60)) >= 57 and all(groups[2 * i] == 2 * i for i in range(60))


def test_awkward_rows(spark):
    docs = documents(spark)
    kept = simhash.near_copy_dedup(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {0, 4, None} and not {1, 2, 3, 5, 6} & {r.doc_id for r in kept.collect()}
    assert simhash.near_copies(documents(spark, empty=True)).count() == 0


def test_fingerprints_only_shorten_the_way(spark):
    """Other distances change what is compared first, never the groups; a few words in common link nobody."""
    r = random.Random(5)
    crowd = [f"common words of many texts here {' '.join(f'x{r.randrange(10**6)}' for _ in range(40))}" for _ in range(60)]
    rows = list(enumerate(edited(8)[:40] + crowd))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = brute(rows)
    for distance in (0, 3, 7):
        assert sorted((x.doc_id, x.component_id) for x in simhash.near_copies(docs, distance=distance).collect()) == want


def test_word_shingles():
    assert len(simhash.word_shingles(None)) == len(simhash.word_shingles(" \n")) == 0
    assert len(simhash.word_shingles("a b c")) == 1 and len(simhash.word_shingles("a a a a a a a")) == 1
    one, two = simhash.word_shingles("a b c d e f"), simhash.word_shingles("B C D E F")
    assert len(one) == 2 and len(two) == 1 and two[0] in one and simhash.word_shingles("b a")[0] != simhash.word_shingles("a b")[0]


def test_near_copies_meet_once(spark, monkeypatch):
    """Copies that share many rare shingles are met once each, and not once per shingle."""
    r = random.Random(11)
    rows = []
    for _ in range(6):
        base = [f"w{r.randrange(10**6)}" for _ in range(400)]
        for place in range(4):
            own = list(base)
            own[place * 90 : place * 90 + 14] = [f"v{r.randrange(10**6)}" for _ in range(14)]
            rows.append((len(rows), " ".join(own)))
    tables, cut = [], simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df: tables.append((df.columns, df.count())) or cut(df))
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((x.doc_id, x.component_id) for x in got.collect()) == brute(rows)
    met = [n for columns, n in tables if {"key", "at", "p0"} <= set(columns)]
    assert met and max(met) <= 6 * (6 * 2 + 4 * 3 + 4)  # per family at most one key for each set of two or more of its four


def test_few_edges_need_no_rounds(spark, monkeypatch):
    """Few edges are united in one step, with the components that rounds find."""
    r = random.Random(4)
    rows = [(r.randrange(120), r.randrange(120)) for _ in range(90)] + [(1, 1), (None, 2), (3, None), (500, -7), (-7, 500)]
    edges = spark.createDataFrame(rows, "a long, b long").repartition(3)
    checks, settled = [], components._settled
    monkeypatch.setattr(components, "_settled", lambda df: checks.append(1) or settled(df))
    few = sorted(map(tuple, components.connected_components(edges).collect()))
    assert not checks
    monkeypatch.setattr(components, "FEW", 1)
    rounds = sorted(map(tuple, components.connected_components(edges).collect()))
    assert checks and few == rounds and (500, -7) in few and len(few) == len({n for n, _ in few})
    assert components.connected_components(edges.limit(0)).count() == 0
