"""The conversation trie against one built from dictionaries, and the succinct trie's navigation."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from lodestore.llm.trie import Louds, conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, k1 string"


def brute(rows):
    """rows: (conv_id, turn, role, text); equal turns must have equal role and text."""
    own = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((r or "", x or ""))
    rebuilt = {c: own.get(c - c % 100, [])[: (h := zlib.crc32(str(c).encode()) % 6)] + t[h:] for c, t in own.items()}
    members, ends = {}, {}
    for c in sorted(rebuilt):
        t = tuple(rebuilt[c])
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
        ends.setdefault(t, []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[b] for b in below) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[b] for b in below)
    out = []
    for node, cs in members.items():
        told = sha256(",".join(map(str, ends.get(node, []))).encode()).hexdigest()
        out.append((cs[0], len(node), members[node[:-1]][0] if node else None, len(cs), len(children.get(node, [])), leaves[node], saved[node], told))
    return sorted(out, key=str)


def told(df):
    columns = "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def cases(seed, n=400):
    r = random.Random(seed)
    common = [("user", "Hello"), ("assistant", "Hi, é 日本"), ("user", "Hello")]
    rows = []
    for _ in range(n):
        c = r.choice([r.randrange(0, 90), r.randrange(0, 5000), r.randrange(200, 220)]) if r.random() < 0.95 else 100 * r.randrange(0, 50)
        if any(x[0] == c for x in rows):
            continue
        say = [*common[: r.randint(0, 3)], *[(r.choice(["user", "assistant", None]), r.choice(["a", "b", "", None, "Long text " * 3])) for _ in range(r.randint(0, 6))]]
        if r.random() < 0.3:
            say = common * 2
        rows += [(c, i, *t, 1, "k") for i, t in enumerate(say or common[:1])]
    rows += [(7000, t, "user", "same place", 1, "k") for t in (None, 3, 3, -1)] + [(7001, i, "u", f"{i}", 1, "k") for i in range(150)]
    rows += [(7002, i, "u", f"{i}", 1, "k") for i in range(149)] + [(None, 0, "u", "nobody", 1, "k"), (-5, 0, "u", "x", 1, "k"), (-100, 0, "u", "y", 1, "k")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "bound"), [(1, 1), (2, 3), (3, 64)])
def test_equals_dictionaries(spark, seed, bound):
    rows = cases(seed)
    got = conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), least_bound=bound, shard_nodes=100)
    assert told(got) == brute([x[:4] for x in rows])


def test_one_conversation_in_copies(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(4)]
    got = conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), least_bound=1)
    assert told(got) == brute(rows)


def test_empty_table(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert conversation_trie(spark.createDataFrame([(None, 1, "u", "x", 1, "k")], SCHEMA)).count() == 0


def test_louds_parents_and_bits():
    r = np.random.default_rng(1)
    n = 500
    up = np.array([-1 if i < 5 else r.integers(0, i) for i in range(n)])
    level = np.zeros(n, np.int64)
    for i in range(5, n):
        level[i] = level[up[i]] + 1
    name = np.stack([r.permutation(n), np.arange(n)], axis=1)
    trie = Louds(level, name, np.where(up[:, None] < 0, 0, name[up]))
    assert len(trie.bits) == -(-(2 * n + 1) // 8) and np.unpackbits(trie.bits, count=2 * n + 1).sum() == n
    rows = trie.order
    assert [rows[p] if p >= 0 else -1 for p in trie.parent] == up[rows].tolist()
    sizes = trie.rolled_up(np.ones(n, np.int64))
    assert sizes[:5].sum() == n
    assert (trie.labels == name[rows]).all()
