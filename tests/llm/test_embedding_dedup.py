import numpy as np
import pytest

from lodestore.llm import embedding_dedup as ed


def brute(rows, threshold=0.9):
    def unit(e):
        if not e or any(x is None or not np.isfinite(x) for x in e) or not any(e):
            return None
        v = np.zeros(8)
        v[: len(e)] = np.array(e, np.float32)
        return v / np.linalg.norm(v)

    units = [None if i is None else unit(e) for i, e in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and units[i] @ units[j] >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            todo = [j for x in todo for j in near[x] if j not in seen and not seen.add(j)]
        own = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(own, default=None)
        out.append((rows[i][0], len(near[i]), least, rows[i][0] is None or rows[i][0] == least))
    return sorted(out, key=repr)


def rows_of(seed=2):
    r = np.random.default_rng(seed)
    base = r.normal(size=(30, 8))
    rows = [(i, (base[i % 30] + r.normal(size=8) * r.choice([0, 0.05, 0.2, 0.4])).tolist()) for i in range(160)]
    rows += [(500 + i, [1.0, 2, 3, 4, 5, 6, 7, 8]) for i in range(20)] + [(600, [2.0, 4, 6, 8, 10, 12, 14, 16]), (601, [1.0, 2, 3])]
    rows += [(700, None), (701, []), (702, [0.0] * 8), (703, [1.0, None] + [0.0] * 6), (704, [float("nan")] * 8), (705, [float("inf")] + [1.0] * 7)]
    return rows + [(3, rows[3][1]), (None, rows[4][1]), (706, [1e-30] * 8), (707, [1e30] * 8)]


@pytest.mark.parametrize("cell, block", [(4096, 2048), (16, 8), (40, 64), (4096, 16)])
def test_groups_equal_brute_force(spark, cell, block):
    rows = rows_of()
    df = spark.createDataFrame([(i, e and [None if x is None else float(x) for x in e], 1, 2) for i, e in rows], "vec_id long, embedding array<float>, uid int, root int").repartition(3)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in ed.embedding_groups(df, cell=cell, block=block).collect()), key=repr)
    assert got == brute(rows)


def test_empty_and_single(spark):
    kind = "vec_id long, embedding array<double>"
    assert ed.embedding_groups(spark.createDataFrame([], kind)).count() == 0
    assert [tuple(r) for r in ed.embedding_groups(spark.createDataFrame([(4, [1.0, 0.0])], kind)).collect()] == [(4, 0, 4, True)]


def test_ring_blocks_meet_within_reach_only():
    r = np.random.default_rng(5)
    sizes = {(0, True, int(k)): int(r.integers(1, 30)) for k in r.permutation(ed.RINGS)[:12]} | {(0, False, int(k)): int(r.integers(1, 30)) for k in r.permutation(ed.RINGS)[:9]}
    width, reach = np.pi / ed.RINGS, 0.45
    rows = {(home, ring): x for _, home, ring, *x in ed.ring_layout(sizes, 16, reach)}
    held = {}
    for (home, ring), (first, count, *_) in rows.items():
        for k in range(count):
            held.setdefault((first + k, home), []).append(sizes[0, home, ring] / count)
    assert all(sum(x) <= 16 for x in held.values())
    for (h1, a), (f1, n1, *x) in rows.items():
        for (h2, b), (f2, n2, *_) in rows.items():
            met = all(x[0] <= k <= x[1] or x[2] <= k <= x[3] for k in range(f2, f2 + n2))
            if (h1 or h2) and (abs(a - b) - 1) * width <= reach:
                assert met
            if not h1 and not h2:
                assert not met
    alone = ed.ring_layout({(3, True, 5): 9}, 16, reach)
    assert alone == [(3, True, 5, 0, 1, 0, 0, 0, -1)]


def test_a_crowd_of_linked_vectors_in_tiles(spark):
    """Chains that only close over several tiles, in one block."""
    angles = np.arange(1300) * 0.004
    rows = [(int(i), [float(np.cos(x)), float(np.sin(x))]) for i, x in zip(np.random.default_rng(1).permutation(1300), angles, strict=True)]
    got = ed.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    e = np.array([v for _, v in sorted(rows)])
    want = (e @ e.T / np.outer(*[np.linalg.norm(e, axis=1)] * 2) >= 0.9).sum(axis=1) - 1
    assert {r.component_id for r in got} == {0} and [r.n_links for r in sorted(got)] == want.tolist()


def test_clusters_are_parted_by_bounds(spark):
    """At production parameters: several cells, and pairs of far clusters excluded."""
    r = np.random.default_rng(7)
    centres = r.normal(size=(12, 6))
    rows = [(i, (centres[i % 12] + r.normal(size=6) * 0.03).tolist()) for i in range(1200)]
    report = {}
    got = ed.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), report=report).collect()
    e = np.array([v for _, v in rows])
    want = (e @ e.T / np.outer(*[np.linalg.norm(e, axis=1)] * 2) >= 0.9).sum(axis=1) - 1
    assert [x.n_links for x in sorted(got)] == want.tolist()
    assert report["cells"] == 3 and report["pairs"] == 1200 * 1199 // 2 and want.sum() // 2 <= report["compared"] < 0.9 * report["pairs"]
