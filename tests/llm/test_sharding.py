from collections import Counter, defaultdict
from zlib import crc32

import numpy as np

from lodestore.llm import sharding

from .cases import documents


def check(rows, docs, shards=16):
    assert len(rows) == len(docs)
    slots, homes = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        homes[r.text or ""].add(r.shard)
        body = (r.text or "").encode()
        assert r.size == len(body) + 1 and r.text_crc32 == crc32(body) and r.law == "bytes" and r.grown_shard is None
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    assert all(len(s) == 1 for s in homes.values()) and set(slots) <= set(range(shards))
    return Counter({s: sum(r.size for r in rows if r.shard == s) for s in range(shards)})


def test_awkward_rows(spark):
    docs = documents(spark)
    check(sharding.shard_by_bytes(docs).collect(), docs.collect())
    assert sharding.shard_by_bytes(docs).columns[: len(docs.columns)] == docs.columns
    assert sharding.shard_by_bytes(documents(spark, empty=True)).count() == 0


def test_sizes_are_near_equal_with_heavy_groups(spark):
    r = np.random.default_rng(5)
    rows = [(i, "t%d " % i + "x" * int(r.integers(1, 900))) for i in range(6000)]
    rows += [(10000 + i, "hot copy " * 30) for i in range(500)] + [(20000 + i, "warm copy " * 30) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    sizes = check(sharding.shard_by_bytes(docs).collect(), rows)
    mean = sum(sizes.values()) / 16
    assert max(abs(s - mean) for s in sizes.values()) < 0.02 * mean


def test_group_above_a_shard(spark):
    rows = [(i, "same " * 50) for i in range(300)] + [(1000 + i, f"other {i} " + "y" * 200) for i in range(600)]
    sizes = check(sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)
    small = sorted(sizes.values())[:15]
    assert small[-1] - small[0] < 0.1 * small[0]
