"""The folder stream over restarts against listing differences, and debouncing against a step-by-step reference."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestore.streaming import debounce, folder_stream, watch

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(spark, root, out):
    spark.dataSource.register(folder_stream.FolderChanges)
    changes = spark.readStream.format("lodestore_folder").option("path", str(root / "files")).option("state", str(root / "state")).load()
    got = []
    q = changes.writeStream.foreachBatch(lambda df, i: got.extend(tuple(r) for r in df.select("path", "change").collect())).option("checkpointLocation", str(root / "ckpt")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    out.append(sorted(got))


def write(root, name, text, ms):
    place = root / "files" / name
    place.parent.mkdir(parents=True, exist_ok=True)
    place.write_text(text)
    os.utime(place, ns=(ms * 1_000_000, ms * 1_000_000))


def test_a_folder_stream_goes_on_where_it_stopped(spark, tmp_path):
    out, r = [], random.Random(3)
    (tmp_path / "files").mkdir()
    listed = lambda: folder_stream.listing(str(tmp_path / "files")).to_pandas()[["path", "length", "modified_ms"]]
    before = listed()
    kind = "path string, length long, modified_ms long"
    for step in range(3):
        for i in range(30):
            if r.random() < 0.5:
                write(tmp_path, f"d{i % 3}/f{i}.md", "x" * r.randint(1, 5), 1_000_000 + step * 1000)
            elif (p := tmp_path / f"files/d{i % 3}/f{i}.md").exists() and r.random() < 0.4:
                p.unlink()
        write(tmp_path, ".git/x", "hidden", 1)
        drained(spark, tmp_path, out)
        now = listed()
        want = watch.snapshot_diff(*(spark.createDataFrame(list(map(tuple, x.values.tolist())), kind) for x in (before, now)))
        assert out[-1] == sorted((x.path, x.change) for x in want.collect()) and out[-1]
        before = now
    drained(spark, tmp_path, out)
    assert out[-1] == [] and {c for x in out for _, c in x} == {"created", "modified", "deleted"}
    assert len([f for f in os.listdir(tmp_path / "state") if f.startswith("listing")]) <= 2


def test_differences_in_partitions_are_whole(tmp_path, monkeypatch):
    monkeypatch.setattr(folder_stream, "PARTITION_PATHS", 10)
    for i in range(95):
        write(tmp_path, f"f{i}", "x", 1000)
    reader = folder_stream.FolderReader(str(tmp_path / "files"), str(tmp_path / "state"))
    end = reader.latestOffset()
    parts = reader.partitions(reader.initialOffset(), end)
    assert len(parts) == 9 and sorted(x[0] for p in parts for x in reader.read(p)) == sorted(f"f{i}" for i in range(95))
    assert reader.latestOffset() == end and reader.partitions(end, end) == []


def step_by_step(batches, quiet, most):
    """The rows told, batch by batch: a batch's timers see the watermark that earlier batches left."""
    held, out, mark = {}, [], 0
    for batch in [*batches, []]:
        for path in {e[0] for e in batch}:
            for _, change, ts, event in sorted((e for e in batch if e[0] == path), key=lambda e: e[2:]):
                old = held.pop(path, None)
                newest = (change, ts, event) if old is None or (ts, event) > old[1:3] else old[:3]
                n = (old[3] if old else 0) + 1
                if n >= most:
                    out.append((path, newest[0], newest[2], n))
                else:
                    held[path] = (*newest, n)
        for path, (change, ts, event, n) in list(held.items()):
            if ts + quiet <= mark:
                out.append((path, change, event, n))
                del held[path]
        mark = max([mark, *(e[2] for e in batch)])
    return sorted(out)


def test_bursts_are_told_once(spark, tmp_path):
    r, batches, now, event = random.Random(4), [], 1_000_000, 0
    for _ in range(5):
        batch = []
        for _ in range(25):
            now += r.choice([0, 10, 300])
            event += 1
            batch.append((f"p{r.choice([0, 0, 0, r.randint(1, 9)])}", r.choice(["created", "modified", "deleted"]), now, event))
        batches.append(batch)
        now += r.choice([0, 3000])
    src = tmp_path / "events"
    src.mkdir()
    for i, batch in enumerate(batches):
        place = src / f"{i}.json"
        place.write_text("\n".join(json.dumps(dict(zip(("path", "change", "ms", "event_id"), e, strict=True))) for e in batch))
        os.utime(place, (1000 + i, 1000 + i))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        events = spark.readStream.schema("path string, change string, ms long, event_id long").option("maxFilesPerTrigger", 1).json(str(src)).withColumn("ts", F.timestamp_millis("ms"))
        got = []
        told = debounce.debounced(events, quiet_ms=1000, most=7)
        q = told.writeStream.foreachBatch(lambda df, i: got.extend((x.path, x.change, x.event_id, x.events) for x in df.collect())).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        assert q.awaitTermination(240) and q.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert sorted(got) == step_by_step(batches, 1000, 7) and any(x[3] == 7 for x in got) and any(x[3] < 7 for x in got)


@pytest.mark.parametrize("path", ["", "nothing-here"])
def test_an_absent_folder_is_empty(tmp_path, path):
    assert folder_stream.listing(str(tmp_path / "files" / path)).num_rows == 0
