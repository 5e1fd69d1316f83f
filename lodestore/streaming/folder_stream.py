"""A folder as a stream of changes: offsets are numbers of listings, which a state folder keeps.

    spark.dataSource.register(FolderChanges)
    spark.readStream.format("lodestore_folder").option("path", ...).option("state", ...).load()

A trigger lists the folder; if the listing differs from the last one it is written under
the next number. A batch is the difference of two listings, read in partitions of their
paths. A restarted query goes on from the number in its checkpoint, whose listing is still
there, so it neither loses nor repeats a change; what happened while nobody looked shows as
one change per path.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..sources.folder import PRUNED

CHANGES = "path string, change string, length long, modified_ms long, version long"
LISTED = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified_ms", pa.int64()), ("bucket", pa.int16())])
#: Listings are sorted by hash buckets of the path, of which a partition reads some.
BUCKETS = 256
#: Paths of a partition, about.
PARTITION_PATHS = 50_000


class FolderChanges(DataSource):
    """Options: path, the folder; state, a folder for listings that outlives the query. Any file system that Arrow reaches."""

    @classmethod
    def name(cls) -> str:
        return "lodestore_folder"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FolderReader(self.options["path"], self.options["state"])


@dataclass
class Buckets(InputPartition):
    start: int
    end: int
    first: int
    last: int


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def listing(uri: str) -> pa.Table:
    """The files under a folder but those in hidden and pruned folders, by bucket and path."""
    system, base = opened(uri)
    found = system.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
    rows = []
    for x in found:
        if x.type == pafs.FileType.File:
            path = x.path[len(base) :].lstrip("/")
            if not any(p.startswith(".") or p in PRUNED for p in path.split("/")[:-1]):
                rows.append((path, x.size, (x.mtime_ns or 0) // 1_000_000, crc32(path.encode()) % BUCKETS))
    rows.sort(key=lambda r: (r[3], r[0]))
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(LISTED)], schema=LISTED)


def difference(before: pa.Table, now: pa.Table) -> list[tuple[str, str, int | None, int | None]]:
    """(path, change, length, modified_ms): created, modified or deleted between two listings, by path."""
    was = {r["path"]: r for r in before.to_pylist()}
    out = []
    for r in now.to_pylist():
        old = was.pop(r["path"], None)
        if old is None or (old["length"], old["modified_ms"]) != (r["length"], r["modified_ms"]):
            out.append((r["path"], "created" if old is None else "modified", r["length"], r["modified_ms"]))
    return sorted([*out, *((p, "deleted", None, None) for p in was)])


class FolderReader(DataSourceStreamReader):
    def __init__(self, path: str, state: str):
        self.path, self.state = path, state

    def _place(self, version: int) -> str:
        return f"{opened(self.state)[1].rstrip('/')}/listing-{version:012d}.parquet"

    def _versions(self) -> list[int]:
        system, base = opened(self.state)
        names = [x.base_name for x in system.get_file_info(pafs.FileSelector(base, allow_not_found=True))]
        return sorted(int(n[8:20]) for n in names if n.startswith("listing-"))

    def _listing(self, version: int, first: int = 0, last: int = BUCKETS) -> pa.Table:
        if not version:
            return LISTED.empty_table()
        return pq.read_table(self._place(version), filesystem=opened(self.state)[0], filters=(pc.field("bucket") >= first) & (pc.field("bucket") < last))

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        system, base = opened(self.state)
        version = max(self._versions(), default=0)
        now = listing(self.path)
        if now.equals(self._listing(version).cast(LISTED)):
            return {"version": version}
        system.create_dir(base, recursive=True)
        side = f"{base.rstrip('/')}/.listing"
        pq.write_table(now, side, filesystem=system, row_group_size=PARTITION_PATHS)
        system.move(side, self._place(version + 1))
        return {"version": version + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start["version"] == end["version"]:
            return []
        system = opened(self.state)[0]
        paths = sum(pq.read_metadata(self._place(v), filesystem=system).num_rows for v in (start["version"], end["version"]) if v)
        count = max(1, min(BUCKETS, paths // PARTITION_PATHS))
        edges = [BUCKETS * i // count for i in range(count + 1)]
        return [Buckets(start["version"], end["version"], a, b) for a, b in zip(edges, edges[1:], strict=False)]

    def read(self, partition: Buckets) -> Iterator[tuple]:
        before, now = (self._listing(v, partition.first, partition.last) for v in (partition.start, partition.end))
        for path, change, length, modified in difference(before, now):
            yield path, change, length, modified, partition.end

    def commit(self, end: dict) -> None:
        for v in self._versions():
            if v < end["version"]:
                opened(self.state)[0].delete_file(self._place(v))
