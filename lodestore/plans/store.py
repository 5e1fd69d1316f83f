"""Store of immutable Parquet layers behind numbered manifests.

A table is kept in parts: one per collection, content by the first digit of its hash. A
part is a list of layers, folders of rows, and of delete vectors, folders that name rows
of the layers by file and place. A write adds a layer with its rows and a delete vector
with what they replace, so it writes about as much as it changes; readers leave out what
the vectors name. fold() rewrites parts in which layers have piled up.

A version is a manifest of all parts. Its writer makes the next one, which only one can:
who comes late puts the write on top of the new version if that changed other parts, else
the write is made again from it. Readers see one version, never a mix. Files and renames
go through Hadoop's FileSystem, so the store can be on any file system that Spark reaches
and that moves a folder in one step.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import reduce
from math import log
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from ..operators import filters, memories
from ..operators.evaluate import selected
from ..schema import TABLES, checked_name, conform

KEYS = {"embeddings": ["collection", "user_id", "session_id", "project_id", "profile", "file_path", "hash_seq"], "content": ["hash"], "cache": ["key"]}
KEYS["documents"] = ["collection", "user_id", "session_id", "project_id", "profile", "file_path"]
KEYS["entities"] = KEYS["relations"] = ["id"]
#: Tables whose rows belong to a collection.
OWNED = ("embeddings", "documents", "entities", "relations")
VECTOR = "file string, row long"
#: Delete vectors of a table that are broadcast to its rows, in Parquet; larger ones are joined by shuffle.
MAX_VECTOR_BYTES = 4 << 20
MAX_RETRIES = 20
#: Layers count as equally large within a factor of TIER, and below LEAST_LAYER bytes.
TIER, LEAST_LAYER = 4, 64 << 10
MAX_TIER, MAX_GONE = 8, 16


def part_of(name: str) -> Column:
    """The part of a table that a row is kept in."""
    if name in OWNED:
        return F.col("collection")
    return F.substring("hash", 1, 1) if name == "content" else F.lit("all")


class Conflict(Exception):
    """Another writer has changed what a write was made from."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._hadoop)
        #: Versions that were published, and writes made again after a conflict, by this object.
        self.published, self.retried = 0, 0

    # -- manifest ---------------------------------------------------------

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[1:]) for n in names if n.startswith("v"))

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or that of a version: tables by name, their parts with layers and gone, both lists of folders with their bytes."""
        if version is None:
            version = max(self._versions(), default=0)
        if not version:
            return {"version": 0, "tables": {}}
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version:012d}/manifest.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def version(self) -> int:
        return max(self._versions(), default=0)

    def _published(self, new: dict) -> bool:
        """Make a manifest the next version, unless there is one: a folder is moved to its name, which fails where that name is taken."""
        writer, target = uuid4().hex, f"{self.root}/manifests/v{new['version']:012d}"
        side = self._path(f"{self.root}/manifests/.{writer}")
        out = self._fs.create(self._path(f"{side}/manifest.json"))
        out.write(bytearray(json.dumps(new | {"writer": writer}).encode()))
        out.close()
        try:
            if not self._fs.exists(self._path(target)):
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._hadoop)
                context.rename(side, self._path(target), self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError:
            pass  # the manifest tells who was first
        finally:
            self._fs.delete(side, True)
        won = self.manifest(new["version"]).get("writer") == writer
        self.published += won
        return won

    # -- tables -----------------------------------------------------------

    def _rows(self, name: str, layers: list[str], gone: list[dict]) -> DataFrame:
        """Rows of layers but those that delete vectors name, with _file and _row, their place."""
        if not layers:
            return self.spark.createDataFrame([], TABLES[name]).withColumns({"_file": F.lit(""), "_row": F.lit(0).cast("long")})
        found = self.spark.read.schema(TABLES[name]).parquet(*[f"{self.root}/{p}" for p in layers])
        own = [F.col(f.name) for f in TABLES[name].fields]
        found = found.select(*own, F.substring_index("_metadata.file_path", "/", -3).alias("_file"), F.col("_metadata.row_index").alias("_row"))
        if gone:
            vectors = self.spark.read.schema(VECTOR).parquet(*[f"{self.root}/{g['place']}" for g in gone]).select(F.col("file").alias("_file"), F.col("row").alias("_row"))
            few = sum(g["bytes"] for g in gone) <= MAX_VECTOR_BYTES
            found = found.join(F.broadcast(vectors) if few else vectors, ["_file", "_row"], "left_anti")
        return found

    def located(self, name: str, parts: Iterable[str] | None = None, manifest: dict | None = None) -> DataFrame:
        """A table, or the named parts of it, with the place of every row: _file and _row."""
        kept = (manifest or self.manifest())["tables"].get(name, {})
        wanted = None if parts is None else set(parts)
        held = [x for part, x in sorted(kept.items()) if wanted is None or part in wanted]
        layers = lambda of: sorted(y["place"] for x in of for y in x["layers"])
        whole, cut = [x for x in held if not x["gone"]], [x for x in held if x["gone"]]
        if not cut or not whole:
            return self._rows(name, layers(held), [g for x in cut for g in x["gone"]])
        return self._rows(name, layers(whole), []).unionByName(self._rows(name, layers(cut), [g for x in cut for g in x["gone"]]))

    def table(self, name: str, parts: Iterable[str] | None = None, *, version: int | None = None) -> DataFrame:
        """A table, or the named parts of it, as of a version that is still kept."""
        out = conform(self.located(name, parts, self.manifest(version)), name)
        return out.withColumns(_own_keys()) if name == "embeddings" else out

    def _written(self, df: DataFrame, folder: str, *by: str) -> dict[tuple[str, ...], dict]:
        """df under a folder, a subfolder for each value of the columns `by`; its folders and their bytes by those values."""
        df.write.partitionBy(*by).parquet(f"{self.root}/{folder}")
        unescaped = self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        found: dict[tuple[str, ...], str] = {(): folder}
        for column in by:
            found = {
                (*key, unescaped(name.partition("=")[2])): f"{place}/{name}"
                for key, place in found.items()
                for x in self._fs.listStatus(self._path(f"{self.root}/{place}"))
                if x.isDirectory() and (name := x.getPath().getName()).startswith(f"{column}=")
            }
        return {key: {"place": place, "bytes": self._fs.getContentSummary(self._path(f"{self.root}/{place}")).getLength()} for key, place in found.items()}

    @contextmanager
    def aside(self, *frames: DataFrame) -> Iterator[list[DataFrame]]:
        """DataFrames written once beside the store's tables, for as long as the block lasts."""
        folder = f"{self.root}/aside/{uuid4().hex}"
        try:
            for i, df in enumerate(frames):
                df.write.parquet(f"{folder}/{i}")
            yield [self.spark.read.schema(df.schema).parquet(f"{folder}/{i}") for i, df in enumerate(frames)]
        finally:
            self._fs.delete(self._path(folder), True)

    def stage(self, tables: dict[str, DataFrame], touched: dict[str, list[str]] | None = None, gone: dict[str, DataFrame] | None = None, reads: dict[str, list[str]] | None = None, base: dict | None = None) -> dict:
        """Write hidden rows of tables; promote() shows them, abort() drops them.

        Without touched the rows replace their table, with it the named parts of it; rows
        of other parts join theirs. gone: per table the rows that leave, with _file and
        _row. reads: parts that the write was made from. base: the manifest it was made from.
        """
        base = base or self.manifest()
        staged: dict = {"base": base, "tables": {}, "gone": {}, "folders": [], "reads": reads or {}}
        for name, df in tables.items():
            mark = uuid4().hex
            folder = f"tables/{name}/{mark}"
            staged["folders"].append(folder)
            rows = conform(df, name)
            if name == "embeddings":  # rows of another write have other keys, so stored postings never meet them
                rows = rows.withColumn("file_key", _file_key()).withColumns({"chunk_id": identity.file_key(F.col("file_key"), F.col("hash_seq"), F.lit(mark)), "chars": F.length("text_body")})
            parts = self._written(rows.withColumn("_part", part_of(name)), folder, "_part")
            staged["tables"][name] = {"parts": {k[0]: v for k, v in parts.items()}, "touched": None if touched is None else touched.get(name)}
        if gone:
            folder = f"gone/{uuid4().hex}"
            staged["folders"].append(folder)
            rows = [df.select(F.lit(n).alias("_table"), part_of(n).alias("_part"), F.col("_file").alias("file"), F.col("_row").alias("row")) for n, df in gone.items()]
            for (name, part), place in self._written(reduce(DataFrame.unionByName, rows), folder, "_table", "_part").items():
                staged["gone"].setdefault(name, {})[part] = place
        return staged

    def promote(self, staged: dict) -> int:
        """Publish what was staged as the next version.

        Other writers may have published meanwhile: if they changed other parts, this
        write goes on top of theirs; if they changed a part that it was made from or
        changes itself, it fails with Conflict and nothing is shown.
        """
        base = staged["base"]["tables"]
        while True:
            now = self.manifest()
            tables = {n: dict(parts) for n, parts in now["tables"].items()}
            for name in {*staged["tables"], *staged["gone"], *staged["reads"]}:
                x = staged["tables"].get(name, {"parts": {}, "touched": []})
                was, own = base.get(name, {}), tables.setdefault(name, {})
                whole = x["touched"] is None
                mine = {*own, *was} if whole else {*x["touched"], *x["parts"], *staged["gone"].get(name, {}), *staged["reads"].get(name, [])}
                if now["version"] != staged["base"]["version"] and any(own.get(p) != was.get(p) for p in mine):
                    raise Conflict(f"{name} has changed since version {staged['base']['version']}")
                for p in list(own) if whole else x["touched"]:
                    own.pop(p, None)
                for p, place in x["parts"].items():
                    held = own.get(p, {"layers": [], "gone": []})
                    own[p] = held | {"layers": [*held["layers"], place]}
                for p, place in staged["gone"].get(name, {}).items():
                    own[p] = own[p] | {"gone": [*own[p]["gone"], place]}
            new = {"version": now["version"] + 1, "tables": tables}
            if self._published(new):
                return new["version"]

    def abort(self, staged: dict) -> None:
        for folder in staged["folders"]:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)

    def commit(self, tables: dict[str, DataFrame], touched: dict[str, list[str]] | None = None, **more) -> int:
        staged = self.stage(tables, touched, **more)
        try:
            return self.promote(staged)
        except Exception:
            self.abort(staged)
            raise

    def _change(self, make: Callable[[dict], dict | None]) -> int:
        """A write as a function of the manifest that it is made from (to the arguments of stage()): made again where another writer was in its way."""
        for _ in range(MAX_RETRIES):
            base = self.manifest()
            change = make(base)
            if change is None:
                return base["version"]
            try:
                return self.commit(**change, base=base)
            except Conflict:
                self.retried += 1
        raise Conflict(f"other writers were faster {MAX_RETRIES} times")

    @staticmethod
    def parts(name: str, rows: DataFrame) -> list[str]:
        """The parts that rows belong to."""
        return sorted(r[0] for r in rows.select(part_of(name).alias("p")).where("p is not null").distinct().collect())

    # -- writes -----------------------------------------------------------

    @staticmethod
    def matching(rows: DataFrame, keys_of: DataFrame, keys: list[str]) -> DataFrame:
        """The rows whose keys some row of keys_of has; nulls are equal to each other."""
        other = keys_of.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
        return rows.join(other, same, "left_semi")

    @staticmethod
    def without(rows: DataFrame, keys_of: DataFrame, keys: list[str]) -> DataFrame:
        """The rows whose keys no row of keys_of has; nulls are equal to each other."""
        other = keys_of.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
        return rows.join(other, same, "left_anti")

    def _new_content(self, content: DataFrame, parts: list[str], base: dict) -> DataFrame:
        """The hashes that the content table lacks."""
        return content.dropDuplicates(["hash"]).join(self.located("content", parts, base).select("hash"), "hash", "left_anti")

    def upsert(self, tables: dict[str, DataFrame]) -> int:
        """Insert or replace rows by key, all tables in one version. Documents keep id and created_at; content keeps what it has. Of rows with one key in the same call one stays."""

        def make(base: dict) -> dict:
            out, reads, gone = {}, {}, {}
            for name, df in tables.items():
                new = conform(df, name).dropDuplicates(KEYS[name])
                reads[name] = self.parts(name, new)
                if name == "content":
                    out[name] = self._new_content(new, reads[name], base)
                    continue
                old = self.located(name, reads[name], base)
                gone[name] = self.matching(old, new, KEYS[name])
                out[name] = kept_identity(old, new) if name == "documents" else new
            return {"tables": out, "touched": {n: [] for n in out}, "gone": gone, "reads": reads}

        return self._change(make)

    def replace_family(self, path: str, collection: str, tables: dict[str, DataFrame]) -> int:
        """Put new rows in the place of a path and its children, in one version."""
        checked_name(collection, "collection")
        mine = F.coalesce((F.col("collection") == collection) & filters.in_family(path), F.lit(False))

        def make(base: dict) -> dict:
            new = {n: conform(df, n).dropDuplicates(KEYS[n]) for n, df in tables.items()}
            reads = {n: sorted({collection, *self.parts(n, df)}) for n, df in new.items()}
            return {"tables": new, "touched": {n: [] for n in new}, "gone": {n: self.located(n, [collection], base).where(mine) for n in new}, "reads": reads}

        return self._change(make)

    def delete_path(self, path: str, collection: str, *, children: bool = True, **namespaces: str | None) -> int:
        """Drop chunks and graph rows of a path and hide its documents; returns the number of chunks dropped."""
        family = filters.in_family(path) if children else F.col("file_path") == path
        mine = F.coalesce(family & filters.within(collection=collection, **namespaces), F.lit(False))
        return self._drop(lambda rows: rows.where(mine), [collection])

    def upsert_memory(self, texts: DataFrame, *, now_ms: int, embed=None, model: str = "none", families: DataFrame | None = None, collection: str | None = None) -> int:
        """Put texts (see ingest.memory_rows) in the place of what their paths held: chunks, mentions and edges are replaced, documents keep id and created_at.

        One version shows all of it. What is written grows with the texts, not with their
        collections: replaced rows leave by delete vectors. Paths count within their
        collection and namespaces; a path that occurs twice in texts gets the chunks of both.
        families (path): what these paths of a collection and their children held leaves too,
        and documents of them that texts do not write again are hidden.
        """
        from .ingest import memory_rows

        new = {n: conform(df, n).dropDuplicates(KEYS[n]) for n, df in memory_rows(texts, now_ms=now_ms, embed=embed, model=model).items()}
        paths = KEYS["documents"]

        def make(base: dict) -> dict:
            mine = sorted({*self.parts("documents", new["documents"]), *([collection] if families is not None else [])})
            replaced = new["documents"].select(paths).distinct()
            reads = dict.fromkeys(OWNED, mine) | {"content": self.parts("content", new["content"])}
            old = {n: self.matching(self.located(n, mine, base), replaced, paths) for n in OWNED}
            documents = kept_identity(old["documents"], new["documents"])
            if families is not None:
                held = {n: in_families(self.located(n, [collection], base), families) for n in OWNED}
                hidden = self.without(held["documents"].where(filters.visible()), replaced, paths)
                documents = documents.unionByName(conform(hidden.withColumn("active", F.lit(0)), "documents"))
                old = {n: df.unionByName(hidden if n == "documents" else held[n]) for n, df in old.items()}
            out = new | {"documents": documents, "content": self._new_content(new["content"], reads["content"], base)}
            return {"tables": out, "touched": {n: [] for n in out}, "gone": old, "reads": reads}

        return self._change(make)

    def _drop(self, chosen: Callable[[DataFrame], DataFrame], parts: list[str]) -> int:
        """Drop the chosen chunks and graph rows by delete vectors and hide the chosen documents; returns the number of chunks."""
        n = 0

        def make(base: dict) -> dict | None:
            nonlocal n
            hit = {t: chosen(self.located(t, parts, base)) for t in OWNED}
            hit["documents"] = hit["documents"].where(filters.visible())
            n = hit["embeddings"].count()
            if not n and all(df.isEmpty() for df in hit.values()):
                return None
            hidden = hit["documents"].withColumn("active", F.lit(0).cast("byte"))
            return {"tables": {"documents": hidden}, "touched": {"documents": []}, "gone": hit, "reads": dict.fromkeys(OWNED, parts)}

        self._change(make)
        return n

    def delete_memory(self, memory_id: str, **scope: str | None) -> int:
        """Drop the chunks and graph rows of a memory, root and children, and hide its documents; returns the number of chunks dropped."""
        mine = F.coalesce((F.col("memory_id") == checked_name(memory_id, "memory_id")) & filters.within(**scope), F.lit(False))
        parts = sorted({p for n in ("embeddings", "documents") for p in self.parts(n, self.table(n).where(mine))})
        return self._drop(lambda rows: rows.where(mine), parts) if parts else 0

    def delete_paths(self, paths: DataFrame, collection: str) -> int:
        """The same for a table of paths (path) and their children, all in one version."""
        return self._drop(lambda rows: in_families(rows, paths), [checked_name(collection, "collection")])

    def get_memory(self, memory_id: str | None = None, *, path: str | None = None, **scope: str | None) -> DataFrame:
        """The memory of an id or root path with its children, snippets, summary and tags; no row if there is none."""
        parts = [scope["collection"]] if scope.get("collection") else None
        rows = self.table("embeddings", parts)
        found = memories.memory_view(self.table("documents", parts), rows, memory_id=memory_id, path=path, **scope)
        own = F.coalesce(F.col("memory_id") == memory_id if memory_id else F.col("memory_root_path") == F.lit(path), F.lit(False))
        return found.join(memories.summaries(rows.where(filters.visible() & own)).select("memory_id", "summary", "tags"), "memory_id", "left")

    def remember(self, rows: DataFrame, *, now_ms: int, most: int) -> int:
        """Put rows (key, value, created_at) into the cache as used now, and drop in the same version what was used longest ago beyond `most` rows.

        Rows of the call itself stay even if they are more. Of rows last used at the same time
        those whose key has the smaller SHA-256 leave first. Where to cut is found by counts
        over partitions, so nothing is sorted whole.
        """
        used = F.coalesce("used_at", "created_at").cast("double")
        tie = F.conv(F.substring(F.sha2("key", 256), 1, 13), 16, 10).cast("double")  # 52 bits: exact as a double

        def make(base: dict) -> dict:
            new = conform(rows.withColumn("used_at", F.lit(now_ms)), "cache").dropDuplicates(["key"])
            old = self.located("cache", None, base)
            gone, rest = self.matching(old, new, ["key"]), self.without(old, new, ["key"]).withColumns({"_used": used, "_tie": tie})
            held = rest.count()
            over = min(held, held + new.count() - most)
            if over > 0:
                (last,) = selected(rest, "_used", [over - 1])
                earlier = rest.where(F.col("_used") < last).count()
                (end,) = selected(rest.where(F.col("_used") == last), "_tie", [over - earlier - 1])
                leaves = (F.col("_used") < last) | ((F.col("_used") == last) & (F.col("_tie") <= end))
                gone = gone.unionByName(rest.where(leaves).drop("_used", "_tie"))
            return {"tables": {"cache": new}, "touched": {"cache": []}, "gone": {"cache": gone}, "reads": {"cache": self.parts("cache", new)}}

        return self._change(make)

    def cached(self, keys: DataFrame) -> DataFrame:
        """keys (key) with the cached value, null for those that the cache does not hold."""
        return keys.join(self.table("cache").select("key", "value"), "key", "left")

    def rename_collection(self, old: str, new: str) -> int:
        """Move a collection to a new name; refuses an existing one. Memory ids stay as they are."""
        checked_name(new, "new_name")
        if old == new:
            return self.version()

        def make(base: dict) -> dict:
            if any(not self.located(n, [new], base).isEmpty() for n in OWNED):
                raise ValueError(f"collection {new!r} exists")
            return {"tables": {n: self.located(n, [old], base).withColumn("collection", F.lit(new)) for n in OWNED}, "touched": dict.fromkeys(OWNED, [old, new])}

        return self._change(make)

    def delete_collection(self, name: str) -> int:
        """Drop a collection and the content that nothing refers to any more."""
        checked_name(name)

        def make(base: dict) -> dict:
            held = base["tables"]
            rest = {n: [p for p in held.get(n, {}) if p != name] for n in OWNED}
            lost = orphans(self.located("content", None, base), *[self.located(n, rest[n], base) for n in ("embeddings", "documents")])
            reads = {n: list(held.get(n, {})) for n in (*OWNED, "content")}
            return {"tables": {n: self.spark.createDataFrame([], TABLES[n]) for n in OWNED}, "touched": dict.fromkeys(OWNED, [name]), "gone": {"content": lost}, "reads": reads}

        return self._change(make)

    # -- upkeep -----------------------------------------------------------

    def fold(self, *, every: bool = False) -> int:
        """Rewrite parts whose layers have piled up, and fold their delete vectors in; returns how many were rewritten.

        A part is due when MAX_TIER of its layers are about equally large (within a factor
        of TIER) or it has MAX_GONE delete vectors, so a row is rewritten about once per
        tier that it climbs. every: all parts of more than one layer or with delete vectors.
        """
        n = 0

        def due(x: dict) -> bool:
            tiers = Counter(int(log(max(y["bytes"], LEAST_LAYER), TIER)) for y in x["layers"])
            return len(x["gone"]) + len(x["layers"]) > 1 if every else max(tiers.values(), default=0) >= MAX_TIER or len(x["gone"]) >= MAX_GONE

        def make(base: dict) -> dict | None:
            nonlocal n
            touched = {name: parts for name, held in base["tables"].items() if (parts := [p for p, x in held.items() if due(x)])}
            n = sum(map(len, touched.values()))
            return {"tables": {name: self.located(name, parts, base) for name, parts in touched.items()}, "touched": touched} if touched else None

        self._change(make)
        return n

    def compact(self) -> int:
        """Fold all parts, then delete older versions and the folders that the newest does not name; returns how many folders went. Not beside other writers."""
        self.fold(every=True)
        now = self.manifest()
        named = {y["place"] for parts in now["tables"].values() for x in parts.values() for y in (*x["layers"], *x["gone"])}
        n = 0

        def swept(folder: str) -> bool:
            """Delete what is not named below a folder; whether anything is left."""
            nonlocal n
            place = self._path(f"{self.root}/{folder}")
            if not any(p.startswith(f"{folder}/") for p in named):
                n += self._fs.delete(place, True)
                return False
            for x in self._fs.listStatus(place):
                below = f"{folder}/{x.getPath().getName()}"
                if x.isDirectory() and below not in named:
                    swept(below)
            return True

        for folder in [f"tables/{name}" for name in TABLES] + ["gone"]:
            place = self._path(f"{self.root}/{folder}")
            for x in self._fs.listStatus(place) if self._fs.exists(place) else []:
                swept(f"{folder}/{x.getPath().getName()}")
        for v in self._versions()[:-1]:
            self._fs.delete(self._path(f"{self.root}/manifests/v{v:012d}"), True)
        return n


def in_families(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """The rows of paths (path) and of their children."""
    keys = paths.select(F.col("path").alias("_path")).where("_path is not null").distinct()
    owners = F.array_compact(F.array("file_path", F.substring_index("file_path", "::", 1), "memory_root_path"))
    hit = rows.select(F.col("file_path").alias("_hit"), F.explode(owners).alias("_path")).join(keys, "_path", "left_semi").select("_hit").distinct()
    return rows.join(hit, F.col("file_path") == F.col("_hit"), "left_semi")


def _file_key() -> Column:
    return identity.file_key(*[F.col(c) for c in KEYS["documents"]])


def _own_keys() -> dict[str, Column]:
    """Keys and length of rows that an earlier layout wrote without them."""
    key = F.coalesce("file_key", _file_key())
    return {"file_key": key, "chunk_id": F.coalesce("chunk_id", identity.file_key(key, F.col("hash_seq"))), "chars": F.coalesce("chars", F.length("text_body"))}


def kept_identity(old: DataFrame, new: DataFrame) -> DataFrame:
    """new documents with the id and created_at of the old rows they replace."""
    keys = KEYS["documents"]
    was = old.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("id").alias("_id"), F.col("created_at").alias("_at"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = new.join(was, same, "left").withColumns({"id": F.coalesce("_id", "id"), "created_at": F.coalesce("_at", "created_at")})
    return out.select(*new.columns)


def references(embeddings: DataFrame, documents: DataFrame) -> DataFrame:
    return embeddings.select(F.col("content_hash").alias("hash")).unionByName(documents.select(F.col("content_hash").alias("hash"))).distinct()


def orphans(content: DataFrame, embeddings: DataFrame, documents: DataFrame) -> DataFrame:
    """Content that no chunk or document refers to."""
    return content.join(references(embeddings, documents), "hash", "left_anti")


def promoted(rows: DataFrame, batch: str, path: str) -> DataFrame:
    """rows with a staged batch shown and what the path's family showed before hidden."""
    own = F.coalesce(filters.in_batch(batch), F.lit(False))
    family = F.coalesce(filters.in_family(path), F.lit(False))
    return rows.withColumn("active", F.when(own, 1).when(family, 0).otherwise(F.col("active")).cast("byte"))


def aborted(rows: DataFrame, batch: str) -> DataFrame:
    return rows.where(filters.in_batch(batch, other=True))
