"""One object for a store's operations, its settings, and batches of operations."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, memories
from .operators.filters import visible
from .operators.fusion import INTENT_WEIGHTS
from .plans import index, search, watching
from .plans.store import Store

MODES = ("hybrid", "embed")
MAX_BATCH, MAX_SEARCHES = 20, 20


@runtime_checkable
class Storage(Protocol):
    """What an engine asks of a store; Store is the one here."""

    def table(self, name: str, parts: list[str] | None = None) -> DataFrame: ...
    def version(self) -> int: ...
    def fold(self, *, every: bool = False) -> int: ...
    def compact(self) -> int: ...
    def manifest(self) -> dict: ...
    def upsert(self, tables: dict[str, DataFrame]) -> int: ...
    def upsert_memory(self, texts: DataFrame, *, now_ms: int, embed=None, model: str = "none") -> int: ...
    def get_memory(self, memory_id: str | None = None, *, path: str | None = None, **scope: str | None) -> DataFrame: ...
    def delete_memory(self, memory_id: str, **scope: str | None) -> int: ...
    def delete_path(self, path: str, collection: str, *, children: bool = True, **namespaces: str | None) -> int: ...
    def delete_paths(self, paths: DataFrame, collection: str) -> int: ...
    def rename_collection(self, old: str, new: str) -> int: ...
    def delete_collection(self, name: str) -> int: ...


@dataclass(frozen=True)
class Config:
    """Settings of an engine. Values out of range are refused; model and root cannot change later."""

    root: str
    model: str = "none"
    mode: str = "hybrid"
    limit: int = 10
    rerank_top_k: int = 20
    expand: bool = False
    media_rerank: bool = False

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if not 1 <= self.limit <= 100:
            raise ValueError("limit must be 1 to 100")
        if not 0 <= self.rerank_top_k <= 200:
            raise ValueError("rerank_top_k must be 0 to 200")

    def changed(self, **settings: Any) -> Config:
        if fixed := {"root", "model"} & set(settings):
            raise ValueError(f"{sorted(fixed)} cannot change")
        if unknown := set(settings) - {f.name for f in fields(self)}:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        return replace(self, **settings)


class Engine:
    """Search, write and list memories of one store. embed maps a text column to a vector column; without it search is lexical."""

    def __init__(self, spark: SparkSession, config: Config, *, embed=None, now_ms: Callable[[], int] = lambda: int(time.time() * 1000), store: Storage | None = None):
        self.spark, self.config, self.embed, self.now_ms = spark, config, embed, now_ms
        self.store: Storage = Store(spark, config.root) if store is None else store

    def _queries(self, queries: list[dict]) -> DataFrame:
        if not 1 <= len(queries) <= MAX_SEARCHES:
            raise ValueError(f"1 to {MAX_SEARCHES} queries")
        for q in queries:
            if q.get("intent") not in (None, *INTENT_WEIGHTS) or q.get("mode") not in (None, "hybrid", "vec", "fts"):
                raise ValueError(f"unknown intent or mode of {q['query']!r}")
        rows = [(i, q["query"], float(q.get("weight", 1.0)), q.get("intent"), q.get("mode")) for i, q in enumerate(queries)]
        df = self.spark.createDataFrame(rows, "query_id int, query string, weight double, intent string, mode string")
        return df.withColumn("vector", self.embed(F.col("query")) if self.embed else F.lit(None).cast("array<float>"))

    def _options(self, scope: dict) -> dict:
        c = self.config
        kind = scope.pop("content_type", None)
        return {"as_of_ms": self.now_ms(), "limit": c.limit, "rerank_top_k": c.rerank_top_k, "enabled": c.mode == "hybrid", "media_enabled": c.media_rerank, "scope": scope, "content_type": kind}

    def search(self, query: str, **scope: str | None) -> DataFrame:
        queries = self._queries([{"query": query}])
        variants = None
        if self.config.expand:
            variants = search.expanded(queries.select("query_id", "query")).where("variant > 0")
            variants = variants.withColumn("vector", self.embed(F.col("query"))) if self.embed else variants
        found = index.of_store(self.store)
        return search.hybrid(found.chunks, queries, variants=variants, posted=found.postings, **self._options(scope))

    def explain(self, query: str, **scope: str | None) -> DataFrame:
        found = index.of_store(self.store)
        return search.explain(found.chunks, self._queries([{"query": query}]), posted=found.postings, **self._options(scope))

    def search_batch(self, queries: list[dict], **scope: str | None) -> DataFrame:
        found = index.of_store(self.store)
        return search.search_batch(found.chunks, self._queries(queries), posted=found.postings, **self._options(scope))

    def add(self, texts: DataFrame) -> int:
        """Write texts in the place of what their paths held; layers that have piled up are folded. Returns the version that shows them."""
        version = self.store.upsert_memory(texts, now_ms=self.now_ms(), embed=self.embed, model=self.config.model)
        self.store.fold()
        return version

    def compact(self) -> int:
        """Fold the store, and delete folders of it and segments of its index that the newest version does not name; returns how many folders went."""
        return self.store.compact() + index.sweep(self.store)

    def get(self, memory_id: str | None = None, **where: str | None) -> DataFrame:
        return self.store.get_memory(memory_id, **where)

    def delete(self, memory_id: str, **scope: str | None) -> int:
        return self.store.delete_memory(memory_id, **scope)

    def delete_path(self, path: str, collection: str, **options) -> int:
        return self.store.delete_path(path, collection, **options)

    def memories(self, limit: int = 50) -> DataFrame:
        return memories.list_memories(self.store.table("documents"), limit)

    def collections(self) -> DataFrame:
        return memories.list_collections(self.store.table("documents"))

    def namespaces(self) -> DataFrame:
        return memories.list_namespaces(self.store.table("documents"))

    def entities(self, limit: int = 100) -> DataFrame:
        return graph.list_entities(self._mentions().withColumn("ord", F.col("seq")), limit)

    def related(self, memory_id: str, limit: int = 20) -> DataFrame:
        found = self._mentions()
        return graph.related_memories(found, found.where(F.col("memory_id") == memory_id).select("memory_id"), limit)

    def _mentions(self) -> DataFrame:
        return self.store.table("entities").where(visible()).withColumn("path", F.coalesce("memory_root_path", "file_path"))

    def rename_collection(self, old: str, new: str) -> int:
        return self.store.rename_collection(old, new)

    def delete_collection(self, name: str) -> int:
        return self.store.delete_collection(name)

    def scan_folder(self, folder: str, collection: str, **listing) -> dict[str, int]:
        return watching.scan(self.store, folder, collection, now_ms=self.now_ms(), embed=self.embed, **listing)

    def status(self) -> dict:
        return {"version": self.store.version(), "chunks": self.store.table("embeddings").where(visible()).count(), "model": self.config.model, "mode": self.config.mode}

    #: Operations that batch() may call.
    OPERATIONS = ("search", "explain", "search_batch", "get", "delete", "delete_path", "memories", "collections", "namespaces", "entities", "related", "rename_collection", "delete_collection", "status")

    def batch(self, operations: list[dict]) -> list[dict]:
        """Run up to 20 operations ({"op": name, ...arguments}) in order; a failing one gives its error and does not stop the rest. Batches do not nest."""
        if not 1 <= len(operations) <= MAX_BATCH:
            raise ValueError(f"1 to {MAX_BATCH} operations")
        out = []
        for given in operations:
            arguments = dict(given)
            name = arguments.pop("op", None)
            try:
                if name not in self.OPERATIONS:
                    raise ValueError(f"unknown operation {name!r}")
                got = getattr(self, name)(**arguments)
                out.append({"op": name, "result": [r.asDict(recursive=True) for r in got.collect()] if isinstance(got, DataFrame) else got})
            except Exception as e:  # noqa: BLE001  the error is the operation's result
                out.append({"op": name, "error": f"{type(e).__name__}: {e}"})
        return out
