"""python -m lodestore STORE COMMAND: a store from the command line; results are JSON lines."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .engine import Config, Engine


def arguments(given: list[str]) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="lodestore", description=__doc__)
    top.add_argument("store", help="folder of the store, on any file system that Spark reaches")
    commands = top.add_subparsers(dest="command", required=True)
    find = commands.add_parser("search", help="memories for a query")
    find.add_argument("query")
    find.add_argument("--collection")
    find.add_argument("--limit", type=int, default=10)
    find.add_argument("--expand", action="store_true", help="search by other wordings too")
    scan = commands.add_parser("scan", help="apply what changed in a folder since its last scan")
    scan.add_argument("folder")
    scan.add_argument("collection")
    scan.add_argument("--include", nargs="*")
    scan.add_argument("--exclude", nargs="*")
    show = commands.add_parser("get", help="a memory by its id or root path")
    show.add_argument("--id", dest="memory_id")
    show.add_argument("--path")
    drop = commands.add_parser("delete", help="a memory by its id")
    drop.add_argument("memory_id")
    for name, said in (("list", "newest memories"), ("collections", "names of collections"), ("status", "version and number of chunks"), ("compact", "delete versions that nothing refers to")):
        commands.add_parser(name, help=said)
    return top.parse_args(given)


def run(engine: Engine, a: argparse.Namespace) -> DataFrame | dict | int:
    if a.command == "search":
        engine.config = engine.config.changed(limit=a.limit, expand=a.expand)
        return engine.search(a.query, collection=a.collection).select("rank", "path", "title", "score", "sources", "evidence_path").orderBy("rank")
    if a.command == "scan":
        return engine.scan_folder(a.folder, a.collection, include=a.include, exclude=a.exclude)
    if a.command == "get":
        return engine.get(a.memory_id, path=a.path)
    if a.command == "delete":
        return {"chunks": engine.delete(a.memory_id)}
    if a.command == "compact":
        return {"folders": engine.compact()}
    return {"list": engine.memories, "collections": engine.collections, "status": engine.status}[a.command]()


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = arguments(sys.argv[1:] if given is None else given)
    spark = spark or SparkSession.builder.appName("lodestore").getOrCreate()
    got = run(Engine(spark, Config(root=a.store)), a)
    for row in [r.asDict(recursive=True) for r in got.collect()] if isinstance(got, DataFrame) else [got]:
        print(json.dumps(row, default=str, ensure_ascii=False))


if __name__ == "__main__":
    main()
