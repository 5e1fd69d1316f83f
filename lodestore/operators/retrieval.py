"""Lexical and vector branches for any number of queries in one plan."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import identity, vectors
from ..functions.text import words
from ..schema import NAMESPACES
from .filters import policy

#: What is broadcast is measured first: at most so many rows and so many bytes; larger tables are joined by shuffle or in blocks.
MAX_BROADCAST_QUERIES = 10_000
MAX_BROADCAST_BYTES = 32 << 20
DIGITS = 9
#: Queries that are multiplied with the vectors as rows; more are multiplied in blocks.
FEW_QUERIES = 16
#: Stands between path and key of a file; sorts before what paths are made of (pandas ends strings at a zero).
APART = "\x01"
#: Rows of one matrix product.
SLICE = 4096
#: Cells of one matrix product of neighbours, 8 bytes each.
PRODUCT = 1 << 22
#: What a hit's file and chunk are known by. Paths alone are not unique: they repeat over collections and namespaces.
FILE = ["file_key", "file_path"]
CHUNK = [*FILE, "hash_seq"]


def keyed(chunks: DataFrame) -> DataFrame:
    """chunks with file_key (of collection, namespaces and path, where there are such columns) and chunk_id, a key of every chunk."""
    if "file_key" not in chunks.columns:
        chunks = chunks.withColumn("file_key", identity.file_key(*[F.col(c) for c in ("collection", *NAMESPACES, "file_path") if c in chunks.columns]))
    return chunks if "chunk_id" in chunks.columns else chunks.withColumn("chunk_id", identity.file_key(F.col("file_key"), F.col("hash_seq")))


def _row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes in memory."""
    size = F.lit(16)
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            size += F.coalesce(F.octet_length(f.name), F.lit(0)) + 16
        elif isinstance(f.dataType, T.ArrayType):
            size += F.greatest(F.size(f.name), F.lit(0)) * 8 + 16
        else:
            size += 8
    return size


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of df, by one aggregation."""
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(_row_bytes(df).cast("long")), F.lit(0))).first()
    return rows, size


def small(df: DataFrame, rows: int = MAX_BROADCAST_QUERIES, size: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is measured to have at most so many rows and bytes."""
    return F.broadcast(df) if _fits(df, rows, size) else df


def _fits(df: DataFrame, rows: int = MAX_BROADCAST_QUERIES, size: int = MAX_BROADCAST_BYTES) -> bool:
    got = measured(df)
    return got[0] <= rows and got[1] <= size


def length_of(chunks: DataFrame) -> Column:
    """Characters of a chunk: a stored column, if there is one, else counted."""
    return F.col("chars") if "chars" in chunks.columns else F.length("text_body")


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: n chunks and their mean length in characters."""
    return chunks.agg(F.count("*").alias("n"), F.coalesce(F.avg(length_of(chunks)), F.lit(1.0)).alias("avgdl"))


def _counts(lists: pa.Array) -> pa.Array:
    lens = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    named = pc.list_flatten(lists).dictionary_encode()
    size = max(len(named.dictionary), 1)
    keys, tf = np.unique(np.repeat(np.arange(len(lens)), lens) * size + named.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(keys // size, minlength=len(lens)))]).astype(np.int32)
    found = pa.StructArray.from_arrays([named.dictionary.take(pa.array(keys % size)), pa.array(tf.astype(np.int64))], ["term", "tf"])
    return pa.ListArray.from_arrays(pa.array(offsets), found)


def counted(lists: Column) -> Column:
    """The distinct words (term, tf) of every list, none null, with how often they stand there; counted in Arrow batches."""
    return F.arrow_udf(_counts, "array<struct<term:string,tf:bigint>>")(lists)


def repeated(chunks: DataFrame) -> bool:
    """Whether a chunk_id stands in more than one row of chunks, by counts of the ids alone."""
    return not chunks.groupBy("chunk_id").count().where("count > 1").isEmpty()


def postings(chunks: DataFrame, terms: DataFrame | None = None, *, apart: bool | None = None, **carried) -> DataFrame:
    """(term, chunk_id, file_key, file_path, hash_seq, len, tf) and carried columns of the chunk. With terms (term), only those leave their row.

    The words of a row are counted where it is read, so postings enter no exchange. Rows
    that share a chunk_id count as one, with a grouping; apart tells that there are none.
    """
    keys = ["chunk_id", *CHUNK, "len", *carried]
    chunks = keyed(chunks)
    found = F.explode(counted(words(F.col("text_body"))))
    rows = chunks.select("chunk_id", *CHUNK, length_of(chunks).alias("len"), *[c.alias(n) for n, c in carried.items()], found.alias("_x")).select(*keys, "_x.term", "_x.tf")
    if terms is not None:
        rows = rows.join(terms.select("term").distinct(), "term")
    if apart is None:
        apart = not repeated(chunks)
    return rows.select("term", *keys, "tf") if apart else rows.groupBy("term", *keys).agg(F.sum("tf").alias("tf"))


def best_per_file(scored: DataFrame) -> DataFrame:
    """The best chunk of each file and query; ties go to the smaller key."""
    w = Window.partitionBy("query_id", "file_key").orderBy(F.desc("score"), "hash_seq")
    return scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_ranked(scored: DataFrame, limit: int) -> DataFrame:
    """Scores over the best of their query, the first `limit` by score, with rank0."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), *reversed(FILE))
    ranked = scored.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit)  # tasks keep `limit` rows before the exchange
    ranked = ranked.withColumn("rank0", F.col("_n") - 1).drop("_n")
    best = F.max("score").over(Window.partitionBy("query_id"))
    return ranked.withColumn("score", F.when(best > 0, F.col("score") / best).otherwise(F.col("score")))


def bm25(
    chunks: DataFrame, queries: DataFrame, *, as_of_ms: int, limit: int = 20, k1: float = 1.5, b: float = 0.75, posted: DataFrame | None = None
) -> DataFrame:
    """(query_id, file_key, file_path, hash_seq, score, rank0): BM25 with lengths in characters, times policy, best chunk per file.

    queries: query_id, query. Repeated query words count as often as they stand there.
    All chunks given are scored. posted: stored postings (term, chunk_id, len, tf) of a
    table that holds the chunks; no text is read then. Without, chunk words are counted
    and scored in the task that reads them: what is exchanged is a sum per query and chunk.
    """
    terms = queries.select("query_id", F.explode(words(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qn"))
    asked = measured(terms)
    hint = F.broadcast if asked[1] <= MAX_BROADCAST_BYTES else lambda df: df
    known = hint(terms.select("term").distinct())
    own = keyed(chunks).select("chunk_id", *CHUNK, policy(as_of_ms).alias("boost"))
    apart = posted is None and not repeated(own)
    if apart:
        posts = postings(chunks, known, apart=True).select("term", "chunk_id", "len", "tf")
    elif posted is None:
        posts = postings(chunks, known, apart=False, boost=policy(as_of_ms))
    else:
        # A chunk's matching postings are gathered where they are read and travel as one row, whose exchange serves all that follows.
        met = posted.select("term", "chunk_id", "len", "tf").join(known, "term")
        per = met.groupBy("chunk_id").agg(F.collect_list(F.struct("term", "len", "tf")).alias("_x")).join(own, "chunk_id")
        posts = per.select("chunk_id", *CHUNK, "boost", F.explode("_x").alias("_x")).select("_x.*", "chunk_id", *CHUNK, "boost")
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    stats = corpus_stats(chunks)
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    weighed = hint(terms.join(df, "term")).crossJoin(F.broadcast(stats)).select("query_id", "term", F.col("qn"), idf.alias("idf"), "avgdl")
    scored = posts.join(hint(weighed), "term")
    raw = F.round(F.sum(F.col("qn") * F.col("idf") * tf), DIGITS).alias("raw")
    if apart:  # the sums meet their chunk's keys and policy, so text meets neither
        summed = scored.groupBy("query_id", "chunk_id").agg(raw).where("raw > 0").join(own, "chunk_id")
    else:
        summed = scored.groupBy("query_id", "chunk_id", *CHUNK, "boost").agg(raw)
    found = summed.where("raw > 0").select("query_id", *CHUNK, F.round(F.col("raw") * F.col("boost"), DIGITS).alias("score"))
    return top_ranked(best_per_file(found), limit)


def vector_search(chunks: DataFrame, queries: DataFrame, *, as_of_ms: int, limit: int = 20, blocks: bool = False) -> DataFrame:
    """(query_id, file_key, file_path, hash_seq, score, rank0): (1 + cosine) / 2 times policy, best chunk per file.

    queries: query_id, vector. blocks=True, and more queries than a few, multiplies Arrow
    batches with query matrices and keeps the best files of each task; the result is that
    of the expression path.
    """
    rows = keyed(chunks).where("vector is not null").select(*CHUNK, "vector", policy(as_of_ms).alias("boost"))
    asked = queries.where("vector is not null").select("query_id", F.col("vector").alias("q"))
    if blocks or not _fits(asked, FEW_QUERIES):
        return top_ranked(best_per_file(_by_blocks(rows, asked, limit)), limit)
    length = F.col("_n") * F.col("_m")
    met = rows.withColumn("_n", vectors.norm(F.col("vector"))).crossJoin(F.broadcast(asked.withColumn("_m", vectors.norm(F.col("q")))))
    similar = F.when(length > 0, vectors.dot(F.col("vector"), F.col("q")) / length).otherwise(F.lit(0.0))
    scored = met.select("query_id", *CHUNK, F.round((1 + similar) / 2 * F.col("boost"), DIGITS).alias("score"))
    return top_ranked(best_per_file(scored), limit)


def neighbours(rows: DataFrame, asked: DataFrame, limit: int, *, blocks: bool = False) -> DataFrame:
    """(query_id, vec_id, cos, rank from 1): the nearest rows (vec_id, embedding) of each query (query_id, q), itself left out; ties go to the smaller id."""
    usable = rows.where("embedding is not null").select("vec_id", "embedding")
    if blocks or not _fits(asked, FEW_QUERIES):
        met = _nearest(usable, asked.where("q is not null"), limit)
    else:
        length = F.col("_n") * F.col("_m")
        met = usable.withColumn("_n", vectors.norm(F.col("embedding"))).crossJoin(F.broadcast(asked.withColumn("_m", vectors.norm(F.col("q")))))
        cos = F.when(length > 0, vectors.dot(F.col("embedding"), F.col("q")) / length).otherwise(F.lit(0.0))
        met = met.select("query_id", "vec_id", F.round(cos, DIGITS).alias("cos"))
    w = Window.partitionBy("query_id").orderBy(F.desc("cos"), "vec_id")
    return met.where("vec_id <> query_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def _nearest(rows: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """(query_id, vec_id, cos): per task and query the nearest `limit` rows, itself left out, by matrix products of at most PRODUCT cells.

    A query's worst row so far leaves out what is further away before anything is sorted.
    """
    kinds = [rows.schema["vec_id"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()]
    out, parts = f"query_id {kinds[1]}, vec_id {kinds[0]}, cos double", []
    for got in query_blocks(asked):
        held = rows.sparkSession.sparkContext.broadcast((got["query_id"].to_numpy(), unit_rows(got["q"])))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, matrix = held.value
            floor = np.full(len(names), -np.inf)
            q, v, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            step = max(1, PRODUCT // len(names))
            for b in batches:
                every, unit = b.column(0).to_numpy(), unit_rows(b.column(1))
                for at in range(0, len(every), step):
                    ids = every[at : at + step]
                    cos = matrix @ unit[at : at + step].T
                    least = floor if len(ids) <= limit + 1 else np.maximum(floor, np.partition(cos, len(ids) - limit - 1, axis=1)[:, len(ids) - limit - 1]) if np.isinf(floor).any() else floor
                    a, c = np.nonzero(cos >= least[:, None] - 10.0**-DIGITS)
                    other = names[a] != ids[c]
                    a, c = a[other], c[other]
                    q, v, s = np.concatenate([q, a]), np.concatenate([v, ids[c]]), np.concatenate([s, np.round(cos[a, c], DIGITS)])
                    order = np.lexsort((v, -s, q))
                    q, v, s = q[order], v[order], s[order]
                    place = np.arange(len(q)) - np.searchsorted(q, q)
                    q, v, s, place = (x[place < limit] for x in (q, v, s, place))
                    last = place == limit - 1
                    floor[q[last]] = s[last]
            yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(v), pa.array(s)], ["query_id", "vec_id", "cos"])

        parts.append(rows.mapInArrow(run, out))
    return reduce(DataFrame.unionByName, parts) if parts else rows.sparkSession.createDataFrame([], out)


def _best_of(score: np.ndarray, files: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) of the best row of each of the best `limit` files per query, with all that tie; rows are sorted by file and key."""
    first = np.flatnonzero(np.concatenate([[True], files[1:] != files[:-1]]))
    top = np.maximum.reduceat(score, first, axis=0)
    floor = np.partition(top, len(top) - limit, axis=0)[len(top) - limit] if len(top) > limit else top.min(axis=0)
    which, query = np.nonzero(top >= floor)
    row = first[which]
    long = np.diff(np.append(first, len(files)))[which] > 1
    for i in np.flatnonzero(long):
        end = first[which[i] + 1] if which[i] + 1 < len(first) else len(files)
        row[i] += score[row[i] : end, query[i]].argmax()
    return row, query


def _by_file(rows: DataFrame) -> DataFrame:
    """Rows as blocks are multiplied: files sort by path, then key, as the final ranking does."""
    return rows.select("hash_seq", F.concat("file_path", F.lit(APART), "file_key").alias("file"), "vector", "boost", *[c for c in ("cell",) if c in rows.columns])


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """Vectors as rows of length 1; zero vectors stay zero."""
    v = np.array(vectors.to_pylist(), np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _none_best() -> pd.DataFrame:
    return pd.DataFrame({"q": np.zeros(0, np.int64), "f": [], "k": [], "s": np.zeros(0)})


def _slice_best(part: pa.RecordBatch, matrix: np.ndarray, limit: int) -> pd.DataFrame:
    """(q, f, k, s): the best chunks of the best `limit` files of a slice per row of the query matrix."""
    part = part.take(pc.sort_indices(part, sort_keys=[("file", "ascending"), ("hash_seq", "ascending")]))
    score = np.round((1 + unit_rows(part.column(2)) @ matrix.T) / 2 * part.column(3).to_numpy(zero_copy_only=False)[:, None], DIGITS)
    keys, files = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
    row, query = _best_of(score, files, limit)
    return pd.DataFrame({"q": query, "f": files[row], "k": keys[row], "s": score[row, query]})


def _best(found: list[pd.DataFrame], limit: int) -> pd.DataFrame:
    best = pd.concat(found).sort_values(["q", "s", "f", "k"], ascending=[True, False, True, True])
    return best.drop_duplicates(["q", "f"]).groupby("q").head(limit)


def _told(best: pd.DataFrame, ids: pa.Array) -> pa.RecordBatch:
    path, _, key = zip(*(f.rpartition(APART) for f in best["f"]), strict=True) if len(best) else ((), (), ())
    columns = [ids.take(pa.array(best["q"].to_numpy(np.int64))), pa.array(key, pa.string()), pa.array(path, pa.string()), pa.array(best["k"].to_numpy(object), pa.string()), pa.array(best["s"].to_numpy(np.float64))]
    return pa.RecordBatch.from_arrays(columns, ["query_id", *CHUNK, "score"])


def query_blocks(asked: DataFrame, most: int | None = None) -> Iterator[pa.Table]:
    """Queries (query_id, q) in blocks of bounded rows and bytes, none empty."""
    total, size = measured(asked)
    count = max(1, -(-total // (most or MAX_BROADCAST_QUERIES)), -(-size // MAX_BROADCAST_BYTES))
    for k in range(count):
        got = (asked if count == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(count)) == k)).toArrow()
        if got.num_rows:
            yield got


def hits_schema(asked: DataFrame) -> str:
    return f"query_id {asked.schema['query_id'].dataType.simpleString()}, file_key string, file_path string, hash_seq string, score double"


def _by_blocks(rows: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """Per task and query the best rows of limit files, by matrix products with blocks of queries of bounded size."""
    spark, out = rows.sparkSession, hits_schema(asked)
    rows, parts = _by_file(rows), []
    for got in query_blocks(asked):
        held = spark.sparkContext.broadcast((got["query_id"].combine_chunks(), unit_rows(got["q"])))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, matrix = held.value
            best = _none_best()
            for b in batches:
                for at in range(0, b.num_rows, SLICE):
                    best = _best([best, _slice_best(b.slice(at, SLICE), matrix, limit)], limit)
            yield _told(best, ids)

        parts.append(rows.mapInArrow(run, out))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], out)


def by_cells(rows: DataFrame, got: pa.Table, wanted: dict[int, np.ndarray], limit: int, out: str) -> DataFrame:
    """The same of rows with a cell: each is multiplied with the queries (numbers in got) that want its cell only."""
    held = rows.sparkSession.sparkContext.broadcast((got["query_id"].combine_chunks(), unit_rows(got["q"]), wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, wanted = held.value
        best = _none_best()
        for b in batches:
            b = b.take(pc.sort_indices(b, sort_keys=[("cell", "ascending")]))
            cells = b.column(4).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)] if len(cells) else []
            for a, z in zip(edges, edges[1:], strict=False):
                own = wanted.get(int(cells[a]))
                if own is None or not len(own):
                    continue
                for at in range(a, z, SLICE):
                    part = _slice_best(b.slice(at, min(SLICE, z - at)), matrix[own], limit)
                    part["q"] = own[part["q"].to_numpy(np.int64)]
                    best = _best([best, part], limit)
        yield _told(best, ids)

    return _by_file(rows).mapInArrow(run, out)
