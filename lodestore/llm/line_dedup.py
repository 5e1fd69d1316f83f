"""Line dedup by site-relative frequency: lines that stand on too large a share of a site's pages go."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

#: A line on more than this share of its site's pages is boilerplate.
MAX_RATIO = 0.1
#: It must stand on so many pages at least; else each line of a site with few pages would be above the ratio.
MIN_HITS = 2
#: The boilerplate table is sent to all tasks up to this measured size, joined by shuffle beyond it.
BROADCAST_BYTES = 8 << 20


def _digest(line: Column) -> Column:
    """128 bits of a line (two seeded 64-bit hashes)."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _judged(lines: Column) -> Column:
    """Lines that can be boilerplate: those with a character that is not ASCII space."""
    return F.filter(lines, lambda x: x.rlike(r"[^\x09-\x0D\x20]"))


def boilerplate_lines(docs: DataFrame, *, site: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_hits: int = MIN_HITS) -> DataFrame:
    """(site, a, b): the digests of each site's boilerplate lines, one row each.

    A page counts once per distinct line. Both counts are pre-aggregated per task, so a
    hot site or line does not gather in one task. Only lines on min_hits pages or more
    meet the site totals. A site has at most (mean distinct lines of its pages) /
    max_ratio such lines, whatever its size.
    """
    pages = docs.where(F.col(site).isNotNull()).select(
        F.col(site).alias("site"), F.transform(F.array_distinct(_judged(_lines(F.coalesce(F.col(text), F.lit(""))))), _digest).alias("d")
    )
    total = pages.groupBy("site").agg(F.count("*").alias("pages"))
    seen = pages.select("site", F.explode("d").alias("d")).groupBy("site", "d").agg(F.count("*").alias("n")).where(F.col("n") >= min_hits)
    return seen.join(total, "site").where(F.col("n") > F.col("pages") * F.lit(max_ratio)).select("site", "d.a", "d.b")


def _arrays(found: DataFrame) -> DataFrame:
    """A local table (site, lines) of found, whose size is known to be small."""
    t = found.toArrow().combine_chunks().sort_by("site")
    names = t["site"].to_pylist()
    first = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
    digests = pa.StructArray.from_arrays([t[c].combine_chunks() if t.num_rows else pa.array([], pa.int64()) for c in ("a", "b")], ["a", "b"])
    lists = pa.ListArray.from_arrays(pa.array(np.array([*first, len(names)], np.int32)), digests)
    sites = pa.array([names[i] for i in first], t["site"].type)
    return found.sparkSession.createDataFrame(pa.table({"site": sites, "lines": lists}))


def line_dedup(
    docs: DataFrame,
    *,
    site: str = "source",
    text: str = "text",
    max_ratio: float = MAX_RATIO,
    min_hits: int = MIN_HITS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Every row and column of docs with the boilerplate lines taken out of `text`, plus n_lines and n_removed.

    Lines end at "\\n"; lines of ASCII space alone are kept. Null text stays null (0
    lines); empty text has no line; rows with a null site are left as they are. Sites of
    every size are judged; a line must stand on min_hits pages. Repeated rows count as
    pages of their own. If docs already has n_lines or n_removed, the new columns get a
    trailing underscore. An empty table gives an empty one. Texts are shuffled only if the
    boilerplate table is larger than broadcast_bytes; then digests of lines meet the table
    by (site, digest) and rows their places by hashes of site and text, never by site.
    """
    found = cut(boilerplate_lines(docs, site=site, text=text, max_ratio=max_ratio, min_hits=min_hits))
    size = found.agg(F.sum(F.length(F.col("site").cast("string")) + 40)).first()[0] or 0
    lines, bad = _lines(F.col(text)), fresh(docs, "line_bad")
    if size <= broadcast_bytes:
        key = fresh(docs, "line_site")
        sent = _arrays(found).select(F.col("site").alias(key), F.col("lines").alias(bad))
        joined = docs.join(F.broadcast(sent), docs[site] == F.col(key), "left")
        kept = F.filter(lines, lambda x: ~F.array_contains(F.col(bad), _digest(x)))
    else:
        k1, k2 = fresh(docs, "line_key"), fresh(docs, "line_also")
        keyed = docs.withColumns({k1: F.xxhash64(site, text), k2: F.xxhash64(F.lit(5), text, site)})
        each = keyed.where(F.col(site).isNotNull()).select(k1, k2, F.col(site).alias("site"), F.posexplode(F.transform(lines, _digest)).alias("pos", "d"))
        hits = each.select(k1, k2, "site", "pos", "d.a", "d.b").join(found, ["site", "a", "b"], "left_semi").groupBy(k1, k2).agg(F.collect_set("pos").alias(bad))
        joined = keyed.join(hits, [k1, k2], "left")
        kept = F.filter(lines, lambda x, i: ~F.array_contains(F.col(bad), i))
    kept = F.when(F.col(bad).isNull(), lines).otherwise(kept)
    size_of = lambda a: F.when(F.col(text).isNull() | (F.col(text) == ""), F.lit(0)).otherwise(F.size(a)).cast("long")
    return joined.select(
        *[F.when(F.col(bad).isNull(), F.col(c)).otherwise(F.array_join(kept, "\n")).alias(c) if c == text else joined[c] for c in docs.columns],
        size_of(lines).alias(fresh(docs, "n_lines")),
        (size_of(lines) - size_of(kept)).alias(fresh(docs, "n_removed")),
    )
