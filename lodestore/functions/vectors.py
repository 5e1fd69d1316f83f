"""Vector arithmetic on array columns, in double precision, and a hashing embedder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PLAIN_WORD, words


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def hash_buckets(text: Column, size: int = 2048) -> Column:
    """Sparse bag of words: an array of (bucket, value) with value the signed count over the norm, by bucket.

    A word's bucket is its SHA-256 modulo size (a power of two up to 2048); bit 8 is its sign.
    """
    number = F.transform(words(text, PLAIN_WORD), lambda w: F.conv(F.right(F.sha2(w, 256), F.lit(3)), 16, 10).cast("int"))
    signed = F.transform(number, lambda h: F.struct(h.bitwiseAND(size - 1).alias("bucket"), F.when(F.shiftright(h, 8).bitwiseAND(1) == 0, 1.0).otherwise(-1.0).alias("sign")))
    kinds = F.array_sort(F.array_distinct(F.transform(signed, lambda x: x["bucket"])))
    summed = F.transform(kinds, lambda b: F.struct(b.alias("bucket"), F.aggregate(F.filter(signed, lambda x: x["bucket"] == b), F.lit(0.0), lambda s, x: s + x["sign"]).alias("value")))
    length = F.sqrt(F.aggregate(summed, F.lit(0.0), lambda s, x: s + x["value"] * x["value"]))
    return F.transform(summed, lambda x: F.struct(x["bucket"].alias("bucket"), (x["value"] / length).alias("value")))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common words of two word arrays; 0 if one is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
