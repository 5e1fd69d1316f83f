"""Licence scans: phrases by word position, and a positional index of rare licence words.

The templates' words are posted by position. Of each template, a file's words of highest
IDF and those of the key phrases are looked up in the postings; occurrences that agree on one relative position align file
and template, and an aligned template counts if its mandatory key phrases stand where
the template has them. Built-in functions only; texts are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases with their labels, and opening passages of public licence texts
# with the phrases that must stand in them.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("mit", "released under the mit license", ["the mit license"]),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software",
        ["permission is hereby granted free of charge"],
    ),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    (
        "bsd-3-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met",
        ["redistribution and use in source and binary forms", "following conditions are met"],
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ["for any purpose with or without fee is hereby granted"],
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
]
#: So many of a file's words of each template, those of highest IDF, are looked up, and those of its key phrases.
TOP_WORDS = 12
#: Looked-up words that must agree on one relative position.
MIN_HITS = 2


def words_of(text: Column) -> Column:
    """Words of a text after lower-casing A-Z, as an array; null has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _array(items: Sequence, kind: str) -> Column:
    return F.array(*map(F.lit, items)).cast(f"array<{kind}>")


def _holds(words: Column, at: Column, phrase: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.get(words, at + k).eqNullSafe(F.lit(w)) for k, w in enumerate(phrase)])


def _starts(words: Column, phrase: Sequence[str]):
    return lambda i: _holds(words, i, phrase)


def _keyed(words: Column, marks: Sequence[tuple[int, Sequence[str]]]):
    """Whether all key phrases stand where a template shifted by s has them."""
    return lambda s: reduce(lambda a, b: a & b, [_holds(words, s + at, key) for at, key in marks])


def _shifts(body: Sequence[str]):
    """Relative positions of an occurrence and its word's postings in a template."""
    postings = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(i).alias("p")) for i, w in enumerate(body)])
    return lambda o: F.transform(F.filter(postings, lambda p: p["w"] == o["w"]), lambda p: o["i"] - p["p"])


def _among(words: str):
    return lambda o: F.array_contains(words, o["w"])


def _often(shifts: str, least: int):
    return lambda s: F.size(F.filter(shifts, lambda x: x == s)) >= least


def _share(words: Column, body: Sequence[str]):
    spots, own = F.sequence(F.lit(0), F.lit(len(body) - 1)), _array(body, "string")
    return lambda s: F.size(F.filter(spots, lambda i: F.get(words, s + i).eqNullSafe(F.get(own, i)))) / F.lit(float(len(body)))


def _has_all(present: Column, words: Sequence[str]) -> Column:
    return F.size(F.array_intersect(present, _array(sorted(set(words)), "string"))) == len(set(words))


def inverse_frequency(docs: DataFrame, vocabulary: Sequence[str], *, text: str = "text") -> dict[str, float]:
    """ln(documents / documents with the word) of each vocabulary word, over all rows; at most one row per word is collected."""
    found = F.array_intersect(_array(vocabulary, "string"), words_of(F.col(text)))
    counted = docs.select(F.explode(F.concat(found, F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()
    n = {r["w"]: r["count"] for r in counted}
    total = n.pop("", 0)
    return {w: math.log(total / n[w]) if w in n else math.inf for w in vocabulary}


def license_scan(
    docs: DataFrame,
    *,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str, Sequence[str]]] = TEMPLATES,
    top_words: int = TOP_WORDS,
    min_hits: int = MIN_HITS,
) -> DataFrame:
    """One row per row of docs (doc_id, text; other columns are ignored).

    doc_id, n_words, n_base (all places where a base phrase stands), first_word and
    last_word (smallest and largest start of those, null without any), base_labels,
    labels (base and templates; distinct, sorted, joined by commas, empty if none) and
    score: the largest share of an aligned template's words that the file has in their
    places, 0 without one. Null and empty texts have no words. Repeated doc_ids are
    scanned row by row; an empty table gives an empty one. Every step after the IDF
    count stays within a row, so neither copies nor long texts gather anywhere.
    """
    split = [(label, body.split(), [p.split() for p in keys]) for label, body, keys in templates]
    base = [(p.split(), label) for p, label in phrases]
    licence = sorted({w for _, body, _ in split for w in body})
    idf = inverse_frequency(docs, licence)
    ranked = sorted(licence, key=lambda w: (-idf[w], w))
    others = sorted({w for p, _ in base for w in p} - set(licence))

    rows = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    rows = rows.withColumn("present", F.array_intersect(_array(ranked + others, "string"), F.col("words")))
    words, present = F.col("words"), F.col("present")
    n = F.size("words")
    spots = F.sequence(F.lit(0), n - 1)
    none = F.array().cast("array<int>")
    starts = [F.when(_has_all(present, p), F.filter(spots, _starts(words, p))).otherwise(none) for p, _ in base]
    rows = rows.withColumns({f"base_{k}": s for k, s in enumerate(starts)})

    eligible = [_has_all(present, [w for key in keys for w in key]) for _, _, keys in split]
    for k, ((_, body, keys), fits) in enumerate(zip(split, eligible, strict=True)):
        top = F.slice(F.array_intersect(_array([w for w in ranked if w in body], "string"), present), 1, top_words)
        own = F.array_union(top, _array(sorted({w for key in keys for w in key}), "string"))
        rows = rows.withColumn(f"rare_{k}", F.when(fits, own).otherwise(F.array().cast("array<string>")))
    rare = F.array_distinct(F.concat(*[f"rare_{k}" for k in range(len(split))]))
    rows = rows.withColumn("rare", F.when(reduce(lambda a, b: a | b, eligible), rare))
    placed = F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    rows = rows.withColumn("met", F.when(F.col("rare").isNotNull(), F.filter(placed, lambda x: F.array_contains("rare", x["w"]))))

    for k, ((_, body, keys), fits) in enumerate(zip(split, eligible, strict=True)):
        looked_up = F.filter("met", _among(f"rare_{k}"))
        rows = rows.withColumn(f"shift_{k}", F.when(fits, F.flatten(F.transform(looked_up, _shifts(body)))).otherwise(none))
        marks = [(next(i for i in range(len(body)) if body[i : i + len(key)] == key), key) for key in keys]
        aligned = F.filter(F.filter(F.array_distinct(f"shift_{k}"), _keyed(words, marks)), _often(f"shift_{k}", min_hits))
        rows = rows.withColumn(f"score_{k}", F.array_max(F.transform(aligned, _share(words, body))))

    places = F.concat(*[f"base_{k}" for k in range(len(base))])
    named = [F.when(F.size(f"base_{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(base)]
    more = [F.when(F.col(f"score_{k}").isNotNull(), F.lit(label)) for k, (label, _, _) in enumerate(split)]
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))), ",")
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        joined(named).alias("base_labels"),
        joined([*named, *more]).alias("labels"),
        F.coalesce(F.array_max(F.array(*[f"score_{k}" for k in range(len(split))])), F.lit(0.0)).alias("score"),
    )
