import re
from collections import Counter

import pytest

from lodestore.llm import licenses

from .cases import SCHEMA, documents


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = lambda p: [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    places, base, labels, score = [], set(), set(), 0.0
    for phrase, label in licenses.PHRASES:
        if got := at(phrase.split()):
            places += got
            base.add(label)
    for label, body, keys in licenses.TEMPLATES:
        body = body.split()
        first = keys[0].split()
        lead = next(i for i in range(len(body)) if body[i : i + len(first)] == first)
        for spot in at(first):
            off = spot - lead
            held = lambda key: any(body[i : i + len(key)] == key and words[max(0, off + i) : off + i + len(key)] == key for i in range(len(body)))  # noqa: B023, E731
            if all(held(k.split()) for k in keys):
                labels.add(label)
                score = max(score, sum(0 <= off + i < len(words) and words[off + i] == w for i, w in enumerate(body)) / len(body))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score


TEXTS = [
    "Foo. Licensed under CC BY-NC 4.0.\nCC BY cc by",
    "This work is licensed under the GNU General Public License, version 3. All rights reserved.",
    "the GNU general public\nlicense",
    "x Licensed under the Apache License, Version 2.0. y",
    "apache license 2.0",
    "Released under the MIT License. " * 3,
    "mit license",
    "A " + licenses.TEMPLATES[2][1] + " B",
    "granted, " + " ".join(licenses.TEMPLATES[2][1].split()[:12]),
    licenses.TEMPLATES[5][1].upper(),
    licenses.TEMPLATES[5][1][:60],
    licenses.TEMPLATES[6][1] + " and " + licenses.TEMPLATES[7][1],
    "all all rights reserved reserved ALL RIGHTS RESERVED",
    "ÄÖ cc\x00by é cc-by CC_BY ccby",
]


def test_scan_equals_brute_force(spark):
    extra = spark.createDataFrame([(100 + i, t, *[None] * 9) for i, t in enumerate(TEXTS)], SCHEMA)
    docs = documents(spark).unionByName(extra)
    got = Counter((r.doc_id, *r[1:7], round(r.score, 9)) for r in licenses.license_scan(docs).collect())
    want = Counter((r.doc_id, *(b := brute(r.text))[:6], round(b[6], 9)) for r in docs.collect())
    assert got == want
    assert licenses.license_scan(documents(spark, empty=True)).count() == 0


def test_inverse_frequency_counts_all_rows(spark):
    docs = spark.createDataFrame([("mit mit",), ("MIT x",), (None,), ("y",)], "text string")
    got = licenses.inverse_frequency(docs, ["mit", "gnu"])
    assert got["mit"] == pytest.approx(0.6931471805599453) and got["gnu"] == float("inf")
