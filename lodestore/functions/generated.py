"""What language models write, as columns: lists in any of their usual forms, media tags, query variants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compact, is_visual, visual_description

# Tags that say nothing, their limits, and openings of questions with what may stand for them.
EMPTY_TAGS = ["image", "images", "video", "videos", "photo", "picture", "frame", "scene", "clip"]
MAX_TAGS, MAX_TAG, MAX_VARIANTS = 8, 48, 2
REWRITES = [
    ("how to", "guide for"), ("what is", "definition of"), ("best way to", "optimal method for"), ("difference between", "comparison of"),
    ("example of", "sample"), ("how do", "how does"),
]
#: Quotes around an item; a bullet or number before it.
_QUOTES, _BULLET = "[\"'` ]+", r"^\s*(?:[-*•]\s*|\d+[.)]\s*)"


def _none() -> Column:
    return F.array().cast("array<string>")


def json_items(raw: Column, key: str | None = None) -> Column:
    """Items of a JSON list of strings, or of the list under a key of an object; null if raw is neither."""
    said = F.trim(raw)
    items = F.when(said.startswith("[") & said.endswith("]"), F.from_json(said, "array<string>"))
    if key:
        items = F.coalesce(items, F.when(said.startswith("{") & said.endswith("}"), F.from_json(said, f"struct<`{key}`:array<string>>")[key]))
    return F.filter(items, lambda x: x.isNotNull())


def lines(raw: Column) -> Column:
    """Lines that hold more than white space; null has none."""
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")


def _unfenced(raw: Column) -> Column:
    inner = F.regexp_extract(raw, r"(?s)```(?:[A-Za-z0-9_+-]+)?\s*(.*?)\s*```", 1)
    return F.when(raw.rlike(r"(?s)```.*```"), inner).otherwise(raw)


def _bare(item: Column) -> Column:
    """An item without quotes around it or a bullet or number in front."""
    return F.trim(F.regexp_replace(F.regexp_replace(compact(item), f"^{_QUOTES}|{_QUOTES}$", ""), _BULLET, ""))


def media_tags(raw: Column) -> Column:
    """Tags from a generator's text: a JSON list or object, lines or comma-separated words, fenced or not.

    Lower-cased, without quotes, bullets and # signs; underscores are spaces. Tags that
    say nothing go, long ones end at a word, each stays once, eight at most. Null and
    empty text has none.
    """
    said = _unfenced(F.coalesce(raw, F.lit("")))
    plain = F.flatten(F.transform(lines(said), lambda x: F.split(F.regexp_replace(x, "(?i)^tags:", ""), ",")))

    def tag(item: Column) -> Column:
        name = F.regexp_replace(_bare(F.lower(item)), r"^[#\s]+", "")
        return F.trim(F.regexp_replace(F.trim(F.replace(name, F.lit("_"), F.lit(" "))), "[;:,.]+$", ""))

    def short(name: Column) -> Column:
        head = F.substring(name, 1, MAX_TAG)
        at_word = F.trim(F.regexp_extract(head, "^(.*) [^ ]*$", 1))
        return F.when(F.length(name) <= MAX_TAG, name).when(at_word != "", at_word).otherwise(F.trim(head))

    named = F.transform(F.coalesce(json_items(said, "tags"), plain), tag)
    useful = F.filter(named, lambda t: (t != "") & ~t.isin(EMPTY_TAGS))
    return F.slice(F.array_distinct(F.transform(useful, short)), 1, MAX_TAGS)


def _first_of_each(items: Column, query: Column) -> Column:
    """Items that differ from the query and from each other but for case, two at most."""
    known = F.lower(F.trim(query))
    usable = F.filter(F.transform(items, _bare), lambda x: (x != "") & (F.lower(x) != known))
    keys = F.transform(usable, F.lower)
    return F.slice(F.filter(usable, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1), 1, MAX_VARIANTS)


def rewritten(query: Column) -> Column:
    """Variants of a question by its opening; of other questions what stands behind the first two words."""
    low = F.lower(F.trim(query))
    turned: Column | None = None
    for opening, other in REWRITES:
        at = F.instr(low, opening)
        new = F.array(F.concat(F.substring(low, F.lit(1), at - 1), F.lit(other), F.substring(low, at + len(opening), F.length(low))))
        turned = F.when(at > 0, new) if turned is None else turned.when(at > 0, new)
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    rest = F.array_join(F.slice(words, 3, 10_000), " ")
    asks = (low.startswith("what ") | low.startswith("how ")) & (F.size(words) > 2)
    turned = turned.when(asks, F.array(rest, F.concat(F.lit("information about "), rest))).otherwise(_none())
    return _first_of_each(turned, query)


def query_variants(query: Column, generated: Column | Callable[[Column], Column] | None = None) -> Column:
    """Other wordings of a query, two at most: a description for visual ones; else a generator's, as a JSON list or
    lines; else those by rule. generated is a column of its text or a column function of the query (a pandas UDF)."""
    ruled = rewritten(query)
    if generated is not None:
        said = generated(query) if callable(generated) and not isinstance(generated, Column) else generated
        told = F.filter(lines(said), lambda x: ~F.lower(x).startswith("here are"))
        told = F.transform(told, lambda x: F.regexp_replace(x, "(?i)^(query|queries):", ""))
        listed = json_items(said)
        made = _first_of_each(F.when(F.size(listed) > 0, listed).otherwise(told), query)
        ruled = F.when(F.size(made) > 0, made).otherwise(ruled)
    return F.when(is_visual(query), F.array(visual_description(query))).otherwise(F.coalesce(ruled, _none()))


def parent_summary(parts: Column, fallback: Column, most: int = 4000) -> Column:
    """The first two different texts of a memory's parts, or one of 600 characters; the fallback if there is none."""
    texts = F.filter(F.transform(parts, compact), lambda x: x != "")
    keys = F.transform(texts, F.lower)
    first = F.filter(texts, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)
    shown = F.when(F.length(F.get(first, F.lit(0))) >= 600, F.slice(first, 1, 1)).otherwise(F.slice(first, 1, 2))
    said = F.when(F.size(shown) > 0, F.array_join(shown, "\n\n")).otherwise(compact(fallback))
    return F.trim(F.substring(said, 1, most))
