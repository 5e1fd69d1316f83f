"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words as Python's \w+ finds them; Java's \w is ASCII only.
WORD = r"[\p{L}\p{N}_]+"
PLAIN_WORD = r"[a-z0-9]+"


def words(text: Column, pattern: str = WORD) -> Column:
    """Lower-cased words of a text in order; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def compact(text: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\u0085   -     　\u001c-\u001f]+", " "))


def shortened(text: Column, most: int) -> Column:
    """At most `most` characters; longer texts end at a word and in '...'."""
    head = F.substring(text, 1, most - 3)
    at_word = F.trim(F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.when(at_word != "", at_word).otherwise(head)), F.lit("...")))


def title(text: Column, path: Column) -> Column:
    """First-line heading (past a 'Notes' one the next second-level heading), a TITLE property, or the file's stem."""
    first = F.trim(F.regexp_extract(text, r"\A##?[^\S\n]+([^\n]+)", 1))
    second = F.trim(F.regexp_extract(text, r"\n##\s+([^\n]+)", 1))
    named = F.trim(F.regexp_extract(text, r"(?m)^#\+TITLE:\s*([^\n]+)$", 1))
    base = F.element_at(F.split(path, "/"), -1)
    stem = F.when(F.length(F.regexp_replace(base, r"^\.+", "")) == 0, base).otherwise(F.regexp_replace(base, r"(?<=[^.])\.[^.]*$", ""))
    usual = ~first.isin("Notes", "📝 Notes")
    return F.coalesce(
        F.when((first != "") & usual, first), F.when((first != "") & ~usual & (second != ""), second), F.when(named != "", named), stem
    )


def without_tags(html: Column) -> Column:
    return compact(F.regexp_replace(html, r"<[^>]+>", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


# Phrases and words that mark a query as visual, and words that may stand before its subject.
VISUAL_PHRASES = [
    "show me", "image of", "photo of", "picture of", "architecture diagram", "flow chart", "mind map", "that photo", "that image",
    "the diagram", "the chart", "the picture", "the screenshot", "visual representation",
]
VISUAL_WORDS = [
    "show", "diagram", "chart", "screenshot", "illustration", "drawing", "infographic", "wireframe", "mockup", "sketch", "whiteboard",
    "portrait",
]
LEADING = r"^\s*(of|a|an|the|with|for|in)\b\s*"


def is_visual(query: Column) -> Column:
    """Whether a query asks for something to look at. A bare 'show' inside a sentence does not count by itself."""
    low = F.lower(F.trim(query))
    phrase = low.rlike("|".join(VISUAL_PHRASES))
    others = low.rlike(r"\b(" + "|".join(w for w in VISUAL_WORDS if w != "show") + r")\b")
    bare = F.array_contains(F.split(low, r"\s+"), "show")
    return F.coalesce(phrase | (low == "show") | others | (low.rlike(r"\bshow\b") & ~bare), F.lit(False))


def visual_description(query: Column) -> Column:
    """'A photograph or image showing' the query's subject; the query itself if nothing is left of it."""
    low = F.lower(F.trim(query))
    core = low
    for p in VISUAL_PHRASES:
        core = F.replace(core, F.lit(p), F.lit(""))
    core = F.regexp_replace(core, r"\b(" + "|".join(VISUAL_WORDS) + r")\b", "")
    core = F.trim(F.regexp_replace(F.trim(core), LEADING, ""))
    return F.when(core == "", low).otherwise(F.concat(F.lit("A photograph or image showing "), core))
