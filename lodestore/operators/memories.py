"""Listing, summaries and tags of memories; ordered aggregates over each memory's own snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.generated import parent_summary
from ..functions.text import compact, shortened
from .bounded import firsts, firsts_different
from .filters import is_root, visible, within

SUMMARY, SUMMARY_FROM, SUMMARY_PARTS, TAGS, PARENT = 320, 280, 2, 8, 4000


def _spot() -> Column:
    """A snippet's place in its memory: the root's first, then by place."""
    return F.struct(
        F.when(F.coalesce("memory_role", F.lit("child")) == "root", 0).otherwise(1).alias("r"), F.coalesce("pos", F.lit(0)).cast("long").alias("p"),
        F.coalesce("seq", F.lit(0)).cast("long").alias("s"), F.col("file_path").alias("f"),
    )


def _gathered(kind: str) -> Column:
    """A memory's items of a kind in order."""
    item = F.when(F.col("kind") == kind, F.struct("spot", "at", "value"))
    return F.transform(F.array_sort(F.collect_list(item)), lambda x: x["value"])


def _items(body: Column, more: list[Column]) -> list[Column]:
    text = F.array(F.struct(F.lit("text").alias("kind"), F.lower(body).alias("key"), body.alias("value"), F.lit(0).alias("at")))
    return [F.col("memory_id"), _spot().alias("spot"), F.inline(F.concat(text, *more))]


def summaries(snippets: DataFrame) -> DataFrame:
    """(memory_id, summary, tags, snippets): the first two different texts, or one of 280 characters, cut to 320; the first eight different tags.

    Texts are cut to what a summary can show. Of each memory a task sends eight texts and
    eight tags at most, however many snippets it has; null and blank ones do not count.
    """
    body = F.substring(compact(F.col("text_body")), 1, 2 * SUMMARY)
    none = F.array().cast("array<struct<kind:string,key:string,value:string,at:int>>")
    tag = lambda t, i: F.struct(F.lit("tag").alias("kind"), F.lower(F.trim(t)).alias("key"), F.lower(F.trim(t)).alias("value"), (i + 1).alias("at"))
    items = snippets.select(*_items(body, [F.coalesce(F.transform("tags", tag), none)])).where("key <> ''")
    kept = firsts_different(items, ["memory_id", "kind"], "key", ["spot", "at", "value"], TAGS).withColumn("n", F.lit(None).cast("long"))
    counts = snippets.groupBy("memory_id").agg(F.count("*").alias("n"))
    rows = kept.unionByName(counts, allowMissingColumns=True).groupBy("memory_id").agg(_gathered("text").alias("texts"), _gathered("tag").alias("tags"), F.max("n").alias("snippets"))
    first = F.col("texts")
    chosen = F.when(F.length(F.get(first, F.lit(0))) >= SUMMARY_FROM, F.slice(first, 1, 1)).otherwise(F.slice(first, 1, SUMMARY_PARTS))
    return rows.select("memory_id", shortened(F.array_join(chosen, " "), SUMMARY).alias("summary"), "tags", "snippets")


def list_memories(documents: DataFrame, limit: int = 50) -> DataFrame:
    """Visible roots, newest first; sorted before the limit is taken."""
    return documents.where(visible() & is_root()).orderBy(F.desc("updated_at"), "file_path").limit(limit)


def memory_view(documents: DataFrame, chunks: DataFrame, *, memory_id: str | None = None, path: str | None = None, snippets: int = 20, shown: int = 500, **scope: str | None) -> DataFrame:
    """The memory of an id or, without one, of a root path: one row, or none if it is not visible.

    memory_id, path, title, collection, children (path, title, content_type; by path) and
    snippets (path, text; the root's first, then by path and place, the first 20 that are
    not blank, 500 characters each). documents and chunks hold the columns of the store.
    """
    own = F.col("memory_id") == memory_id if memory_id else F.coalesce("memory_root_path", "file_path") == F.lit(path)
    family = documents.where(visible() & within(**scope) & F.coalesce(own, F.lit(False)))
    role = F.when(is_root(), 0).otherwise(1)
    child = F.struct(F.col("file_path").alias("path"), F.coalesce("title", "file_path").alias("title"), F.col("content_type"))
    rows = family.groupBy("collection", "memory_id").agg(
        F.min_by(F.struct(F.coalesce("memory_root_path", "file_path").alias("path"), "title"), F.struct(role, F.col("file_path"))).alias("root"),
        F.array_sort(F.collect_list(F.when(~is_root(), child))).alias("children"), F.min(role).alias("first"),
    ).where("first = 0")
    said = F.trim(F.coalesce("text_body", F.lit("")))
    text = F.struct(role.alias("role"), F.col("file_path").alias("path"), F.coalesce("seq", F.lit(0)).alias("seq"), F.substring(said, 1, shown).alias("text"))
    own_texts = chunks.where(visible() & within(**scope) & F.coalesce(own, F.lit(False)) & (said != "")).select("collection", "memory_id", text.alias("text"))
    told = firsts(own_texts, ["collection", "memory_id"], ["text"], snippets).groupBy("collection", "memory_id").agg(F.array_sort(F.collect_list("text")).alias("all"))
    joined = rows.join(told.withColumnRenamed("collection", "_c").withColumnRenamed("memory_id", "_m"), (F.col("collection") == F.col("_c")) & (F.col("memory_id") == F.col("_m")), "left")
    kept = F.transform(F.coalesce("all", F.array().cast("array<struct<role:int,path:string,seq:int,text:string>>")), lambda x: F.struct(x["path"].alias("path"), x["text"].alias("text")))
    return joined.select("memory_id", "collection", F.col("root.path").alias("path"), F.coalesce("root.title", "root.path").alias("title"), "children", kept.alias("snippets"))


def parent_summaries(snippets: DataFrame, title: str = "title") -> DataFrame:
    """(memory_id, summary): what a memory's root is stored with, from its parts in order; the title of the first if they are all blank.

    Of each memory a task sends two texts and a title at most.
    """
    body = F.substring(compact(F.col("text_body")), 1, PARENT)
    named = F.array(F.struct(F.lit("title").alias("kind"), F.lit("-").alias("key"), F.col(title).alias("value"), F.lit(0).alias("at")))
    items = snippets.select(*_items(body, [named])).where("key <> ''")
    kept = firsts_different(items, ["memory_id", "kind"], "key", ["spot", "at", "value"], SUMMARY_PARTS)
    rows = kept.groupBy("memory_id").agg(_gathered("text").alias("texts"), _gathered("title").alias("titles"))
    return rows.select("memory_id", parent_summary(F.col("texts"), F.get("titles", F.lit(0)), PARENT).alias("summary"))


def list_collections(documents: DataFrame) -> DataFrame:
    return documents.where(visible()).select("collection").distinct()


def list_namespaces(documents: DataFrame) -> DataFrame:
    """Distinct namespace combinations, empty for null."""
    names = ["user_id", "session_id", "project_id", "profile"]
    return documents.where(visible()).select(*[F.coalesce(F.col(n), F.lit("")).alias(n) for n in names]).distinct()


def conversation_turns(turns: DataFrame, *, max_turn: int = 6000) -> DataFrame:
    """Child memories of conversations: conv_id, path, role, title, text_body, seq (from 1) and total.

    turns: conv_id, turn (any ascending numbers), role, text; blank turns are dropped.
    """
    body = shortened(compact(F.col("text")), max_turn)
    rows = turns.withColumn("content", body).where("content <> ''")
    role = F.substring(F.lower(compact(F.col("role"))), 1, 64)
    rows = rows.withColumn("role", F.when(role != "", role).otherwise("speaker"))
    w = Window.partitionBy("conv_id")
    rows = rows.withColumn("seq", F.row_number().over(w.orderBy("turn", "content")).cast("int")).withColumn("total", F.count("*").over(w))
    root = F.concat(F.lit("conv/"), F.col("conv_id").cast("string"))
    title = F.concat(F.lit("Conversation "), F.col("conv_id").cast("string"))
    text = F.concat(
        F.lit("# "), title, F.lit(" - turn "), F.col("seq").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit("\nRole: "), F.col("role"),
        F.lit("\nSpeaker: "), F.col("role"), F.lit("\n\n"), F.col("content"),
    )
    return rows.select("conv_id", root.alias("root_path"), F.concat(root, F.lit("::turn:"), F.lpad(F.col("seq").cast("string"), 4, "0")).alias("file_path"), title.alias("title"), "role", "seq", "total", "content", text.alias("text_body"))


def conversation_roots(children: DataFrame) -> DataFrame:
    """Root memories: the summary of a conversation (participants, first turns) and its tags."""
    first = F.when(F.col("seq") <= 8, F.struct("seq", "role", shortened(F.col("content"), 360).alias("content")))
    rows = children.groupBy("conv_id", "root_path", "title").agg(
        F.max("total").alias("total"), F.array_sort(F.collect_list(first)).alias("shown"), F.array_sort(F.collect_set("role")).alias("people"),
    )
    # Roles in the order of their first turn: a row per role, not per turn, is gathered.
    begins = children.groupBy("conv_id", "role").agg(F.min("seq").alias("seq")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role"))).alias("order"))
    rows = rows.join(begins, "conv_id")
    said = F.transform("shown", lambda t: F.concat(F.lit("- Turn "), t["seq"].cast("string"), F.lit(" "), t["role"], F.lit(": "), t["content"]))
    lines = F.concat_ws(
        "\n", F.concat(F.lit("# "), F.col("title")), F.lit(""), F.concat(F.lit("Conversation with "), F.col("total").cast("string"), F.lit(" turns.")),
        F.concat(F.lit("Participants: "), F.array_join(F.slice("people", 1, 12), ", "), F.lit(".")), F.lit(""), F.lit("Turn excerpts:"), F.array_join(said, "\n"),
    )
    roles = F.transform("order", lambda t: F.concat(F.lit("role:"), t["role"]))
    tags = F.slice(F.concat(F.array(F.lit("conversation"), F.concat(F.lit("turns:"), F.col("total").cast("string"))), roles), 1, 16)
    return rows.select("conv_id", F.col("root_path").alias("file_path"), "title", F.trim(F.substring(F.trim(lines), 1, 4000)).alias("text_body"), tags.alias("tags"), "total")
