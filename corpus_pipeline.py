"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept;
run() writes every stage's rows as Parquet in the shared folder and reads them again.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm.common import Stage
from lodestore.llm.line_dedup import line_dedup
from lodestore.llm.packing import pack_documents
from lodestore.llm.quality import quality_filter
from lodestore.llm.queries import tokenizer_file
from lodestore.llm.simhash import near_copy_dedup
from lodestore.llm.suffix_dedup import suffix_dedup_text


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts have no words and go."""
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the boilerplate lines of their source; n_chars follows the text. Null texts and rows with a null source stay as they are."""
    return _with_length(line_dedup(docs).select(*docs.columns))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one of smallest doc_id."""
    return near_copy_dedup(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the strings of 240 bytes that occur elsewhere; n_chars follows the text. Null texts stay null (n_chars null), short ones as they are."""
    return _with_length(suffix_dedup_text(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 4096 tokens; null and empty texts are one piece of the end token."""
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", simhash_stage),
    ("suffix-array dedup", suffix_stage),
    ("best-fit packing", packing_stage),
]

#: SimHash, suffix arrays and packing are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def _with_length(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over documents; the tables of the stages before it are deleted on the way."""
    kept = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = kept.put(stage(spark, docs, sf_dir), str(k))
        if k:
            kept.drop(str(k - 1))
    return docs
