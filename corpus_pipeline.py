"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shared_folder, table, words
from tessera.llm.lines import dedup_lines
from tessera.llm.mixing import mix_sources
from tessera.llm.packing import pack_documents
from tessera.llm.quality import quality_verdicts
from tessera.llm.shingles import similar_groups

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, blank and short texts go; repeated rows share their fate; an empty table gives no rows. Other columns stay as they are, as in
    all stages but the last.
    """
    return quality_verdicts(docs).where("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line matches; those left without a word go.

    Lines of under five words match if their words are the same. Of equal lines the one of the smallest id stays (null first), then of
    the first place; a null or empty text stays; an empty table gives no rows.
    """
    clean = dedup_lines(docs, drop_emptied=True)
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 0.8 of their five-word shingles, the one with the smallest id.

    Rows without an id all stay, and rows that repeat an id that stays; null and blank texts are one group; an empty table gives no rows.
    """
    groups = similar_groups(docs)
    first = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_first")).distinct()
    nameless = docs.where(F.col("doc_id").isNull())
    return docs.join(first, docs["doc_id"] == first["_first"], "left_semi").unionByName(nameless)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, as whole rows.

    The one document of a source that the mix takes in part is taken whole if that is the larger part. A document without words is taken
    as often as its source has whole epochs; a null source is a source; an empty table gives no rows.
    """
    sized = docs.withColumn("size", F.size(words(F.col("text"))).cast("long"))
    mixed = mix_sources(sized)
    part = F.col("taken") - F.col("repeats") * F.col("size")
    times = F.col("repeats") + F.when(2 * part > F.col("size"), 1).otherwise(0)
    copies = mixed.withColumn("times", times.cast("int")).where("times > 0")
    return copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of ids: one row for each piece, with its ids.

    A null text is empty and has the end id alone; repeated rows are packed each by itself; an empty table gives no rows.
    """
    return pack_documents(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packing", packing)]

#: Edit distances, XXH64 and subword ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to what the one before has written."""
    base = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
