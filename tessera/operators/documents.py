"""Document transforms: text normal form, headings, sections, token windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a heading line looks like.
HEADING = r"(?i)^(?:part\s+[ivx]+|item\s+(?:[0-9]{1,2}[a-z]?|[ivx]+)(?:\.|\s|:|-).{0,170})$"


def normalized_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def is_heading(text: Column) -> Column:
    return (F.length(text) <= 200) & text.rlike(HEADING)


def sectionize(blocks: DataFrame, *, doc: str, place: str, text: str, heading: str) -> DataFrame:
    """``doc, sequence_number, section_name, content, char_count`` from ordered blocks.

    A heading starts a section; sections without content go, and numbers are given after that.
    """
    so_far = Window.partitionBy(doc).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    numbered = blocks.withColumn("_s", F.sum(F.col(heading).cast("int")).over(so_far))
    parts = numbered.groupBy(doc, "_s").agg(
        F.max(F.when(F.col(heading), F.substring(text, 1, 200))).alias("section_name"),
        F.array_sort(F.collect_list(F.when(~F.col(heading), F.struct(place, text)))).alias("_b"),
    )
    kept = parts.where(F.size("_b") > 0).withColumn("content", F.array_join(F.col("_b")[text], "\n\n"))
    number = (F.row_number().over(Window.partitionBy(doc).orderBy("_s")) - 1).cast("int")
    return kept.select(doc, number.alias("sequence_number"), F.coalesce("section_name", F.lit("Document")).alias("section_name"), "content", F.length("content").alias("char_count"))


def token_windows(docs: DataFrame, *, doc: str, text: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """``doc, chunk_index, token_count, content``: overlapping windows over white-space tokens.

    The number of windows is known from the token count, so windows are slices, without a loop.
    """
    step = size - overlap
    tokens = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    sized = docs.select(doc, tokens.alias("_t")).where(F.size("_t") > 0)
    n = F.size("_t")
    count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / step) + 1).cast("int")
    cut = sized.select(doc, "_t", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_index"))
    window = F.slice("_t", F.col("chunk_index") * step + 1, size)
    return cut.select(doc, "chunk_index", F.size(window).alias("token_count"), F.array_join(window, " ").alias("content"))
