"""Keyword and vector channels under shared filters, and their reciprocal-rank fusion."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.fulltext import Term
from tessera.operators.textindex import TextIndex, ranked

MISSING_RANK = 201


@dataclass(frozen=True)
class Filters:
    cik: str | None = None
    forms: tuple[str, ...] = ()
    filed_from: datetime.date | None = None
    filed_to: datetime.date | None = None
    sections: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.filed_from and self.filed_to and self.filed_from > self.filed_to:
            raise ValueError("filed_from is after filed_to")

    def apply(self, df: DataFrame) -> DataFrame:
        """Filter before any limit, so that both channels rank the same rows."""
        if self.cik is not None:
            df = df.where(F.col("cik") == self.cik.zfill(10))
        if self.forms:
            df = df.where(F.col("form_type").isin(sorted(f.upper() for f in self.forms)))
        if self.filed_from:
            df = df.where(F.col("filing_date") >= F.lit(self.filed_from))
        if self.filed_to:
            df = df.where(F.col("filing_date") <= F.lit(self.filed_to))
        return df.where(F.col("section_name").isin(list(self.sections))) if self.sections else df


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _ranked(df: DataFrame, id_col: str, limit: int) -> DataFrame:
    """The best rows with their place; only ``limit`` rows are ever in one place."""
    best = df.orderBy(F.desc("score"), id_col).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))


def keyword_channel(index: TextIndex, terms: list[str], *, allowed: DataFrame, id_col: str, limit: int) -> DataFrame:
    """Documents of ``allowed(id)`` that hold all terms (lower case, whole words), by number of occurrences."""
    if index.english:
        raise ValueError("whole words need an index of whole words")
    found = index.search([[Term((t,)) for t in terms]], limit=limit, allowed=allowed, count=True)
    return ranked(found, id_col)


def fulltext_channel(index: TextIndex, query: Sequence[Sequence[Term | None]], *, allowed: DataFrame, id_col: str, limit: int) -> DataFrame:
    """Documents of ``allowed(id)`` in which an alternative of a query over English stems holds, by cover density."""
    return ranked(index.search(query, limit=limit, allowed=allowed), id_col)


def semantic_channel(df: DataFrame, query: DataFrame, *, id_col: str, model: str, limit: int) -> DataFrame:
    """Rows with a vector of the model, by cosine similarity to the single row of ``query(q)``."""
    usable = df.where(F.col("embedding").isNotNull() & (F.col("embedding_model") == model))
    scored = usable.crossJoin(F.broadcast(query.limit(1))).select(id_col, cosine(F.col("embedding"), F.col("q")).alias("score"))
    return _ranked(scored, id_col, limit)


def fuse(keyword: DataFrame, semantic: DataFrame, *, id_col: str, k: int = 60, weights: tuple[float, float] = (1.0, 1.0), top_k: int = 20) -> DataFrame:
    """Weighted reciprocal-rank fusion; ties by semantic rank, keyword rank (a missing one last), then id."""
    if k < 1 or min(weights) < 0 or not any(weights):
        raise ValueError("k must be positive, weights not negative and not both 0")
    both = keyword.select(id_col, F.col("rank").alias("keyword_rank"), F.col("score").alias("keyword_score")).join(
        semantic.select(id_col, F.col("rank").alias("semantic_rank"), F.col("score").alias("semantic_score")), id_col, "full_outer"
    )
    part = lambda name, w: F.coalesce(F.lit(w) / (F.lit(k) + F.col(name)), F.lit(0.0))
    fused = both.withColumn("score", (part("keyword_rank", weights[0]) + part("semantic_rank", weights[1])).cast("double"))
    last = lambda name: F.coalesce(F.col(name), F.lit(MISSING_RANK))
    channels = F.array_join(F.array_compact(F.array(F.when(F.col("keyword_rank").isNotNull(), "keyword"), F.when(F.col("semantic_rank").isNotNull(), "semantic"))), ",")
    return fused.withColumn("matched_by", channels).orderBy(F.desc("score"), last("semantic_rank"), last("keyword_rank"), id_col).limit(top_k)
