"""Connected components of a link table, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, release


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for the nodes of ``links(a long, b long)``; a component is its smallest node.

    Large-star / small-star contraction: each round re-hangs every link under the smallest known
    neighbour, so the link table never grows and converges in a logarithmic number of rounds.
    Neighbour minima are aggregated before the join, so the centre of a large star is a skewed join
    key (which adaptive execution splits), never one group in one task. Self links, repeated links
    and nulls are ignored; an empty table gives an empty result.
    """
    links = (
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a is not null and b is not null and a <> b")
        .distinct()
    )
    links = materialise(links)
    before = _signature(links)
    for _ in range(max_rounds):
        links = materialise(_small_star(_large_star(links)))
        after = _signature(links)
        release(links.sparkSession)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    leaves = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(links.select("b", "b").distinct())


def _signature(links: DataFrame) -> tuple:
    row = links.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
    ).first()
    return row["n"], row["s"]


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node next to it (or the node itself)."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; links run from larger to smaller."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
