"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, col, materialise

_BUCKETS = 4096


def water_fill(sizes: list[float], weights: list[float], total: float, cap: float) -> list[float]:
    """Targets in proportion to ``weights`` that add up to ``total``, none above ``cap`` times its size.

    Each round clamps the sources above their cap and shares what they leave among the rest by weight,
    until none is above. Where all are clamped, the targets add up to less than ``total``.
    """
    targets, clamped = [0.0] * len(sizes), [False] * len(sizes)
    while True:
        rest = total - sum(cap * s for s, c in zip(sizes, clamped, strict=True) if c)
        weight = sum(w for w, c in zip(weights, clamped, strict=True) if not c)
        level = max(0.0, rest) / weight if weight > 0 else 0.0
        targets = [cap * s if c else level * w for s, w, c in zip(sizes, weights, clamped, strict=True)]
        above = [i for i, (t, s) in enumerate(zip(targets, sizes, strict=True)) if not clamped[i] and t > cap * s]
        if not above:
            return targets
        for i in above:
            clamped[i] = True


def mix_sources(
    df: DataFrame,
    *,
    size: str = "size",
    source: str = "source",
    key: str = "doc_id",
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    max_epochs: float = 3.0,
    seed: int = 42,
    max_sources: int = 1_000_000,
) -> DataFrame:
    """``df`` plus ``source_size long, target double, repeats int, taken long``.

    Sources in code-point order, null last, weigh ``weights`` in turn, and share the total of all sizes;
    water-filling clamps each at ``max_epochs`` times its own size. A document is taken ``repeats``
    whole times (the whole epochs of its source), and the fraction that is left of an epoch is
    sampled: documents in the order of a seeded hash of their key are taken once more, and the one at
    which the target is reached is taken in part, so ``taken`` of a source adds up to its target rounded
    to a whole. Reruns agree.

    The driver sees one row for each source (an error beyond ``max_sources``). The sample's threshold is
    found from sizes added up over hash ranges of each source, so only the documents of one such range, a
    4096th of the source, are ever ordered. Null or negative sizes count as 0. Equal hashes (repeated
    keys) are ordered by their size; rows without a key are hashed by their values and place, so that they spread too. Tables of
    sources are broadcast while they measure small. ``df`` is read again, so it should be a stored table; columns of the
    names above are replaced; an empty table gives no rows.
    """
    made = ("source_size", "target", "repeats", "taken")
    given = [c for c in df.columns if c.lower() not in made]
    spark: SparkSession = df.sparkSession
    # Callers' columns travel in one struct, so that none clashes with a working column.
    point = F.when(col(key).isNotNull(), F.xxhash64(F.lit(seed), col(key))).otherwise(F.xxhash64(F.lit(seed), *map(col, df.columns), F.monotonically_increasing_id()))
    rows = df.select(
        F.struct(*map(col, given)).alias("row"), col(source).alias("of"), point.alias("h"), F.greatest(F.coalesce(col(size).cast("long"), F.lit(0)), F.lit(0)).alias("n")
    ).withColumn("bucket", F.shiftrightunsigned("h", 52).cast("int"))
    ranges = materialise(rows.groupBy(F.col("of").alias("source"), "bucket").agg(F.sum("n").alias("n")))
    sums = ranges.groupBy("source").agg(F.sum("n").alias("n")).limit(max_sources + 1).collect()
    if len(sums) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sums = sorted(sums, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["n"] for r in sums]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sums))], float(sum(sizes)), max_epochs)
    plan = []
    for row, target in zip(sums, targets, strict=True):
        whole, words = (divmod(round(target), row["n"]) if row["n"] else (0, 0))
        plan.append((row["source"], row["n"], target, int(whole), int(words)))
    schema = "source string, source_size long, target double, whole int, words long"
    goals = spark.createDataFrame(plan, schema)
    width = F.octet_length(F.coalesce("source", F.lit(""))) + 32
    before = Window.partitionBy("source").orderBy("bucket")
    edges = (
        ranges.withColumn("below", F.sum("n").over(before) - F.col("n"))
        .join(broadcast_if_small(goals, width), ranges["source"].eqNullSafe(goals["source"]))
        .where((F.col("below") <= F.col("words")) & (F.col("words") < F.col("below") + F.col("n")))
        .select(ranges["source"].alias("source"), F.col("bucket").alias("edge"), (F.col("words") - F.col("below")).alias("room"))
    )
    limits = materialise(goals.join(edges, goals["source"].eqNullSafe(edges["source"]), "left").select(
        goals["source"].alias("label"), "source_size", "target", "whole", "edge", "room"
    ))
    joined = rows.join(broadcast_if_small(limits, F.octet_length(F.coalesce("label", F.lit(""))) + 48), rows["of"].eqNullSafe(limits["label"]))
    at_edge = F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False))
    below = F.coalesce(F.col("bucket") < F.col("edge"), F.lit(False))
    plain = joined.where(~at_edge).withColumn("more", F.when(below, F.col("n")).otherwise(F.lit(0)))
    so_far = F.sum("n").over(Window.partitionBy("label").orderBy("h", "n").rowsBetween(Window.unboundedPreceding, -1))
    edge = joined.where(at_edge).withColumn("more", F.greatest(F.lit(0), F.least(F.col("n"), F.col("room") - F.coalesce(so_far, F.lit(0)))))
    return plain.unionByName(edge).select(
        *(F.col("row").getField(c).alias(c) for c in given),
        "source_size",
        "target",
        (F.col("whole") + F.when((F.col("more") == F.col("n")) & (F.col("n") > 0), 1).otherwise(0)).cast("int").alias("repeats"),
        (F.col("whole") * F.col("n") + F.col("more")).cast("long").alias("taken"),
    )
