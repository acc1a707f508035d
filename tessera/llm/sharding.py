"""Byte-balanced sharding by histogram sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import col, free_name, materialise

_SPACE = 1 << 192  #: keys are (sort key, content hash, row ordinal), 64 bits each


def _keys(pdf: pd.DataFrame) -> np.ndarray:
    """Rows' 192-bit sort keys as fixed-width byte strings, which compare as unsigned numbers."""
    parts = np.empty((len(pdf), 3), ">u8")
    flip = np.uint64(1 << 63)
    parts[:, 0] = pdf["k"].to_numpy("int64").view("uint64") ^ flip
    parts[:, 1] = pdf["t"].to_numpy("int64").view("uint64") ^ flip
    parts[:, 2] = pdf["o"].to_numpy("int64").view("uint64")
    return np.ascontiguousarray(parts).view("V24").ravel()


def _rank(keys: np.ndarray, points: list[int]) -> np.ndarray:
    """For each key, how many of the sorted ``points`` are at or below it."""
    order = np.frombuffer(b"".join(p.to_bytes(24, "big") for p in points), ">u8").reshape(-1, 3)
    mine = keys.view(">u8").reshape(-1, 3)
    low, high = np.zeros(len(mine), "int64"), np.full(len(mine), len(order), "int64")
    while (active := low < high).any():
        mid = (low + high) // 2
        at = order[np.minimum(mid, len(order) - 1)]
        less = (mine[:, 0] < at[:, 0]) | (
            (mine[:, 0] == at[:, 0])
            & ((mine[:, 1] < at[:, 1]) | ((mine[:, 1] == at[:, 1]) & (mine[:, 2] < at[:, 2])))
        )
        high = np.where(active & less, mid, high)
        low = np.where(active & ~less, mid + 1, low)
    return low


def histogram_sort_shards(
    df: DataFrame,
    *,
    n_shards: int,
    key: str,
    size: str,
    tolerance: float = 0.001,
    probes: int = 15,
    shard_col: str = "shard",
    slot_col: str = "slot",
) -> DataFrame:
    """Range-partition ``df`` by ``key`` into shards of near-equal total ``size``, sorted inside.

    Splitters come from histogram sort: each round every open splitter lays ``probes`` candidate
    boundaries over the interval it is known to lie in, partitions add up the exact sizes between
    neighbouring boundaries, and the sums narrow the interval. A splitter is settled once the exact
    size below it is within ``tolerance`` of a shard from its target, or once its interval holds a
    single row. Only then do rows move, in one exchange that gives each shard its own task. What reaches the driver in a round is one
    sum for each probe.

    Equal keys are ordered by a hash of the whole row and then by an ordinal, so one key may hold any
    share of the rows and still be cut at any row. Only keys, hashes, ordinals and sizes are
    checkpointed for the rounds; the other columns are read again for the exchange. A source that deals its rows
    differently the second time changes ordinals of equal rows alone: each row still goes to one shard, in order of
    keys, and just the cut between equal rows may move. Null keys sort first; null or negative sizes count as 0. An
    empty table gives an empty result. Columns of ``df`` may have any name; ``shard_col`` and ``slot_col``
    replace columns of those names. ``slot_col`` numbers the rows of a shard from 0.
    """
    if n_shards < 1 or probes < 1:
        raise ValueError("n_shards and probes must be positive")
    df = df.drop(*({shard_col, slot_col} - {key, size}))
    at = [free_name(df, x) for x in ("place", "tie", "ordinal")]
    place = F.coalesce(col(key).cast("long"), F.lit(-(1 << 63)).cast("long"))
    rows = df.select(*map(col, df.columns), place.alias(at[0]), F.xxhash64(*map(col, df.columns)).alias(at[1]), F.monotonically_increasing_id().alias(at[2]))
    weight = F.greatest(F.coalesce(col(size).cast("long"), F.lit(0)), F.lit(0))
    lean = materialise(rows.select(*(F.col(c).alias(n) for c, n in zip(at, "kto", strict=True)), weight.alias("w")))
    splitters = _splitters(lean, n_shards, tolerance, probes)

    def shard_of(k: pd.Series, t: pd.Series, o: pd.Series) -> pd.Series:
        return pd.Series(_rank(_keys(pd.DataFrame({"k": k, "t": t, "o": o})), splitters).astype("int32"))

    shard = F.pandas_udf(shard_of, "int")(*at) if splitters else F.lit(0)
    dealt = rows.withColumn(shard_col, shard).repartitionById(n_shards, col(shard_col))
    inside = Window.partitionBy(col(shard_col)).orderBy(*at)
    return dealt.withColumn(slot_col, (F.row_number().over(inside) - 1).cast("long")).drop(*at)


def _splitters(lean: DataFrame, n_shards: int, tolerance: float, probes: int) -> list[int]:
    ends = lean.agg(F.sum("w").alias("total"), F.min("k").alias("low"), F.max("k").alias("high"), F.count(F.lit(1)).alias("n")).first()
    if not ends["n"] or n_shards == 1:
        return []
    total, half = ends["total"], 1 << 63
    floor, ceiling = (ends["low"] + half) << 128, min(_SPACE - 1, (ends["high"] + half + 1) << 128)
    goals = [total * i // n_shards for i in range(1, n_shards)]
    slack = tolerance * total / n_shards
    # For each splitter: a boundary at or below it, one above it, and the exact sizes and rows below both.
    spans = [[floor, ceiling, (0, 0), (total, ends["n"])] for _ in goals]
    chosen: list[int | None] = [None] * len(goals)
    while any(c is None for c in chosen):
        points = set()
        for i, (low, high, *_) in enumerate(spans):
            if chosen[i] is None:
                step = max(1, (high - low) // (probes + 1))
                points.update(range(low + step, high, step) if high - low <= probes * 2 else (low + step * j for j in range(1, probes + 1)))
        points = sorted(points)
        below = _sizes_below(lean, points) if points else {}
        for i, goal in enumerate(goals):
            if chosen[i] is not None:
                continue
            span = spans[i]
            for p in points:
                if span[0] < p < span[1]:
                    if below[p][0] <= goal:
                        span[0], span[2] = p, below[p]
                    else:
                        span[1], span[3] = p, below[p]
                        break
            best = min((goal - span[2][0], span[0]), (span[3][0] - goal, span[1]))
            if best[0] <= slack or span[3][1] - span[2][1] <= 1 or span[1] - span[0] <= 1:
                chosen[i] = best[1]
    return sorted(c for c in chosen if c is not None)


def _sizes_below(lean: DataFrame, points: list[int]) -> dict[int, tuple[int, int]]:
    """Exact size and number of all rows whose key is below each point."""

    def histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, rows = np.zeros(len(points) + 1, "int64"), np.zeros(len(points) + 1, "int64")
        for pdf in batches:
            ranks = _rank(_keys(pdf), points)
            np.add.at(sums, ranks, pdf["w"].to_numpy())
            np.add.at(rows, ranks, 1)
        at = np.flatnonzero(rows)
        yield pd.DataFrame({"bin": at.astype("int64"), "w": sums[at], "n": rows[at]})

    found = lean.mapInPandas(histogram, "bin long, w long, n long").groupBy("bin").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).collect()
    sums = np.zeros((len(points) + 1, 2), "int64")
    for row in found:
        sums[row["bin"]] = row["w"], row["n"]
    return dict(zip(points, map(tuple, np.cumsum(sums, axis=0)[:-1].tolist()), strict=True))
