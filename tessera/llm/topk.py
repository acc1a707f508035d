"""Exact top-k inner products, pruned by segment statistics from coarse to fine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import col, materialise

_ROWS = 128  #: queries that are held against a block of candidates at a time
_PAIRS = 1 << 12  #: pairs whose products are held at a time: their rows fit a core's cache
_EDGE = 1.7e308  #: of doubles, about
_MOST = (1 << 63) - 1


def quantised(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id, v array<double>``: components as floor(scale * x), whole numbers; unusable vectors are left out.

    Unusable are null and empty vectors and those with a null or non-finite component, and rows without
    an id. Where scale * x would pass the range of a double, it is the range's end (1.7e308).
    """
    whole = F.transform(col(vector), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # Beyond 2^53 doubles are whole numbers.
    scaled = lambda x: F.when(F.abs(x) < 2.0**44, F.floor(x * scale).cast("double")).otherwise(F.least(F.lit(_EDGE), F.greatest(F.lit(-_EDGE), x * scale)))
    return (
        vectors.select(col(vec_id).cast("long").alias("vec_id"), whole.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)
        .select("vec_id", F.transform("v", scaled).alias("v"))
    )


def levels(dims: int) -> list[int]:
    """Numbers of segments, coarse to fine: 1, 4, 16, ..., and at last segments of two components."""
    counts = [n for n in (4**i for i in range(16)) if n < max(2, dims // 2)]
    return [*counts, dims // 2] if dims > 3 else counts


def statistics(v: np.ndarray) -> np.ndarray:
    """Of all levels in turn, per segment: its mean and its deviation, times the root of its length.

    The inner product of two vectors' statistics of a level is at least their own: over a segment it is
    length * (mean * mean) plus the product of the deviations' norms (Cauchy-Schwarz). In terms of
    distances, the statistics' distance is at most the vectors' distance.
    """
    parts = []
    for segments in levels(v.shape[1]):
        for block in np.array_split(v, segments, axis=1):
            mean = block.mean(axis=1)
            root = np.sqrt(block.shape[1])
            parts += [mean * root, np.sqrt(np.maximum(0.0, ((block - mean[:, None]) ** 2).sum(axis=1)))]
    return np.stack(parts, axis=1)


def _products(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows ``i`` of ``q`` and ``j`` of ``c``."""
    parts = [np.einsum("ij,ij->i", q[i[a : a + _PAIRS]], c[j[a : a + _PAIRS]]) for a in range(0, len(i), _PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0)


def block_top(q: np.ndarray, qid: np.ndarray, qs: np.ndarray, c: np.ndarray, cid: np.ndarray, cs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Best ``k`` of ``c`` for each row of ``q``: query ids, candidate ids and scores; and how many pairs were scored.

    ``qs`` and ``cs`` are the rows' ``statistics``. On each level, the candidates of the highest bounds are scored first;
    the k-th best of them is the bar that others' bounds must reach to go on to the finer level.
    """
    dims = q.shape[1]
    counts = levels(dims)
    ends = np.cumsum([0, *(2 * n for n in counts)])
    slack = 2e-6 * (1.0 + float(np.sqrt((q * q).sum(axis=1).max(initial=0)) * np.sqrt((c * c).sum(axis=1).max(initial=0))))
    some, scored = min(len(c), 4 * k), 0
    whos, names, values = [], [], []
    for at in range(0, len(q), _ROWS):
        mine, ids = q[at : at + _ROWS], qid[at : at + _ROWS]
        # Of the candidates in ``columns``, those that each query still has.
        alive, columns = ids[:, None] != cid[None, :], np.arange(len(c))
        bar = np.full(len(mine), -np.inf)
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            left = alive.any(axis=0)
            if not left.all():
                alive, columns = alive[:, left], columns[left]
            bound = qs[at : at + _ROWS, a:b] @ cs[columns, a:b].T
            bound[~alive] = -np.inf
            if some < len(columns):
                best = np.argpartition(-bound, some - 1, axis=1)[:, :some]
                i = np.repeat(np.arange(len(mine)), some)
                j = columns[best.ravel()]
                exact = np.where(ids[i] != cid[j], _products(mine, c, i, j), -np.inf).reshape(len(mine), some)
                scored += len(i)
                bar = np.maximum(bar, -np.partition(-exact, k - 1, axis=1)[:, k - 1])
            alive &= bound >= (bar - slack)[:, None]
        i, j = np.nonzero(alive)
        j = columns[j]
        exact = _products(mine, c, i, j)
        scored += len(i)
        reach = exact >= bar[i]  # only these are ranked
        i, j, exact = i[reach], j[reach], exact[reach]
        rank = np.lexsort((cid[j], -exact, i))
        i, j, exact = i[rank], j[rank], exact[rank]
        first = np.searchsorted(i, np.arange(len(mine)))
        best = np.arange(len(i)) - first[i] < k
        whos.append(ids[i[best]])
        names.append(cid[j[best]])
        values.append(exact[best])
    return np.concatenate(whos), np.concatenate(names), np.concatenate(values), scored


def _wide_top(q: np.ndarray, qid: np.ndarray, c: np.ndarray, cid: np.ndarray, k: int) -> tuple[list, list, list]:
    """As ``block_top`` for whole numbers whose products pass the exact range of doubles: in integers of any size."""
    rows = [[int(x) for x in r] for r in c]
    out: tuple[list, list, list] = ([], [], [])
    for who, vector in zip(qid.tolist(), q, strict=True):
        mine = [int(x) for x in vector]
        scores = (max(-_MOST, min(_MOST, sum(map(int.__mul__, mine, r)))) for r in rows)
        for score, name in sorted((-s, n) for s, n in zip(scores, cid.tolist(), strict=True) if n != who)[:k]:
            out[0].append(who)
            out[1].append(name)
            out[2].append(-score)
    return out


def exact_top_k(vectors: DataFrame, *, queries: Column, k: int = 5, query_block: int = 2048, candidate_block: int = 16_384) -> DataFrame:
    """``query_id, rank int, vec_id, score long`` from ``vectors(vec_id long, v array<double>)``, whole numbers.

    Queries are the rows that the condition ``queries`` holds for; candidates are all rows with another id.
    Ties go to the smaller id; a query with fewer than ``k`` candidates returns all. Statistics of each vector are
    computed once. Queries and candidates are dealt into blocks of about the stated sizes, round robin, so repeated ids or
    vectors weigh on no block; each pair of blocks is one task's work. In it, bounds from the means and
    deviations of 1, 4, 16, ... segments and of pairs of components discard candidates below a query's standing k-th score, and
    only the survivors' scores are computed. Only each block's best ``k`` rows for a query go on to the
    final ranking. Scores are exact: blocks whose products may pass 2^52 are compared in integers of any size, without bounds;
    a score beyond 64 bits counts as the nearest long. Vectors of different lengths are not compared; rows that repeat an id
    are candidates each by itself, and repeated queries give the rows of one. An empty table gives no rows.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).to_pylist()
            rows: list = [None] * len(lists)
            for d in set(map(len, lists)):
                at = [i for i, x in enumerate(lists) if len(x) == d]
                with np.errstate(all="ignore"):  # what overflows here is compared without bounds
                    found = statistics(np.array([lists[i] for i in at])).astype("float32")
                for i, row in zip(at, found, strict=True):
                    rows[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float32()))], names=["vec_id", "v", "s"])

    measured = vectors.select("vec_id", F.col("v").cast("array<double>").alias("v")).mapInArrow(measure, "vec_id long, v array<double>, s array<float>")
    vectors = materialise(measured.withColumn("d", F.size("v")))
    asked = materialise(vectors.where(queries).dropDuplicates(["vec_id", "v"]))
    n_c, n_q = max(1, -(-vectors.count() // candidate_block)), max(1, -(-asked.count() // query_block))

    def dealt(df: DataFrame, n: int, name: str) -> DataFrame:
        """Rows with a block number, even whatever their values: blocks follow places in their partition."""
        place = F.monotonically_increasing_id()
        return df.withColumn(name, F.pmod(F.shiftright(place, 33) * 7919 + place.bitwiseAND((1 << 33) - 1), F.lit(n)).cast("int"))

    ours = materialise(dealt(asked, n_q, "qb")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
    theirs = materialise(dealt(vectors, n_c, "cb")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        q, c = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        qid, cid = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        if float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] >= 2.0**52:
            who, name, score = _wide_top(q, qid, c, cid, k)
        else:
            qs, cs = (np.stack(x["s"].to_numpy()).astype("float64") for x in (left, right))
            who, name, score, _ = block_top(q, qid, qs, c, cid, cs, k)
        return pd.DataFrame({"query_id": who, "vec_id": name, "score": np.array(score, "int64")})

    keys = ["d", "qb", "cb"]
    best = ours.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInPandas(pair, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
