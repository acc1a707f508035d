"""Vector bin packing of token sequences by the dot-product heuristic."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import col
from tessera.llm.wordbpe import encoder


_GONE = 1e18  #: ids of a piece that has its place


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold at most: ids, segments (pieces), and ids that bear loss."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048
    min_cut: int = 16  #: ids; a gap of at least so many is filled by cutting a waiting piece


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("loss_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()),
])


class _Pool:
    """Pieces that wait for a place, in growing arrays."""

    def __init__(self, limits: Limits) -> None:
        self.limits = limits
        self.docs: list[tuple[int | None, np.ndarray, int]] = []  # id, ids, ids at the start without loss
        self.doc, self.start, self.end = [], [], []

    def __len__(self) -> int:
        return len(self.doc)

    def add(self, doc_id: int | None, ids: np.ndarray, free: int) -> None:
        """Queue a document, cut greedily into the longest pieces that fit a sequence of their own."""
        at, n = 0, len(ids)
        self.docs.append((doc_id, ids, free))
        while at < n:
            room = self.limits.tokens
            lossless = max(0, free - at)
            end = min(n, at + room, at + lossless + self.limits.loss)
            self.doc.append(len(self.docs) - 1)
            self.start.append(at)
            self.end.append(end)
            at = end

    def pack(self, leave: int) -> Iterator[list[tuple[int, int, int]]]:
        """Sequences as lists of (document, start, end), until at most ``leave`` pieces wait."""
        lim = self.limits
        doc, start, end = (list(x) for x in (self.doc, self.start, self.end))
        frees = [self.docs[d][2] for d in doc]
        ids = np.subtract(end, start).astype(float)
        loss = np.maximum(0, np.array(end) - np.maximum(start, frees)).astype(float)
        left = len(doc)
        while left > leave:
            waiting = ids < _GONE
            mean_ids, mean_loss = ids[waiting].mean() / lim.tokens, loss[waiting].mean() / lim.loss
            room, room_loss, chosen = lim.tokens, lim.loss, []
            # Each piece is one segment, so segments add the same to all dot products of a choice.
            while left and len(chosen) < lim.segments:
                score = ids * (mean_ids * room / lim.tokens**2)
                score += loss * (mean_loss * room_loss / lim.loss**2)
                score[(ids > room) | (loss > room_loss)] = -1.0
                best = int(score.argmax())
                if score[best] < 0:
                    break
                chosen.append((doc[best], start[best], end[best]))
                room -= int(ids[best])
                room_loss -= int(loss[best])
                ids[best] = _GONE
                loss[best] = 0.0
                left -= 1
            gap = min(room, room_loss)
            if left and gap >= lim.min_cut and len(chosen) < lim.segments:
                best = int(np.where(ids < _GONE, ids, -1.0).argmax())
                gap = min(gap, end[best] - start[best])
                chosen.append((doc[best], start[best], start[best] + gap))
                start[best] += gap
                ids[best] = end[best] - start[best]
                loss[best] = max(0, end[best] - max(start[best], frees[best]))
                if start[best] == end[best]:
                    ids[best] = _GONE
                    left -= 1
            yield chosen
        keep = np.flatnonzero(ids < _GONE).tolist()
        used = sorted({doc[i] for i in keep})
        place = {d: i for i, d in enumerate(used)}
        self.docs = [self.docs[d] for d in used]
        self.doc, self.start, self.end = [place[doc[i]] for i in keep], [start[i] for i in keep], [end[i] for i in keep]


def pack_documents(
    df: DataFrame,
    *,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    lossless: str | None = None,
    limits: Limits = Limits(),
    window: int = 1024,
    with_ids: bool = False,
) -> DataFrame:
    """Pack every document into sequences; one row for each piece of a document.

    A document's ids are those of the tokenizer file, then ``end_id``; a null text is empty, so it still
    has that one id. Vector bin packing: a sequence has limits on ids, on segments and on loss-bearing
    ids, a piece takes a share of each, and a sequence is filled with the waiting piece whose demand
    has the largest dot product with the room that is left (each limit weighted by mean demand); when
    none fits, the longest waiting piece is cut to fill the gap. ``lossless`` names a column with the
    number of leading ids that bear no loss (prompts); without it, all ids bear loss.

    Each task packs the documents it has read, holding about ``window`` pieces at a time, so nothing is
    shuffled, skew in any column does not matter, and a lost task packs the same rows again alike; only
    the last sequence of a task may be short. ``sequence_id`` is unique over all tasks; ``offset`` is a
    piece's place in its sequence, from 0 without gaps. Repeated rows are packed each by itself, a null
    ``doc_id`` stays null, an empty table gives no rows, and other columns are ignored. ``with_ids``
    adds the ids themselves.
    """
    free = F.coalesce(col(lossless).cast("long"), F.lit(0)) if lossless else F.lit(0).cast("long")
    lean = df.select(col(doc_id).cast("long").alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"), free.alias("free"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, pool = encoder(tokenizer), _Pool(limits)
        end = np.array([end_id], "<u4")
        number = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def placed(leave: int) -> None:
            nonlocal number
            docs = pool.docs
            for chosen in pool.pack(leave):
                offset = 0
                for d, a, b in chosen:
                    name, ids, free = docs[d]
                    rows.append((name, a, b - a, zlib.crc32(ids[a:b].tobytes()), len(ids), max(0, b - max(a, free)), number, offset, ids[a:b] if with_ids else None))
                    offset += b - a
                number += 1

        def flush() -> pa.RecordBatch:
            columns = [pa.array(x, pa.int64()) for x in list(zip(*rows, strict=True))[:8]] if rows else [pa.array([], pa.int64())] * 8
            if with_ids:
                columns.append(pa.array([r[8].astype("int32") for r in rows], pa.list_(pa.int32())))
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            texts = (x.as_py() for x in batch.column(1))
            for name, ids, free_ in zip(batch.column(0), bpe.all_ids(texts), batch.column(2), strict=True):
                pool.add(name.as_py(), np.concatenate([ids, end]), free_.as_py())
                if len(pool) >= 2 * window:
                    placed(window)
                    if len(rows) >= 4096:
                        yield flush()
        placed(0)
        yield flush()

    schema = T.StructType([*SCHEMA.fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])
    return lean.mapInArrow(run, schema)
