"""Near-duplicate lines by a deletion-neighbourhood join over words; the earliest line stays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import broadcast_if_small, col, free_name, map_arrow, materialise, only_columns

_MIX = 0x9E3779B97F4A7C15  #: odd, so powers of it never vanish modulo 2^64


def within_one_edit(a: list, b: list) -> bool:
    """Whether one word put in, left out or replaced at most turns ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate((np.ones(1, "uint64"), np.full(n, _MIX, "uint64"))))


def deletion_keys(hashes: np.ndarray, first: int, last: int) -> tuple[np.ndarray, int]:
    """Hashes of a line without its word ``first``, ..., ``last - 1``, and of the whole line.

    The hash of words h0, h1, ... is the sum of h_i * M^i modulo 2^64; leaving out word i
    shifts those behind it down by one power, which prefix and suffix sums give in one pass.
    """
    n = len(hashes)
    power = _powers(n)
    before = np.concatenate((np.zeros(1, "uint64"), np.add.accumulate(hashes * power[:n])))
    shifted = np.concatenate((np.zeros(1, "uint64"), np.add.accumulate(hashes[1:] * power[: n - 1])))
    at = np.arange(first, last)
    return before[at] + (shifted[n - 1] - shifted[at]), int(before[n])


def _lines(df: DataFrame, doc: str, text: str, min_words: int) -> DataFrame:
    """``h, doc, uid, line_no, keys`` of every line with a word; ``uid`` stands for id and text.

    ``h`` is the hash of the line's words. Two lines within one edit share one of their ``keys``: of as many
    words as the shorter one has, the first or the last half is untouched. Lines of under ``min_words`` have none.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            docs, lines, hashes, keys = [], [], [], []

            def made() -> pa.RecordBatch:
                at = pa.array(docs, pa.int64())
                flat = pa.array(np.array(keys, "uint64").view("int64"))
                ends = pa.array(np.arange(0, 4 * len(docs) + 1, 4, dtype="int32"))
                columns = [pa.array(np.array(hashes, "uint64").view("int64")), batch.column(0).take(at), batch.column(1).take(at), pa.array(lines, pa.int32()), pa.ListArray.from_arrays(ends, flat)]  # noqa: B023
                return pa.RecordBatch.from_arrays(columns, names=["h", "doc", "uid", "line_no", "keys"])

            for i, raw in enumerate(batch.column(2)):
                for number, line in enumerate((raw.as_py() or b"").split(b"\n")):
                    w = line.split()
                    if not w:
                        continue
                    docs.append(i)
                    lines.append(number)
                    hashes.append(digest(b" ".join(w), 7))
                    if len(w) < min_words:
                        keys += 4 * [hashes[-1]]  # its own alone
                        continue
                    for short in (len(w), len(w) - 1):
                        half = short // 2
                        keys.append(digest(b" ".join(w[:half]), 2 * short))
                        keys.append(digest(b" ".join(w[len(w) - half :]), 2 * short + 1))
                if len(docs) >= 100_000:
                    yield made()
                    docs, lines, hashes, keys = [], [], [], []
            yield made()

    lean = df.select(
        col(doc).cast("long").alias("doc"), F.xxhash64(col(doc), col(text)).alias("uid"), col(text).cast("binary").alias("t")
    ).where(F.col("t").isNotNull())
    return lean.mapInArrow(read, "h long, doc long, uid long, line_no int, keys array<long>")


def _wanted_lines(df: DataFrame, doc: str, text: str, wanted: DataFrame) -> DataFrame:
    """``h, doc, line_no, line`` of the lines that ``wanted(h, doc, uid, line_no)`` names.

    Broadcast while they measure small, else joined by an exchange.
    """
    lists = wanted.groupBy("uid").agg(F.collect_list(F.struct("line_no", "h")).alias("wanted"))
    lists = broadcast_if_small(materialise(lists), 16 * F.size("wanted"))
    lean = df.select(F.xxhash64(col(doc), col(text)).alias("uid"), col(doc).cast("long").alias("doc"), col(text).alias("t"))
    found = lean.join(lists, "uid").select("doc", F.split("t", "\n").alias("lines"), F.explode("wanted").alias("x"))
    return found.select(F.col("x.h").alias("h"), "doc", F.col("x.line_no").alias("line_no"), F.get("lines", F.col("x.line_no")).alias("line"))


def _variants(lines: DataFrame) -> DataFrame:
    """``key, at, h, doc, line_no``: hashed deletion variants (``at`` >= 0) and whole lines (-1)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, doc, line_no, texts = (batch.column(i) for i in range(4))
            keys, ats, rows, held = [], [], [], 0
            for i in range(len(batch)):
                w = texts[i].as_py().encode().split()
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, w), "uint64", len(w))
                n = len(hashes)
                found, whole = deletion_keys(hashes, 0, n)
                # A variant of n words goes by its own length, so that it meets the whole lines of n - 1 words.
                keys += [found ^ np.uint64((n - 1) * 0xD6E8FEB86659FD93 % (1 << 64)), np.array([whole], "uint64") ^ np.uint64(n * 0xD6E8FEB86659FD93 % (1 << 64))]
                ats.append(np.append(np.arange(n), -1))
                rows.append(np.full(n + 1, i))
                held += n + 1
                if held >= 200_000 or i == len(batch) - 1:
                    take = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys).view("int64")), pa.array(np.concatenate(ats).astype("int32")), h.take(take), doc.take(take), line_no.take(take)],
                        names=["key", "at", "h", "doc", "line_no"],
                    )
                    keys, ats, rows, held = [], [], [], 0

    return lines.select("h", "doc", "line_no", "line").mapInArrow(emit, "key long, at int, h long, doc long, line_no int")


def _verified(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([within_one_edit(x.encode().split(), y.encode().split()) for x, y in zip(a, b, strict=True)], dtype=bool)


def kept_lines(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = 5) -> DataFrame:
    """``doc, line_no, uid`` of the lines with a word that stay."""
    # Flat columns: nested ones would take nearly twice the room in the checkpoint.
    firsts = materialise(
        _lines(df, doc_id, text, min_words)
        .groupBy("h").agg(F.min(F.struct("doc", "line_no", "uid")).alias("o"), F.first("keys").alias("keys"))
        .select("h", "o.*", *(F.get("keys", F.lit(i)).alias(f"key{i}") for i in range(4)))
    )
    place = ["doc", "line_no", "uid"]
    keyed = firsts.where("key0 <> h").select("h", F.explode(F.array_distinct(F.array(*(f"key{i}" for i in range(4))))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    rivals = keyed.join(shared, "key", "left_semi").select("h").distinct()
    wanted = firsts.select("h", *place).join(rivals, "h", "left_semi")
    rows = materialise(_wanted_lines(df, doc_id, text, wanted).dropDuplicates(["h"]))
    # Minima by key are sums over the partitions, so one key may hold any share of the variants; only keys that meet go on.
    variants = _variants(rows)
    meet = materialise(variants.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    held = materialise(variants.join(broadcast_if_small(meet, F.lit(8)), "key").select("key", "at", F.struct("doc", "line_no", "h").alias("me")))
    # Lines that lack the same word in the same place are one edit apart, and so is each of them from the
    # whole line that is left without it.
    alike = held.groupBy("key", "at").agg(F.min("me").alias("alike"))
    by_key = alike.groupBy(F.col("key").alias("k")).agg(F.min(F.when(F.col("at") < 0, F.col("alike"))).alias("whole"), F.min("alike").alias("least"))
    best = alike.join(by_key, F.col("key") == F.col("k")).select(
        "key", "at", F.when(F.col("at") < 0, F.col("least")).otherwise(F.least("alike", F.coalesce("whole", "alike"))).alias("best")
    )
    met = held.join(best, ["key", "at"]).where(F.col("best") < F.col("me")).select(F.col("me.h").alias("h"), F.col("best.h").alias("earlier")).distinct()
    pairs = (
        met.join(rows.select("h", F.col("line").alias("a")), "h")
        .join(rows.select(F.col("h").alias("earlier"), F.col("line").alias("b")), "earlier")
        .where(F.pandas_udf(_verified, "boolean")("a", "b"))
    )
    gone = pairs.select("h").distinct()
    return firsts.join(gone, "h", "left_anti").select(*place)


def dedup_lines(
    df: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    min_words: int = 5,
    counts: tuple[str, str] | None = None,
    drop_emptied: bool = False,
) -> DataFrame:
    """``df`` with every line left out of ``text`` that an earlier line of the corpus matches.

    Lines match if their words are the same; lines of at least ``min_words`` = 5 words also if one word put in, left out
    or replaced makes them the same (so their similarity is 0.8 or more). Earlier means by document id (null first),
    then by line number. A line goes if any earlier line matches it, be that one kept or not. Lines without a word always stay.

    Equal lines are first folded into their earliest. Of the rest, those that share the hash of an
    untouched half with another line emit hashed keys for all variants with one word deleted; equal
    variants meet, the earliest of them is found without writing out pairs, and each line's edit distance to
    it is verified on the words. ``counts`` names two columns to add: lines of the text, and lines left out.
    ``drop_emptied`` leaves out documents all of whose words went with their lines.

    A null text stays null (0 lines); an empty text has one empty line. Rows that repeat both id and text are one document
    and stay alike. Other columns stay as they are; an empty table gives no rows.
    """
    uid, mine, keep = (free_name(df, x) for x in ("uid", "mine", "keep"))
    stay = kept_lines(df, doc_id=doc_id, text=text, min_words=min_words)
    lists = stay.groupBy(F.col("uid").alias(mine)).agg(F.collect_set("line_no").alias(keep))
    keyed = df.withColumn(uid, F.xxhash64(col(doc_id), col(text)))
    joined = keyed.join(lists, keyed[uid] == lists[mine], "left").select(*map(col, df.columns), keep)
    place = df.columns.index(text)
    given = only_columns(df, drop=counts or ())
    names = given + list(counts or ())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, lost, stays = [], [], [], []
            for raw, kept in zip(batch.column(place), batch.column(batch.num_columns - 1), strict=True):
                raw, kept = raw.as_py(), set(kept.as_py() or ())
                lines = [] if raw is None else raw.split("\n")
                left = [x for i, x in enumerate(lines) if i in kept or not x.encode().split()]
                texts.append(None if raw is None else "\n".join(left))
                totals.append(len(lines))
                lost.append(len(lines) - len(left))
                stays.append(not (drop_emptied and len(left) < len(lines) and not any(x.encode().split() for x in left)))
            found = dict(zip(df_columns, batch.columns, strict=False)) | {text: pa.array(texts, pa.string())}
            if counts:
                found |= {counts[0]: pa.array(totals, pa.int64()), counts[1]: pa.array(lost, pa.int64())}
            yield pa.RecordBatch.from_arrays([found[c] for c in names], names=names).filter(pa.array(stays, pa.bool_()))

    df_columns = df.columns
    fields = [df.schema[c] for c in given]
    schema = T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in counts or ())])
    return map_arrow(joined, read, schema)
