"""SimHash fingerprints and their near-duplicate groups, found with BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import col, free_name, map_arrow, materialise, only_columns
from tessera.llm.graph import connected_components

#: Shingle hashes that a task holds at a time.
_PIECE = 65_536


def simhash(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a UTF-8 text: ASCII lower case, white-space words, word shingles, repeats counted.

    A bit is 1 if it is set in over half the shingle hashes; a text without words has fingerprint 0.
    """
    parts = text.lower().split()
    if not parts:
        return 0
    if len(parts) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(parts), seed)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), "int64", len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = starts[: len(parts) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    counts = np.zeros(64, "int64")
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _PIECE):
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[at : at + _PIECE], ends[at : at + _PIECE], strict=True)]
        counts += _set_bits(np.array(hashes, "uint64"))
    return _over_half(counts, len(starts))


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """In how many of the hashes each bit is set, the highest bit first."""
    return np.unpackbits(hashes.astype(">u8").view("uint8").reshape(-1, 8), axis=1).sum(axis=0, dtype="int64")


def _over_half(counts: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint_of(hashes: np.ndarray) -> int:
    """SimHash of the hashes of a text's shingles."""
    parts = (_set_bits(hashes[at : at + _PIECE]) for at in range(0, len(hashes), _PIECE))
    return _over_half(sum(parts, np.zeros(64, "int64")), len(hashes))


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp", shingle: int = 3) -> DataFrame:
    """``df`` with its text column replaced by the fingerprint ``out`` (long: the 64 bits, signed).

    A null text counts as empty. ``out`` replaces a column of that name.
    """
    raw = free_name(df, "raw")
    rest = only_columns(df, drop=(text, out))
    lean = df.select(*(col(c) for c in rest), col(text).cast("binary").alias(raw))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            found = np.fromiter((simhash(x.as_py() or b"", shingle) for x in column), "uint64", len(column))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found.view("int64"))], names=[*rest, out]
            )

    schema = lean.drop(raw).schema.add(out, "long")
    return map_arrow(lean, add, schema)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


class BKTree:
    """Integers in a tree whose edges carry the Hamming distance between child and parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at = 0
        self.values.append(value)
        self.children.append({})
        if len(self.values) == 1:
            return
        while True:
            edge = (value ^ self.values[at]).bit_count()
            child = self.children[at].setdefault(edge, len(self.values) - 1)
            if child == len(self.values) - 1:
                return
            at = child

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the stored values at most ``radius`` bits from ``value``."""
        found, stack = [], [0] if self.values else []
        values, children = self.values, self.children
        while stack:
            at = stack.pop()
            distance = (value ^ values[at]).bit_count()
            if distance <= radius:
                found.append(at)
            for edge, child in children[at].items():
                if distance - radius <= edge <= distance + radius:
                    stack.append(child)
        return found


def _band_masks(bits: list[int], radius: int, blocks: int) -> list[int]:
    """Masks within the places ``bits``, of which at least one covers equal bits in any two values within ``radius`` bits."""
    edges = [round(len(bits) * i / blocks) for i in range(blocks + 1)]
    block = [sum(1 << x for x in bits[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(block[i] for i in kept) for kept in combinations(range(blocks), blocks - radius)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_links(fps: DataFrame, radius: int = 3, blocks: int = 5, tree_size: int = 2048) -> DataFrame:
    """Links ``a, b`` that connect all distinct fingerprints ``fp`` at most ``radius`` bits apart.

    Shards are band keys: of ``blocks`` blocks of bits, two fingerprints within ``radius`` agree on at
    least ``blocks - radius``, so every near pair meets in the shard of one such choice of blocks.
    Shards of one fingerprint go. A shard of more than ``tree_size`` is split by further blocks of the bits that its
    band leaves free, in the same way. What is still larger is cut into chunks by hash; each
    chunk has one BK-tree, which every chunk of the same shard meets (so a tree of bounded size is
    all that a task holds beside the chunk it compares). Trees are searched along the edges within
    the radius; of the links found a task keeps those that join two groups it has not yet joined,
    which loses no connection and never writes out all pairs.
    """
    if not 0 <= radius < blocks <= 64:
        raise ValueError("blocks must exceed the radius")
    masks = _band_masks(list(range(64)), radius, blocks)
    keys = F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks))
    held = _shards(fps.select("fp", F.posexplode(keys).alias("band", "key")))
    hot = held.where(F.col("n") > tree_size)
    if not hot.isEmpty():
        free = [[i for i in range(64) if not m >> i & 1] for m in masks]
        finer = [[_signed(m | x) for x in _band_masks(places, radius, min(blocks, len(places)))] if len(places) > radius else [-1] for m, places in zip(masks, free, strict=True)]
        width = max(map(len, finer))
        of_band = F.element_at(F.lit(finer), F.col("band") + 1)
        split = hot.select("fp", "band", F.posexplode(F.transform(of_band, lambda m: F.col("fp").bitwiseAND(m))).alias("place", "key"))
        split = _shards(split.select("fp", (len(masks) + F.col("band") * width + F.col("place")).alias("band"), "key"))
        held = held.where(F.col("n") <= tree_size).unionByName(split)
    held = held.withColumn("chunks", F.ceil(F.col("n") / tree_size).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    units = (
        held.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")
    )
    unit = ["band", "key", "i", "j"]
    dealt = units.repartition(*unit).sortWithinPartitions(*unit, "own", "fp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pd.DataFrame | None = None
        for batch in batches:
            pdf = batch.to_pandas()
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            cols = [pdf[c].to_numpy() for c in unit]
            cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            rest = pdf.iloc[last:]
            yield _linked(pdf.iloc[:last], np.concatenate(([0], cuts)) if last else np.array([0]), radius)
        if rest is not None:
            yield _linked(rest, np.array([0, len(rest)]), radius)

    return dealt.mapInArrow(search, "a long, b long").distinct()


def _shards(banded: DataFrame) -> DataFrame:
    """``banded(fp, band, key)`` with ``n``, the size of a row's shard, where that is over 1."""
    sizes = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return banded.join(sizes, ["band", "key"]).select("fp", "band", "key", "n")


def _linked(pdf: pd.DataFrame, cuts: np.ndarray, radius: int) -> pa.RecordBatch:
    fp, own, second = pdf["fp"].to_numpy(), pdf["own"].to_numpy(), pdf["j"].to_numpy()
    a: list[int] = []
    b: list[int] = []
    for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        values = fp[start:end].view("uint64").tolist()
        if end - start == 2:
            pairs = [(0, 1)] if (values[0] ^ values[1]).bit_count() <= radius else []
        else:
            pairs = _unit_links(values, own[start:end] == second[start:end], radius)
        for x, y in pairs:
            a.append(int(fp[start + x]))
            b.append(int(fp[start + y]))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _unit_links(values: list[int], late: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning links inside a chunk (all rows alike), or between the two chunks of a unit."""
    parent = list(range(len(values)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    tree, links = BKTree(), []
    alone = bool(late.all())
    first = [] if alone else np.flatnonzero(~late).tolist()
    for x in first:
        tree.add(values[x])
    for x in range(len(values)) if alone else np.flatnonzero(late).tolist():
        for y in tree.within(values[x], radius):
            y = y if alone else first[y]
            p, q = root(x), root(y)
            if p != q:
                parent[p] = q
                links.append((x, y))
        if alone:
            tree.add(values[x])
    return links


def simhash_groups(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """``doc_id, fp, component_id``: one row for each row of ``df``.

    Documents with equal fingerprints are one node; nodes at most ``radius`` bits apart are linked,
    and ``component_id`` is the smallest ``doc_id`` that links reach. Null and blank texts have
    fingerprint 0 and are linked like any other. Repeated rows give repeated rows. Rows with a null
    ``doc_id`` keep it, and lend no id to their component unless it has none else (then it is null).
    An empty table gives an empty result; further columns are ignored.
    """
    lean = df.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text"))
    prints = materialise(fingerprints(lean, shingle=shingle))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    nodes = materialise(nodes)
    found = connected_components(near_links(nodes.select("fp"), radius))
    joined = nodes.join(found, nodes["fp"] == found["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    heads = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    of_print = joined.join(heads, "component").select("fp", "component_id")
    return prints.join(of_print, "fp", "left").select("doc_id", "fp", "component_id")
