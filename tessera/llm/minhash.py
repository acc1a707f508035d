"""MinHash near-dedup: banded signatures of universal hash minima, links confirmed on whole shingle sets, and their components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, col, materialise
from tessera.llm.graph import connected_components
from tessera.llm.shingles import compared, labels, shingle_set, sketch

#: Shingles hashed at a time, members compared at a time.
_PIECE, _ROWS = 1024, 64
_MIX = np.uint64(0x9E3779B97F4A7C15)


class MinHasher:
    """The least values of many universal hash functions over a set of 64-bit hashes.

    Function i takes x to the high half of a_i x + b_i modulo 2^64, a_i odd, both drawn by the seed.
    """

    def __init__(self, bands: int, rows: int, seed: int = 42) -> None:
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 64, (bands * rows, 1), "uint64") | np.uint64(1)
        self.b = rng.integers(0, 1 << 64, (bands * rows, 1), "uint64")

    def signature(self, found: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), np.iinfo("uint64").max, "uint64")
        for at in range(0, len(found), _PIECE):
            np.minimum(least, (found[None, at : at + _PIECE] * self.a + self.b).min(axis=1), out=least)
        return (least >> np.uint64(32)).astype("uint32")

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """A key for each band of the signature: bands of equal places and values have equal keys."""
        parts = signature.reshape(self.bands, self.rows).astype("uint64")
        keys = np.arange(1, self.bands + 1, dtype="uint64")
        for i in range(self.rows):
            keys = (keys ^ parts[:, i]) * _MIX
            keys ^= keys >> np.uint64(29)
        return keys.view("int64")


def least_matches(n: int, similarity: float, deviations: float = 5.1) -> int:
    """Equal minima of ``n`` that two sets of that similarity have, but for about one pair in a million."""
    return max(1, int(n * similarity - deviations * (n * similarity * (1 - similarity)) ** 0.5))


def _signatures(lean: DataFrame, shingle: int, bands: int, rows: int, seed: int) -> DataFrame:
    """``doc_id, uid, node, n, sig, sketch, bands``: a text's set by digest, its size, its signature, its sketch and band keys (none without words)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher(bands, rows, seed)
        for batch in batches:
            nodes, sizes, signatures, sketches, keys = [], [], [], [], [np.zeros(0, "int64")]
            for raw in batch.column(2):
                found = shingle_set(raw.as_py() or b"", shingle)
                signature = hasher.signature(found)
                nodes.append(xxhash.xxh64_intdigest(found.tobytes(), len(found)))
                sizes.append(len(found))
                signatures.append(signature.tobytes())
                sketches.append(sketch(found).tobytes())
                keys.append(hasher.keys(signature) if len(found) else keys[0])
            ends = np.cumsum([len(x) for x in keys]).astype("int32")
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
            columns = [pa.array(np.array(nodes, "uint64").view("int64")), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary()), pa.array(sketches, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["doc_id", "uid", "node", "n", "sig", "sketch", "bands"])

    return lean.mapInArrow(read, "doc_id long, uid long, node long, n long, sig binary, sketch binary, bands array<long>")


def _promising(pairs: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose signatures agree in ``least`` places or more."""
    left, right = (nodes.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(c.to_pylist()), "uint32").reshape(batch.num_rows, -1) for c in batch.columns[2:])
                yield batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= least))

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b")
    return both.mapInArrow(keep, "a long, b long")


def _to_heads(held: DataFrame) -> DataFrame:
    """``a, b``: each member of a bucket with the bucket's head, each pair once.

    The head is the member that meets most others over all its buckets. The text that others were copied from shares more bands with its copies than
    they do with each other, so it is the head wherever it is.
    """
    met = held.groupBy("node").agg(F.sum("size").alias("met"))
    heads = held.join(met, "node").groupBy("key").agg(F.max(F.struct("met", "node"))["node"].alias("head"))
    pairs = held.join(heads, "key").where("node <> head")
    return pairs.select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct()


def stray_units(held: DataFrame, groups: DataFrame, unit: int) -> DataFrame:
    """``key, i, j, left, right, stray, node, group``: members of buckets in which groups meet, dealt for comparison.

    Members outside a bucket's largest group are its strays; every pair of groups has a stray. Strays and members are cut by hash into chunks of about ``unit``, and
    each chunk of strays (left) meets each chunk of members (right), so pairs inside the largest group cost nothing.
    """
    named = held.join(groups.withColumnRenamed("component", "group"), "node", "left").select("key", "node", F.coalesce("group", "node").alias("group"))
    sizes = named.groupBy("key", "group").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(
        F.sum("n").alias("all"), F.max(F.struct("n", "group")).alias("largest"), F.count(F.lit(1)).alias("groups")
    )
    mixed = sizes.where("groups > 1").select("key", F.col("largest.group").alias("major"), F.ceil(F.col("all") / unit).cast("int").alias("rights"), F.ceil((F.col("all") - F.col("largest.n")) / unit).cast("int").alias("lefts"))
    members = named.join(broadcast_if_small(materialise(mixed), F.lit(24)), "key").withColumn("stray", F.col("group") != F.col("major"))
    piece = lambda i, j, left, right: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), left.alias("left"), right.alias("right"))
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    own = lambda chunks: F.pmod(F.xxhash64("node"), F.col(chunks))
    as_right = F.transform(F.sequence(zero, F.col("lefts") - 1), lambda i: piece(i, own("rights"), no, yes))
    as_left = F.transform(F.sequence(zero, F.col("rights") - 1), lambda j: piece(own("lefts"), j, yes, no))
    pieces = F.when((F.col("rights") == 1), F.array(piece(zero, zero, F.col("stray"), yes))).when(F.col("stray"), F.concat(as_right, as_left)).otherwise(as_right)
    return members.select("key", F.explode(pieces).alias("p"), "stray", "node", "group").select("key", "p.*", "stray", "node", "group")


def _across(held: DataFrame, nodes: DataFrame, groups: DataFrame, least: int, similarity: float, unit: int, nearest: bool) -> DataFrame:
    """``a, b``: pairs of different groups that share a bucket and whose signatures, sizes and sketches allow the similarity.

    Of each stray the nearest alone, if asked. A task holds one chunk of strays and one of members.
    """
    by = ["key", "i", "j"]
    units = stray_units(held, groups, unit).join(nodes.select("node", "n", "sig", "sketch"), "node")
    dealt = units.select(*by, "left", "right", "stray", "node", "group", "n", "sig", "sketch").repartition(*by).sortWithinPartitions(*by, "node")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pd.DataFrame | None = None
        for batch in batches:
            pdf = batch.to_pandas()
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            cuts = np.flatnonzero(np.logical_or.reduce([pdf[c].to_numpy()[1:] != pdf[c].to_numpy()[:-1] for c in by])) + 1
            a, b = [], []
            for start, end in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=False):
                _unit_pairs(pdf.iloc[start:end], least, similarity, nearest, a, b)
            rest = pdf.iloc[cuts[-1] :] if len(cuts) else pdf
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        a, b = [], []
        if rest is not None and len(rest):
            _unit_pairs(rest, least, similarity, nearest, a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(search, "a long, b long").distinct()


def _apart(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ: no more than there are shingles in one set alone."""
    a, b = np.frombuffer(x, "uint64"), np.frombuffer(y, "uint64")
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _unit_pairs(pdf: pd.DataFrame, least: int, similarity: float, nearest: bool, a: list[int], b: list[int]) -> None:
    sig = np.frombuffer(b"".join(pdf["sig"]), "uint32").reshape(len(pdf), -1)
    node, group, n, stray, drawn = (pdf[c].to_numpy() for c in ("node", "group", "n", "stray", "sketch"))
    left, right = np.flatnonzero(pdf["left"].to_numpy()), np.flatnonzero(pdf["right"].to_numpy())
    for at in range(0, len(left), _ROWS):
        x = left[at : at + _ROWS]
        same = (sig[x][:, None, :] == sig[right][None, :, :]).sum(axis=2)
        able = (same >= least) & (group[x][:, None] != group[right][None, :])
        able &= np.minimum(n[x][:, None], n[right][None, :]) >= np.maximum(n[x][:, None], n[right][None, :]) * (similarity - 1e-9)
        if not nearest:  # two strays meet both ways round
            able &= ~stray[right][None, :] | (node[x][:, None] < node[right][None, :])
        for i, p in enumerate(x):
            found = np.flatnonzero(able[i])
            for j in found[np.argsort(-same[i, found], kind="stable")] if nearest else found:
                q = right[j]
                if _apart(drawn[p], drawn[q]) <= (n[p] + n[q]) * (1 - similarity) / (1 + similarity) + 1e-6:
                    a.append(int(min(node[p], node[q])))
                    b.append(int(max(node[p], node[q])))
                    if nearest:
                        break


def minhash_groups(
    df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, similarity: float = 0.85, bands: int = 32, rows: int = 4,
    seed: int = 42, unit: int = 1024,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row for each row of ``df``.

    Documents are linked if the distinct shingles they share are at least ``similarity`` of all that either has (ASCII lower
    case, words at white space; a text of fewer words is one shingle). ``component_id`` is the smallest ``doc_id`` that links reach,
    and ``kept`` tells whether it is the row's own.

    Sets become signatures of ``bands * rows`` universal hash minima; sets whose signatures agree in a whole band meet in a bucket. With 32 bands
    of 4, a pair of similarity 0.85 shares no band once in 10^10. First each member is compared with its bucket's head; where groups
    still meet in a bucket, each member outside the largest with the nearest of another group by signature; then all pairs of groups still apart. What signatures
    (but for one pair in a million) and parity sketches (always) allow is confirmed on whole sets, and links join to components by large-star and small-star
    between the steps, so that no pairs are written out inside a group that is joined.

    Documents of equal sets are one node. A text without words has no shingle, is linked with nothing, not even its like, and is its own component.
    Repeated rows give repeated rows. Rows with a null ``doc_id`` keep it, are not kept, and lend no id to their component unless it has none
    else (then it is null). An empty table gives an empty result; further columns are ignored.
    """
    if not 0.5 < similarity <= 1:
        raise ValueError("similarity must be above 0.5 and at most 1")
    lean = df.select(col(doc_id).cast("long").alias("doc_id"), F.xxhash64(col(doc_id), col(text)).alias("uid"), col(text).cast("binary").alias("raw"))
    prints = materialise(_signatures(lean, shingle, bands, rows, seed))
    nodes = materialise(prints.where("n > 0").groupBy("node").agg(F.min("uid").alias("uid"), *(F.first(c).alias(c) for c in ("n", "sig", "sketch", "bands"))))
    least = least_matches(bands * rows, similarity)
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = materialise(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    held = materialise(keyed.join(broadcast_if_small(shared, F.lit(16)), "key"))
    links = compared(_promising(_to_heads(held), nodes, least), nodes, lean, shingle, similarity)
    for nearest in (True, False):
        pairs = materialise(_across(held, nodes, labels(links), least, similarity, unit, nearest))
        if pairs.isEmpty():
            break
        links = links.unionByName(compared(pairs, nodes, lean, shingle, similarity))
    found = labels(links)
    joined = prints.select("doc_id", "n", "node").join(found, "node", "left").select("doc_id", "n", F.coalesce("component", "node").alias("component"))
    heads = joined.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("first"))
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("first"))
    out = joined.join(heads, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
