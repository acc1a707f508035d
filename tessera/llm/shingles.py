"""SimHash near-dedup to a similarity: groups of documents that share at least a given part of their word shingles, found exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, col, hash_sample, materialise
from tessera.llm.graph import connected_components
from tessera.llm.simhash import fingerprint_of, near_links

_MIX = 0x9E3779B97F4A7C15


def shingle_set(text: bytes, shingle: int = 5) -> np.ndarray:
    """The distinct hashes of a UTF-8 text's word shingles, sorted; words as in ``simhash``.

    A text of fewer words has one shingle of them all, a text without words none.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, "uint64")
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), "uint64", len(words))
    width = min(shingle, len(words))
    sums = np.full(len(words) - width + 1, width, "uint64")
    for i in range(width):
        sums = sums * np.uint64(_MIX) + hashes[i : len(words) - width + 1 + i]
        sums ^= sums >> np.uint64(29)
    sums *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(sums ^ (sums >> np.uint64(32)))


def overlap(n: int, similarity: float) -> int:
    """Shingles that a set of ``n`` shares, at least, with any set of that similarity."""
    return int(np.ceil(n * similarity - 1e-9))


def sketch(found: np.ndarray) -> np.ndarray:
    """For each value of the hashes' low bits, whether an odd number of them has it.

    Two sketches differ in as many bits as there are hashes in one set alone, at most. There is a bit a hash or up to
    twice as many, a power of two; the halves of a sketch, folded by exclusive or, are the sketch of half as many bits.
    """
    bits = max(64, 1 << (len(found) - 1).bit_length()) if len(found) else 64
    odd = np.bincount((found & np.uint64(bits - 1)).astype("int64"), minlength=bits) & 1
    return np.packbits(odd.astype("uint8")).view("int64")


#: Rows of a piece of a batch: results are sent on piece by piece.
_PIECE = 256


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, _PIECE) for at in range(0, max(1, batch.num_rows), _PIECE))


def _prefixes(lean: DataFrame, shingle: int, similarity: float, frequent: list[int]) -> DataFrame:
    """``doc_id, uid, node, n, fp, sketch, prefix``: a text's set by digest, its size, its SimHash, and the shingles it is found by."""
    common = np.array(frequent, "int64").view("uint64")
    by_hash = np.argsort(common)
    common = common[by_hash]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _pieces(whole)):
            nodes, sizes, prints, prefixes, sketches = [], [], [], [], [np.zeros(0, "int64")]
            for raw in batch.column(2):
                found = shingle_set(raw.as_py() or b"", shingle)
                nodes.append(xxhash.xxh64_intdigest(found.tobytes(), len(found)))
                sizes.append(len(found))
                prints.append(fingerprint_of(found))
                sketches.append(sketch(found))
                if len(common) and len(found):
                    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
                    # Frequent shingles last, the most frequent at the very end.
                    rank = np.where(common[at] == found, len(common) - by_hash[at], 0)
                    found = found[np.argsort(rank, kind="stable")]
                # A copy, as a view would keep the whole set.
                prefixes.append(found[: len(found) - overlap(len(found), similarity) + 1].copy())
            ends = np.concatenate(([0], np.cumsum([len(x) for x in prefixes]))).astype("int32")
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, "uint64")
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view("int64")))
            rows = np.cumsum([len(x) for x in sketches]).astype("int32")
            bits = pa.ListArray.from_arrays(pa.array(rows), pa.array(np.concatenate(sketches)))
            columns = [batch.column(0), batch.column(1), pa.array(np.array(nodes, "uint64").view("int64")), pa.array(sizes, pa.int32()), pa.array(np.array(prints, "uint64").view("int64")), bits, lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "uid", "node", "n", "fp", "sketch", "prefix"])

    return lean.mapInArrow(read, "doc_id long, uid long, node long, n int, fp long, sketch array<long>, prefix array<long>")


def _sets(lean: DataFrame, shingle: int) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, raw in zip(batch.column(0), batch.column(1), strict=True):
                found = shingle_set(raw.as_py() or b"", shingle).view("int64")
                row = [pa.array([node.as_py()], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found))]
                yield pa.RecordBatch.from_arrays(row, names=["node", "hashes"])

    return lean.mapInArrow(read, "node long, hashes array<long>")


def _frequent(lean: DataFrame, shingle: int, sample: int, most: int) -> list[int]:
    """The shingles that most documents of a sample hold, ``most`` at most, from the most frequent on."""
    drawn = _sets(hash_sample(lean, F.lit(1), F.col("uid"), sample).select(F.col("uid").alias("node"), "raw"), shingle)
    counts = drawn.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return [r["h"] for r in counts.orderBy(F.desc("n"), "h").limit(most).collect()]


def _near_by_fingerprint(nodes: DataFrame, radius: int) -> DataFrame:
    """``a, b``: nodes that BK-trees find within ``radius`` bits of SimHash, by way of one head for each fingerprint."""
    heads = materialise(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    same = nodes.join(heads, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    bits = near_links(heads.select("fp"), radius).toDF("x", "y")
    left, right = (heads.select(F.col("fp").alias(fp), F.col("head").alias(name)) for fp, name in (("x", "a"), ("y", "b")))
    return same.unionByName(bits.join(left, "x").join(right, "y").select("a", "b"))


def compared(pairs: DataFrame, nodes: DataFrame, lean: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose whole sets are alike."""
    pairs = materialise(pairs)
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = broadcast_if_small(materialise(ends.join(nodes.select("node", F.col("uid").alias("_uid")), "node")), F.lit(16))
    texts = lean.join(wanted, lean["uid"] == wanted["_uid"]).select("node", "raw")
    return materialise(_verified(pairs, materialise(_sets(texts, shingle).dropDuplicates(["node"])), similarity))


def labels(links: DataFrame) -> DataFrame:
    return broadcast_if_small(materialise(connected_components(links)), F.lit(16))


#: Holders of a shingle beyond which its pairs are compared where they meet, and holders of a chunk.
HOT, CHUNK = 128, 1024


def _hot_pairs(held: DataFrame, nodes: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: pairs of different groups that share a key of many holders ``held(key, node)``, and whose sizes and sketches allow the similarity.

    Holders are cut into chunks that meet in tasks, and only pairs that may be links leave these: a passage that very many documents share is
    compared, by sketches of some bytes, but its pairs are never written out.
    """
    from tessera.llm.minhash import stray_units  # which builds on this module

    units = stray_units(held.select("key", "node"), groups.withColumnRenamed("group", "component"), CHUNK)
    by = ["key", "i", "j"]
    dealt = units.join(nodes.select("node", "n", "sketch"), "node").select(*by, "left", "right", "stray", "node", "group", "n", "sketch")
    dealt = dealt.repartition(*by).sortWithinPartitions(*by, "node")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pd.DataFrame | None = None
        for batch in _then_none(batches):
            pdf = rest if batch is None else batch.to_pandas() if rest is None else pd.concat([rest, batch.to_pandas()], ignore_index=True)
            if pdf is None or not len(pdf):
                continue
            cuts = np.flatnonzero(np.logical_or.reduce([pdf[c].to_numpy()[1:] != pdf[c].to_numpy()[:-1] for c in by])) + 1
            cuts = [0, *cuts.tolist(), *([len(pdf)] if batch is None else [])]
            for start, end in zip(cuts, cuts[1:], strict=False):
                yield _alike(pdf.iloc[start:end], similarity)
            rest = pdf.iloc[cuts[-1] :]

    return dealt.mapInArrow(search, "a long, b long")


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _alike(pdf: pd.DataFrame, similarity: float) -> pa.RecordBatch:
    """The pairs of a unit, a left and a right member, whose sizes and sketches allow the similarity."""
    node, group, n, stray, left, right = (pdf[c].to_numpy() for c in ("node", "group", "n", "stray", "left", "right"))
    drawn = [np.asarray(x, "int64").view("uint64") for x in pdf["sketch"]]
    width = np.array([len(x) for x in drawn])
    a, b = [np.zeros(0, "int64")], [np.zeros(0, "int64")]
    folded = lambda rows, to: rows if rows.shape[1] == to else folded(rows[:, : rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2 :], to)
    rights = {w: np.flatnonzero(right & (width == w)) for w in np.unique(width[right])}
    tables = {w: np.stack([drawn[i] for i in at]) for w, at in rights.items()}
    for w, at in rights.items():
        for v in (w // 2, w, 2 * w):  # sets alike in size have sketches of one length, or one twice the other's
            to = min(v, w)
            lefts = np.flatnonzero(left & (width == v))
            if not len(lefts):
                continue
            table, own = folded(tables[w], to), folded(np.stack([drawn[i] for i in lefts]), to)
            for x, bits in zip(lefts, own, strict=True):
                able = (group[at] != group[x]) & (np.minimum(n[at], n[x]) >= np.maximum(n[at], n[x]) * (similarity - 1e-9)) & (~stray[at] | (node[x] < node[at]))
                y = np.flatnonzero(able)
                apart = np.bitwise_count(table[y] ^ bits).sum(axis=1)
                y = at[y[apart <= (n[at[y]] + n[x]) * (1 - similarity) / (1 + similarity) + 1e-6]]
                a.append(np.minimum(node[x], node[y]))
                b.append(np.maximum(node[x], node[y]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def similar_pairs(prints: DataFrame, lean: DataFrame, shingle: int, similarity: float, radius: int) -> DataFrame:
    """``a, b``: pairs that connect all distinct sets whose common shingles are ``similarity`` of their union or more."""
    nodes = materialise(prints.groupBy("node").agg(F.min("uid").alias("uid"), *(F.first(c).alias(c) for c in ("n", "fp", "sketch"))))
    links = compared(_near_by_fingerprint(nodes, radius), nodes, lean, shingle, similarity)
    # What SimHash has joined is one group; from here on only pairs of different groups are looked for.
    groups = labels(links).withColumnRenamed("component", "group")
    keyed = prints.select("node", "n", "prefix").join(groups, "node", "left").select("node", "n", F.coalesce("group", "node").alias("group"), F.explode("prefix").alias("key"))
    mixed = keyed.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count(F.lit(1)).alias("holders"))
    mixed = materialise(mixed.where("low < high").select("key", "holders"))
    held = materialise(keyed.join(broadcast_if_small(mixed, F.lit(16)), "key").distinct())
    few = held.where(F.col("holders") <= HOT)
    a, b = few.alias("a"), few.alias("b")
    near = (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.group") != F.col("b.group"))
    # Sets of that similarity are also alike in size.
    near &= F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * F.lit(similarity - 1e-9)
    pairs = a.join(b, near).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    pairs = materialise(pairs.unionByName(_hot_pairs(held.where(F.col("holders") > HOT), nodes, groups, similarity)).distinct())
    # And their sketches are, which spares most others the comparison of whole sets.
    left, right = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab")
    half = lambda s: F.zip_with(F.slice(s, 1, (F.size(s) / 2).cast("int")), F.slice(s, (F.size(s) / 2).cast("int") + 1, F.size(s)), lambda x, y: x.bitwiseXOR(y))
    # Sets alike in size have as many bits, or one of them twice as many (as similarity is above 0.5).
    folded = lambda s, t: F.when(F.size(s) > F.size(t), half(s)).otherwise(s)
    s_a, s_b = folded(F.col("s_a"), F.col("s_b")), folded(F.col("s_b"), F.col("s_a"))
    apart = F.aggregate(F.zip_with(s_a, s_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    most = (F.col("n_a") + F.col("n_b")) * F.lit((1 - similarity) / (1 + similarity)) + 1e-6
    pairs = materialise(pairs.join(left, "a").join(right, "b").withColumn("apart", apart).where(F.col("apart") <= most).select("a", "b", "apart"))
    # Each set with the nearest by sketch first; then only pairs that these links leave unconnected.
    closest = F.min(F.struct("apart", "a", "b")).alias("p")
    first = pairs.groupBy("a").agg(closest).select("p.a", "p.b").union(pairs.groupBy("b").agg(closest).select("p.a", "p.b")).distinct()
    links = links.unionByName(compared(first, nodes, lean, shingle, similarity))
    heads = labels(links)
    left, right = (heads.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}")) for x in "ab")
    apart = F.coalesce("c_a", "a") != F.coalesce("c_b", "b")
    rest = pairs.join(left, "a", "left").join(right, "b", "left").where(apart).select("a", "b")
    return links.unionByName(compared(rest, nodes, lean, shingle, similarity))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b"
    )
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= (F.size("x") + F.size("y") - common) * F.lit(similarity) - 1e-9).select("a", "b")


def similar_groups(
    df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 3, sample: int = 2000
) -> DataFrame:
    """``doc_id, component_id``: one row for each row of ``df``.

    Documents are linked if the distinct shingles they share are at least ``similarity`` of all that either has
    (ASCII lower case, words at white space; a text of fewer words is one shingle), and ``component_id`` is the
    smallest ``doc_id`` that links reach. SimHash comes first: fingerprints of the shingles within ``radius`` bits, found with BK-trees, are
    compared as whole sets, which joins most copies without pairs inside their groups. 64 bits cannot tell all sets of a similarity of 0.8
    apart from others, so an exact way takes the rest, and no link is missed: of two such sets, ordered alike, the first
    n - ceil(similarity n) + 1 shingles of each have one in common. Sets of different groups that meet there, and
    whose sizes and sketches allow that similarity, are compared whole. The pairs of a shingle that many sets hold there are never
    written out: its holders meet in chunks, in tasks, and only pairs that sketches allow leave these.
    The order puts shingles last that a sample of documents repeats; it bears on time, not on the result.

    Documents of equal sets are one node. Null and blank texts have the empty set and are one node. Repeated rows give
    repeated rows. Rows with a null ``doc_id`` keep it, and lend no id to their component unless it has none else
    (then it is null). An empty table gives an empty result; further columns are ignored.
    """
    if not 0.5 < similarity <= 1:
        raise ValueError("similarity must be above 0.5 and at most 1")
    lean = df.select(
        col(doc_id).cast("long").alias("doc_id"), F.xxhash64(col(doc_id), col(text)).alias("uid"), col(text).cast("binary").alias("raw")
    )
    prints = materialise(_prefixes(lean, shingle, similarity, _frequent(lean, shingle, sample, 10_000)))
    found = connected_components(similar_pairs(prints, lean, shingle, similarity, radius))
    joined = prints.select("doc_id", "node").join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(
        "doc_id", "node", F.coalesce("component", "node").alias("component")
    )
    joined = materialise(joined)
    heads = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return joined.join(heads, "component").select("doc_id", "component_id")
