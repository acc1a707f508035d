"""The prefix trie of conversations, by vertical bitmaps: bitsets of conversations for each (position, turn), intersected depth first."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, col, materialise

#: Turns of a segment, conversations of a shard, turns of a shard.
SEGMENT, SHARD, SHARD_TURNS = 1024, 2048, 100_000
#: Nodes that a task gathers before it hands them on.
_BATCH = 20_000


def numbered_turns(df: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, pos, t1, t2, n_bytes``: each turn's place from 0 in its conversation, a digest of role and text, and its text's UTF-8 bytes.

    Turns stand in the order of ``turn`` (null first), equal ones in that of role, then of the digest, so that repeated rows are turns of their own. A
    null role or text is empty. Rows with a null ``conv_id`` belong to no conversation and go. Rows are dealt by ranges of conversation and turn, so
    that one long conversation spreads over tasks: places count within a range, and what earlier ranges hold of its first conversation is added.
    """
    by_role, words = F.coalesce(col(role), F.lit("")), F.coalesce(col(text), F.lit(""))
    lean = df.where(col(conv_id).isNotNull()).select(
        col(conv_id).cast("long").alias("conv_id"), col(turn).alias("turn"), by_role.alias("role"), *(F.xxhash64(F.lit(i), by_role, words).alias(f"t{i}") for i in (1, 2)),
        F.octet_length(words).cast("long").alias("n_bytes"),
    )
    order = ["conv_id", "turn", "role", "t1", "t2"]
    dealt = materialise(lean).repartitionByRange(*order).sortWithinPartitions(*order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if len(ids):
                starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
                begins = np.where(ids[starts] == last, -seen, starts) if last is not None else starts
                begins[1:] = starts[1:]
                place = np.arange(len(ids)) - np.repeat(begins, np.diff(np.append(starts, len(ids))))
                last, seen = ids[-1], int(place[-1]) + 1
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=["conv_id", "t1", "t2", "n_bytes", "part", "place"])

    placed = dealt.select("conv_id", "t1", "t2", "n_bytes", F.spark_partition_id().alias("part"))
    placed = materialise(placed.mapInArrow(count, "conv_id long, t1 long, t2 long, n_bytes long, part int, place long"))
    ends = placed.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"))
    edge = placed.join(F.broadcast(ends), "part").where("conv_id in (low, high)").groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("held"))
    before = F.sum("held").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # Two rows a task at most, as a range's first and last conversations alone go on elsewhere.
    carried = broadcast_if_small(materialise(edge.select("conv_id", "part", before.alias("before")).where("before > 0")), F.lit(24))
    return placed.join(carried, ["conv_id", "part"], "left").select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "t1", "t2", "n_bytes")


def _segments(turns: DataFrame, members: DataFrame, segment: int) -> DataFrame:
    """``conv_id, seg, g1, g2, n_bytes, x1, x2``: conversations in pieces of so many turns, each with the exclusive or of its turns' hashes.

    A turn's hash also takes its place; what the hashes of a prefix give by exclusive or is the prefix's key, in whatever pieces it comes.
    """
    hashed = turns.select("conv_id", F.floor(F.col("pos") / segment).alias("seg"), F.struct("pos", *(F.xxhash64(F.lit(i), "pos", "t1", "t2").alias(f"g{i}") for i in (1, 2)), "n_bytes").alias("turn"))
    bare = members.select("conv_id", F.lit(0).cast("long").alias("seg"), F.lit(None).cast(hashed.schema["turn"].dataType).alias("turn"))
    found = hashed.unionByName(bare).groupBy("conv_id", "seg").agg(
        F.array_sort(F.collect_list("turn")).alias("turn"), *(F.coalesce(F.expr(f"bit_xor(turn.g{i})"), F.lit(0)).alias(f"x{i}") for i in (1, 2))
    )
    return found.select("conv_id", "seg", *(F.col(f"turn.{c}").alias(c) for c in ("g1", "g2", "n_bytes")), "x1", "x2")


def _units(segments: DataFrame, long: DataFrame) -> DataFrame:
    """``segments`` with the key ``s1, s2`` of what stands before each, and whether ``more`` follows."""
    in_order = Window.partitionBy("conv_id").orderBy("seg")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, -1)
    starts = segments.join(long, "conv_id", "left_semi").select(
        "conv_id", "seg", *(F.coalesce(F.expr(f"bit_xor(x{i})").over(so_far), F.lit(0)).alias(f"s{i}") for i in (1, 2)), F.lead("seg").over(in_order).isNotNull().alias("more")
    )
    starts = broadcast_if_small(materialise(starts), F.lit(40))
    joined = segments.join(starts, ["conv_id", "seg"], "left")
    return joined.select(*(F.coalesce(f"s{i}", F.lit(0)).cast("long").alias(f"s{i}") for i in (1, 2)), "seg", "conv_id", F.coalesce("more", F.lit(False)).alias("more"), "g1", "g2", "n_bytes")


NODES = "k1 long, k2 long, p1 long, p2 long, depth long, n long, conv_id long, n_bytes long, jumps array<long>, ends array<long>"


class Shard:
    """Conversations (or like segments of them) that begin alike, as bitsets for each (position, turn)."""

    def __init__(self, ids: list[int], turns: list[list[tuple[int, int]]], sizes: list[np.ndarray], more: list[bool]) -> None:
        self.ids, self.turns, self.sizes = ids, turns, sizes
        self.holders: dict[tuple[int, tuple[int, int]], int] = {}
        self.ending: dict[int, int] = {}
        for i, own in enumerate(turns):
            for at, turn in enumerate(own):
                self.holders[at, turn] = self.holders.get((at, turn), 0) | 1 << i
            if not more[i]:
                self.ending[len(own)] = self.ending.get(len(own), 0) | 1 << i
        self.going = {i for i, x in enumerate(more) if x}

    def members(self, bits: int) -> list[int]:
        out = []
        while bits:
            low = bits & -bits
            out.append(self.ids[low.bit_length() - 1])
            bits ^= low
        return out

    def nodes(self, start: tuple[int, int], depth: int) -> Iterator[tuple]:
        """The nodes below the one with key ``start`` at ``depth``, and that one too if it is the root, depth first."""
        path = [start]
        stack = [((1 << len(self.ids)) - 1, 0, start, 0)]
        while stack:
            bits, at, key, size = stack.pop()
            path[at:] = [key]
            ends = bits & self.ending.get(at, 0)
            if at or not depth:
                parent = path[at - 1] if at else (0, 0)
                jumps = [x for k in range(1, at.bit_length()) for x in path[at - (1 << k)]]
                first = self.ids[(bits & -bits).bit_length() - 1]
                yield (*key, *parent, depth + at, bits.bit_count(), first, size, jumps, self.members(ends))
            rest = bits ^ ends
            while rest:
                i = (rest & -rest).bit_length() - 1
                if at == len(self.turns[i]):  # it goes on in another segment
                    rest ^= 1 << i
                    continue
                turn = self.turns[i][at]
                child = rest & self.holders[at, turn]
                rest ^= child
                stack.append((child, at + 1, (key[0] ^ turn[0], key[1] ^ turn[1]), int(self.sizes[i][at])))


def _shard_nodes(units: DataFrame, segment: int, shard: int, shard_turns: int) -> DataFrame:
    """The nodes of each shard: a range of ids among those of one start, in at most so many conversations and about so many turns."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        unit: list[tuple] = []
        start, held = None, 0

        def flush() -> None:
            if unit:
                ids, turns, sizes, more = (list(x) for x in zip(*unit, strict=True))
                rows.extend(Shard(ids, turns, sizes, more).nodes(start[:2], start[2] * segment))
                unit.clear()

        for batch in batches:
            s1, s2, seg, ids, more = (c.to_pylist() for c in batch.columns[:5])
            for r in range(batch.num_rows):
                key = (s1[r], s2[r], seg[r])
                if key != start or len(unit) >= shard or held >= shard_turns:
                    flush()
                    start, held = key, 0
                    while len(rows) >= _BATCH:
                        yield _batch(rows[:_BATCH])
                        del rows[:_BATCH]
                g1, g2, sizes = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in (5, 6, 7))
                unit.append((ids[r], list(zip(g1.tolist(), g2.tolist(), strict=True)), sizes, more[r]))
                held += len(g1)
        flush()
        for at in range(0, len(rows), _BATCH):
            yield _batch(rows[at : at + _BATCH])

    order = ["s1", "s2", "seg", "conv_id"]
    return units.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(walk, NODES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64()] * 8 + [pa.list_(pa.int64())] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in NODES.split(", ")])


def _end_hashes(pieces: DataFrame) -> DataFrame:
    """``k1, k2, ends_sha256``: SHA-256 of each node's ids, comma-joined, fed from pieces in ascending order and never held together."""

    def feed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for k1, k2, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if (k1, k2) != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield pa.RecordBatch.from_pandas(pd.DataFrame(done, columns=["k1", "k2", "ends_sha256"]).astype({"k1": "int64", "k2": "int64"}), preserve_index=False) if done else _none
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([state.hexdigest()])], names=["k1", "k2", "ends_sha256"])

    _none = pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string())], names=["k1", "k2", "ends_sha256"])
    return pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "low").mapInArrow(feed, "k1 long, k2 long, ends_sha256 string")


def _paths(units: DataFrame, long: DataFrame, segment: int) -> DataFrame:
    """``conv_id, depth, a1, a2``: the key of every prefix of the conversations of more than one segment."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                s1, s2, seg, conv = (batch.column(c)[r].as_py() for c in (0, 1, 2, 3))
                keys = [np.bitwise_xor.accumulate(np.append(s, batch.column(c)[r].values.to_numpy(zero_copy_only=False))) for s, c in ((s1, 5), (s2, 6))]
                keys = [k[int(seg > 0) :] for k in keys]  # a segment's start is the end of the one before
                depth = seg * segment + int(seg > 0) + np.arange(len(keys[0]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(depth), conv)), pa.array(depth), *map(pa.array, keys)], names=["conv_id", "depth", "a1", "a2"])

    return units.join(long, "conv_id", "left_semi").select(*units.columns).mapInArrow(walk, "conv_id long, depth long, a1 long, a2 long")


def _subtree_sums(nodes: DataFrame, paths: DataFrame | None) -> DataFrame:
    """``k1, k2, n_leaves, saved``: sums over each node's subtree, by doubling.

    After step i a node has the sums of those under 2^i levels at or below it; step i + 1 adds what the nodes just 2^i levels below have. So
    steps grow with the logarithm of the depth, and rows are added up before they move, so that no ancestor is a hot key.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums = nodes.select("k1", "k2", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("n_bytes")).alias("saved"))
    for step in range(deepest.bit_length()):
        far = 1 << step
        up = [F.col("p1"), F.col("p2")] if not step else [F.get("jumps", F.lit(2 * step - 2)), F.get("jumps", F.lit(2 * step - 1))]
        below = nodes.where(F.col("depth") >= far).select("k1", "k2", "conv_id", (F.col("depth") - far).alias("depth"), *(x.alias(f"u{i}") for i, x in enumerate(up, 1)))
        if step and paths is not None:  # ancestors in an earlier segment
            below = below.join(paths, ["conv_id", "depth"], "left").withColumns({f"u{i}": F.coalesce(f"u{i}", f"a{i}") for i in (1, 2)})
        gained = sums.join(below.select("k1", "k2", "u1", "u2"), ["k1", "k2"]).groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2"))
        gained = gained.agg(F.sum("n_leaves").alias("leaves_below"), F.sum("saved").alias("saved_below"))
        both = sums.join(gained, ["k1", "k2"], "left")
        sums = materialise(both.select("k1", "k2", *((F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("n_leaves", "leaves_below"), ("saved", "saved_below")))))
    return sums


def conversation_trie(turns: DataFrame, members: DataFrame, *, segment: int = SEGMENT, shard: int = SHARD, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie of conversations ``turns(conv_id, pos, t1, t2, n_bytes)``, places gapless from 0; ``members(conv_id)`` also names those without turns, each once.

    Each distinct sequence of a conversation's first d turns is a node at depth d, from the root at 0. Per node: ``conv_id`` (its smallest member, of those that
    begin with it), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes at or below it), ``saved_tokens`` (over
    the nodes at or below it, members but one times the bytes of the last text) and ``ends_sha256`` (of the ids of members that end there).

    A shard is a range of conversations; each (position, turn) in it has the bitset of its holders. Depth first, a node's bitset meets those of
    its members' next turns, which gives its children, their counts by popcount, and the list of those that end. Nodes of all shards meet
    by key (128 bits of the prefix). A conversation longer than ``segment`` turns is cut, and its pieces sharded with those that have the same turns
    before them. No members give no rows; conversations of equal turns share all nodes.
    """
    segments = materialise(_segments(turns, members, segment))
    long = materialise(segments.where("seg > 0").select("conv_id").distinct())
    units = _units(segments, long)
    found = materialise(_shard_nodes(units, segment, shard, shard_turns))
    merged = found.groupBy("k1", "k2").agg(
        *(F.first(c).alias(c) for c in ("p1", "p2", "depth", "n_bytes", "jumps")), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id")
    )
    children = merged.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialise(merged.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))
    sums = _subtree_sums(nodes, None if long.isEmpty() else materialise(_paths(units, long, segment)))
    ends = _end_hashes(found.where(F.size("ends") > 0).select("k1", "k2", F.get("ends", F.lit(0)).alias("low"), F.array_join(F.col("ends").cast("array<string>"), ",").alias("ids")))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.lit(True).alias("_inner"))
    joined = nodes.join(parents, ["p1", "p2"], "left").join(sums, ["k1", "k2"]).join(ends, ["k1", "k2"], "left")
    return joined.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
