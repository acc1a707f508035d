"""The conversation trie against nested dictionaries, with tiny segments and shards, and on awkward rows."""

import hashlib
import zlib

import numpy as np
import pytest

from tessera.llm import queries as Q
from tessera.llm.trie import Shard, conversation_trie, numbered_turns

SCHEMA = "conv_id long, turn long, role string, text string, pos int, `a.b` int"


def ordered(rows):
    """Turns of each conversation, as (role, text), in order."""
    out = {}
    for r in rows:
        if r[0] is not None:
            out.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in out.items()}


def spliced(convs):
    out = {}
    for c, own in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 9, int(np.fmod(c, 5))
        out[c] = convs.get(c - base, [])[:h] + own[h:]
    return out


def brute_trie(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        children = [k for k in below if len(k) == len(key) + 1]
        leaves = sum(not any(k[: len(x)] == x and len(k) > len(x) for k in below) for x in below)
        saved = sum((len(nodes[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(key))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def random_rows(rng, n, longest):
    """Conversations that share beginnings; some in one copy, some in many, some turn numbers repeated or null."""
    rows, said = [], ["ja", "nein", "ö ☃", "", None]
    for c in rng.choice(4 * n, n, replace=False).tolist():
        for t in range(int(rng.integers(0, longest + 1))):
            role = None if rng.random() < 0.02 else ("user", "assistant")[t % 2]
            rows.append((c, None if t == 0 and rng.random() < 0.3 else t, role, said[int(rng.integers(0, 2 if rng.random() < 0.8 else 5))], 7, 8))
    return rows


def run(spark, rows, **limits):
    turns, ids = Q.rebuilt_conversations(numbered_turns(spark.createDataFrame(rows, SCHEMA)))
    return sorted((tuple(r) for r in conversation_trie(turns, ids, **limits).collect()), key=repr)


@pytest.mark.parametrize("limits", [{}, {"segment": 2, "shard": 3}, {"segment": 3, "shard": 64, "shard_turns": 5}])
def test_trie_of_rebuilt_conversations(spark, limits):
    rows = random_rows(np.random.default_rng(5), 60, 14)
    assert run(spark, rows, **limits) == brute_trie(spliced(ordered(rows)))


def test_hot_conversation_and_copies(spark):
    """One conversation has most rows; copies of another are most conversations."""
    rows = [(1000, t, "user", f"turn {t % 3}", 1, 1) for t in range(230)] + [(c, t, "user", f"turn {t % 3}", 1, 1) for c in range(0, 400, 5) for t in range(9)]
    assert run(spark, rows, segment=16, shard=8) == brute_trie(spliced(ordered(rows)))


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "nobody's", 0, 0), (3, 1, None, None, 0, 0), (3, 1, None, None, 0, 0), (4, 2, "user", "b", 0, 0), (4, None, "user", "a", 0, 0),
        (4, 2, "assistant", "b", 0, 0), (-7, 0, "user", "x" * 90_000, 0, 0), (-5, 0, "user", "y", 0, 0), (9, 0, "", "", 0, 0), (12, 0, "user", "x" * 90_000, 0, 0),
    ]
    assert run(spark, rows) == brute_trie(spliced(ordered(rows)))
    assert run(spark, []) == []
    gone = [(2, 0, "user", "only turn", 0, 0)]  # its head of conversation 0 is absent
    assert run(spark, gone) == brute_trie(spliced(ordered(gone)))


def test_places_across_ranges(spark):
    rows = [(5, t // 2, "user", str(t), 0, 0) for t in range(500)] + [(c, 0, "user", "x", 0, 0) for c in range(5)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = numbered_turns(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(r.pos for r in found if r.conv_id == 5) == list(range(500)) and len(found) == 505


def test_bitsets_of_a_shard():
    a, b, c = (1, 1), (2, 2), (4, 4)
    found = {n[:2]: n[5:] for n in Shard([3, 5, 8], [[a, b], [a, c], [a]], [np.array([9, 1]), np.array([9, 2]), np.array([9])], [False, True, False]).nodes((0, 0), 0)}
    assert found[(0, 0)][:2] == (3, 3) and found[(1, 1)] == (3, 3, 9, [], [8])
    assert found[(3, 3)] == (1, 3, 1, [0, 0], [3]) and found[(5, 5)] == (1, 5, 2, [0, 0], [])


def test_query_against_dictionaries(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    found = sorted((tuple(r) for r in Q.op13_conversation_trie(spark, "/root/testdata/sf0.001").collect()), key=repr)
    assert found == brute_trie(spliced(ordered(rows)))
