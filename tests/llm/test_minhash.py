"""MinHash groups against all pairs, with copies about the similarity sought, hot buckets and awkward rows."""

import numpy as np
import pytest

from tessera.llm.minhash import MinHasher, least_matches, minhash_groups
from tessera.llm.shingles import shingle_set


def shingles(text, k=3):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split(" ")
    w = [x for part in w for x in part.split() if x]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, similarity=85):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= similarity * len(x | y):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    heads = [d if not s else least.get(root(i)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]
    return sorted(((d, len(s), c, d is not None and d == c) for (d, _), s, c in zip(rows, sets, heads, strict=True)), key=repr)


def edited(rng, w, n):
    x = list(w)
    for at in rng.choice(len(x), n, replace=False):
        x[at] = f"v{rng.integers(0, 9999)}"
    return x


def found(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, node int, Kept int")
    return sorted((tuple(r) for r in minhash_groups(df, **how).collect()), key=repr)


@pytest.mark.parametrize("unit", [4, 1024])
def test_groups_match_all_pairs(spark, unit):
    rng, rows = np.random.default_rng(7), []
    for i in range(24):  # copies of 0 to 5 edits in a hundred words, so that similarity lies on both sides of 0.85
        w = [f"w{v}" for v in rng.integers(0, 3000, rng.integers(5, 250))]
        rows.append(" ".join(w))
        for _ in range(5):
            x = edited(rng, w, int(len(w) * rng.uniform(0, 0.05)))
            rows.append(" ".join(x).upper() if i % 3 else "\n".join(x))
    # A hub with many copies at about 0.88, which are at about 0.78 to each other; others at 0.6 to all.
    hub = [f"h{v}" for v in range(400)]
    rows += [" ".join(edited(rng, hub, 8)) for _ in range(40)] + [" ".join(hub)] + [" ".join(edited(rng, hub, 28)) for _ in range(20)]
    rows += ["", None, " \n", "one two", "ONE  two", "one two three", "a b " * 200, "a b " * 300]
    rows = list(enumerate(rows)) + [(None, rows[0]), (None, "no id here at all"), (3, rows[3]), (3, rows[3])]
    assert found(spark, rows, unit=unit) == brute(rows)


def test_chain_through_one_bucket(spark):
    """Each text is near the next alone, so that no star joins them."""
    rows = [(i, " ".join([f"w{v}" for v in range(9 * i, 9 * i + 240)])) for i in range(30)]
    assert found(spark, rows) == brute(rows) and len({r[2] for r in brute(rows)}) == 1


def test_odd_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(2, None), (1, ""), (1, "\t"), (None, None)]) == brute([(2, None), (1, ""), (1, "\t"), (None, None)])


def test_minima_measure_similarity():
    rng, hasher = np.random.default_rng(4), MinHasher(32, 4)
    assert least_matches(128, 0.85) == 88
    for share in (0.3, 0.6, 0.9):
        seen = []
        for _ in range(60):
            x = rng.integers(0, 1 << 64, 2000, "uint64")
            y = np.concatenate((x[: int(2000 * share)], rng.integers(0, 1 << 64, 2000 - int(2000 * share), "uint64")))
            seen.append((hasher.signature(np.sort(x)) == hasher.signature(np.sort(y))).mean())
        assert abs(np.mean(seen) - len(np.intersect1d(x, y)) / len(np.union1d(x, y))) < 0.03
    empty = hasher.signature(shingle_set(b""))
    assert (empty == np.iinfo("uint32").max).all()
