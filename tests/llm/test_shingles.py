"""The pipeline's near-duplicates stage against brute force on copies that share 0.8 of their shingles."""

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm.shingles import shingle_set, similar_groups

SF = "/root/testdata/sf0.001"


def shingles(text, k=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, similarity=0.8):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or len(x & y) >= similarity * len(x | y) - 1e-9:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(rows))]


def copies(rng):
    """Texts with copies whose similarity lies about 0.8, and some that share a frequent line."""
    rows = []
    for i in range(60):
        w = [f"w{v}" for v in rng.integers(0, 5000, rng.integers(6, 400))]
        w = w + ["all", "rights", "are", "reserved", "by", "us", "here"] if i % 2 else w
        rows.append(" ".join(w))
        for _ in range(3):
            x = list(w)
            for at in rng.integers(0, len(x), max(1, int(len(x) * rng.uniform(0, 0.05)))):
                x[at] = f"v{rng.integers(0, 9999)}"
            rows.append(" ".join(x).upper() if i % 3 else "\n".join(x))
    rows += ["", None, " \n", "one two", "ONE  two", "one two three", "a b " * 200, "a b " * 300]
    return list(enumerate(rows)) + [(None, rows[0]), (None, "no id here at all but words"), (3, rows[3])]


def test_groups_match_brute_force(spark):
    rows = copies(np.random.default_rng(8))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for sample in (2000, 1):
        found = sorted((r.doc_id or -1, r.component_id or -1) for r in similar_groups(df, sample=sample).collect())
        assert found == sorted((d or -1, c or -1) for (d, _), c in zip(rows, brute_components(rows), strict=True))
    assert similar_groups(df.where("false")).count() == 0


@pytest.mark.parametrize("hot, chunk", [(1, 7), (2, 1000)])
def test_hot_shingles_lose_no_link(spark, monkeypatch, hot, chunk):
    monkeypatch.setattr("tessera.llm.shingles.HOT", hot)
    monkeypatch.setattr("tessera.llm.shingles.CHUNK", chunk)
    rows = copies(np.random.default_rng(18))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id or -1, r.component_id or -1) for r in similar_groups(df, sample=1).collect())
    assert found == sorted((d or -1, c or -1) for (d, _), c in zip(rows, brute_components(rows), strict=True))


def test_stage_drops_copies_of_similarity_eight_tenths(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(12):
        w = [f"w{v}" for v in rng.integers(0, 5000, 300)]
        near = [*w]
        near[40::75] = ["x"] * len(near[40::75])  # 4 words: 20 of 296 shingles on either side differ
        far = [*w]
        far[20::25] = ["y"] * len(far[20::25])
        rows += [(3 * i, " ".join(w)), (3 * i + 1, " ".join(near)), (3 * i + 2, " ".join(far))]
    df = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()}
    assert kept == {d for d, _ in rows if d % 3 != 1}


def test_sets_keep_apart_what_words_keep_apart():
    assert len(shingle_set(b"a b c d e f g")) == 3 and not len(shingle_set(b" \n"))
    assert (shingle_set(b"A b\tC") == shingle_set(b"a  b c")).all()
    assert (shingle_set(b"a b") != shingle_set(b"b a")).all()
