"""Callers' columns of any name beside the operators' own, hot band shards, and the mix against another computation."""

from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm.langid import identify_languages
from tessera.llm.lines import dedup_lines
from tessera.llm.mixing import mix_sources
from tessera.llm.packing import pack_documents
from tessera.llm.quality import quality_verdicts
from tessera.llm.sharding import histogram_sort_shards
from tessera.llm.simhash import fingerprints, near_links
from tessera.llm.tokens import token_counts
from tessera.llm.wrappers import extract_main_text

NAMES = ["a.b", "whole", "_edge", "_room", "_ref", "_w", "_q", "_l", "_j", "_r", "_h", "row", "of", "h", "n", "c0", "c1", "bucket", "label", "edge", "more", "_row", "_text", "_of", "key", "tie", "html2", "back`tick", "host", "mark"]
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

CALLS = {
    "sharding": lambda df: histogram_sort_shards(df, n_shards=3, key="doc_id", size="size"),
    "tokens": lambda df: token_counts(df, model=PIECES),
    "fingerprints": fingerprints,
    "lines": dedup_lines,
    "langid": lambda df: identify_languages(df, learn_from=F.lit(True)),
    "pages": lambda df: extract_main_text(df, html="text", out="main"),
    "mix": mix_sources,
    "quality": quality_verdicts,
}


@pytest.mark.parametrize("name", CALLS)
def test_columns_of_any_name_stay(spark, name):
    row = (1, "one two three four five", "en", "s", 5, "http://x.example/")
    df = spark.createDataFrame([(*row, *range(len(NAMES)))], ["doc_id", "text", "lang", "source", "size", "url", *NAMES])
    out = CALLS[name](df).collect()
    assert len(out) == 1 and [out[0][out[0].__fields__.index(c)] for c in NAMES] == list(range(len(NAMES)))


def test_packing_ignores_other_columns(spark):
    df = spark.createDataFrame([(1, "a b", 3)], ["doc_id", "text", "a.b"])
    assert pack_documents(df, tokenizer=WORDS).count() == 1


def components(nodes, links):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    return {x: root(x) for x in nodes}


def test_hot_band_shards_keep_every_connection(spark):
    rng = np.random.default_rng(16)
    base = int(rng.integers(0, 1 << 62))
    # All agree in their upper 27 bits, so some bands have one shard; half lie near each other.
    values = {base & ~((1 << 37) - 1) | int(x) for x in rng.integers(0, 1 << 37, 300)}
    for v in list(values)[:150]:
        values.add(v ^ sum(1 << int(i) for i in rng.choice(37, 3, replace=False)))
    values = sorted(values)
    found = near_links(spark.createDataFrame([(v,) for v in values], "fp long"), radius=3, tree_size=16).collect()
    near = [(x, y) for i, x in enumerate(values) for y in values[:i] if (x ^ y).bit_count() <= 3]
    assert all((r.a ^ r.b).bit_count() <= 3 for r in found)
    mine, truth = components(values, [(r.a, r.b) for r in found]), components(values, near)
    groups = lambda c: {frozenset(x for x in values if c[x] == r) for r in set(c.values())}
    assert near and groups(mine) == groups(truth)


def test_targets_of_a_mix_by_bisection(spark):
    """Targets are min(3 * size, level * weight) of one level, which bisection finds too."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "source", "size(filter(split(text, '[ \\t\\n\\r]+'), w -> w <> '')) as size").collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
    names = sorted(x for x in sizes if x is not None) + [x for x in sizes if x is None]
    weight = {x: i % 3 + 1 for i, x in enumerate(names)}
    total = sum(sizes.values())
    low, high = 0.0, float(total)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * sizes[x], mid * weight[x]) for x in names) < total else (low, mid)
    df = spark.createDataFrame([(r.doc_id, r.source, r.size) for r in rows], "doc_id long, source string, size int")
    taken = defaultdict(int)
    for r in mix_sources(df).collect():
        assert r.target == pytest.approx(min(3 * sizes[r.source], low * weight[r.source])) and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    assert all(abs(taken[x] - min(3 * sizes[x], low * weight[x])) <= 1 for x in names)


def test_rows_without_a_key_are_sampled_each_by_itself(spark):
    df = spark.range(3000).selectExpr("cast(null as long) as doc_id", "if(id < 2400, 'a', 'b') as source", "1 as size")
    rows = mix_sources(df).collect()
    # 1,000 of the 2,400 rows of a; three epochs of 600 stop b at 1,800, so a takes 1,200.
    assert sum(r.taken for r in rows if r.source == "a") == 1200 and sum(r.taken for r in rows if r.source == "b") == 1800
