"""Languages of many scripts at once, and more languages than profiles are held for."""

import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid
from tessera.llm.langid import identify_languages
from tessera.llm.queries import op5_language_profiles

#: The first letter and the count of letters of each script's range.
SCRIPTS = {"latin": (0x61, 26), "greek": (0x3B1, 17), "cyrillic": (0x430, 32), "arabic": (0x628, 19), "devanagari": (0x915, 37), "han": (0x4E00, 400), "hangul": (0xAC00, 400)}


def made(rng, at, n):
    return " ".join("".join(chr(at + int(n * x**2)) for x in rng.random(rng.integers(2, 8))) for _ in range(40))


def test_rare_scripts_keep_their_letters(spark):
    rng, rows = np.random.default_rng(11), []
    for name, (at, n) in SCRIPTS.items():
        # Two languages a script, of its first and second half; Latin texts are the most by far.
        for half in (0, 1):
            for _ in range(60 if name == "latin" else 16):
                rows.append((len(rows), made(rng, at + half * (n // 2), n // 2), f"{name}{half}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r.lang_pred for r in identify_languages(df, learn_from=F.col("doc_id") % 2 == 0).collect()}
    assert [out[d] for d, _, _ in rows] == [x for _, _, x in rows]


def test_too_many_languages_are_an_error(spark):
    df = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(4)], "doc_id long, text string, lang string")
    assert identify_languages(df, learn_from=F.lit(True), max_languages=4).count() == 4
    with pytest.raises(ValueError):
        identify_languages(df, learn_from=F.lit(True), max_languages=3)


def test_pieces_count_as_the_whole(monkeypatch):
    ids = langid._codes(made(np.random.default_rng(12), 0x430, 32))
    whole = langid._top(ids, 300).tolist()
    for piece in (1, 7, 50):
        monkeypatch.setattr(langid, "_PIECE", piece)
        assert langid._top(ids, 300).tolist() == whole


def brute_ranks(texts, size=300):
    """N-grams by Counter, the most frequent first, ties by code points with the gap after all letters."""
    counts = Counter()
    for text in texts:
        for word in re.findall(r"[^\W\d_]+", "".join(c if unicodedata.category(c).startswith("L") else " " for c in text.lower())):
            w = [0x1FFFFF, *map(ord, word), 0x1FFFFF]
            counts.update((x,) for x in w[1:-1])
            counts.update(zip(w, w[1:], strict=False))
            counts.update(zip(w, w[1:], w[2:], strict=False))
    return sorted(counts, key=lambda g: (-counts[g], len(g), g))[:size]


def test_predictions_match_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    held = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 5 == 0 for d in docs}
    profiles = {}
    for lang in sorted({d.lang for d in docs if d.lang and d.text and not held[d.doc_id]}):
        ranks = brute_ranks(d.text for d in docs if d.lang == lang and d.text and not held[d.doc_id])
        profiles[lang] = {g: i for i, g in enumerate(ranks)}
    found = {r.doc_id: (r.lang_pred, r.score) for r in op5_language_profiles(spark, sf).collect()}
    for d in docs[::7]:
        mine = brute_ranks([d.text or ""])
        apart = {lang: sum(abs(p[g] - i) if g in p else 300 for i, g in enumerate(mine)) for lang, p in profiles.items()}
        best = min(apart, key=apart.get)
        assert found[d.doc_id] == ((best, pytest.approx(1 - apart[best] / (300 * len(mine)))) if mine else ("und", 0))
