"""The language references of the quality rules, which every labelled document counts in."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm.quality import CLASSES, Rules, quality_verdicts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made(rng, n=4500):
    """More documents than a sample of 2,000 a language would hold; no two have words in the same shares."""
    common = [f"Word{i}" if i % 9 == 0 else f"w{chr(97 + i % 26)}{i // 26}," for i in range(60)]
    rows = []
    for i in range(n):
        drawn = rng.choice(60, 60, p=np.r_[[0.3 / 20] * 20, [0.7 / 40] * 40]) if i % 3 else rng.choice(20, 60)
        rows.append((i, f"{' '.join(common[x] for x in drawn)}\tNo{i} éß\n", "en" if i % 10 else "fr", "a", 1))
    return [*rows, (n, None, "en", "a", 1), (n + 1, "", "de", "a", 1)]


def half(p, q):
    return sum(x * np.log2(x / ((p + q) / 2)) / 2 for x in (p, q) if x > 0)


def classes_of(text):
    blanks, lower = len(re.findall(r"[\x20\x09-\x0D]", text)), len(re.findall("[a-z]", text))
    named = [len(re.findall(c, text)) for c in CLASSES]
    return np.array([blanks, lower, *named, len(text) - blanks - lower - sum(named)], "float64")


def brute(rows):
    """The class and the word distance of each document, and the latter's share of the reach, by references of all documents."""
    words, classes = defaultdict(Counter), defaultdict(lambda: np.zeros(len(CLASSES) + 3))
    for _, text, lang, *_ in rows:
        words[lang].update((text or "").split())
        classes[lang] += classes_of(text or "")
    top = {x: {w: n / sum(c.values()) for w, n in sorted(c.items(), key=lambda y: (-y[1], y[0]))[:40]} for x, c in words.items()}
    for i, text, lang, *_ in rows:
        if len((text or "").split()) >= 50:
            w, own = Counter(text.split()), classes_of(text)
            n, common = sum(w.values()), top[lang]
            bins = [(w[x] / n, q) for x, q in common.items()]
            bins.append((1 - sum(p for p, _ in bins), 1 - sum(common.values())))
            by_class = sum(half(p, q) for p, q in zip(own / len(text), classes[lang] / classes[lang].sum(), strict=True))
            by_word, reach = (sum(half(p, q) for p, q in x) ** 0.5 for x in (bins, [*((0, q) for q in common.values()), (1, bins[-1][1])]))
            yield i, by_class**0.5, by_word, by_word / reach


def test_references_count_every_document(spark):
    rows = made(np.random.default_rng(31))
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r.doc_id: (r.class_distance, r.word_distance) for r in quality_verdicts(df).where("n_words >= 50").collect()}
    want = {i: (c, w) for i, c, w, _ in brute(rows)}
    assert found.keys() == want.keys()
    assert all(found[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_pipeline_keeps_what_references_of_all_documents_keep(spark):
    rng = np.random.default_rng(32)
    rows = made(rng)
    for i in range(200):  # from few of the common words to many
        drawn = [f"w{chr(97 + x)}{0}," if rng.random() < i / 200 else f"r{rng.integers(0, 10**9)}x" for x in rng.integers(1, 20, 800)]
        rows.append((10_000 + i, " ".join(drawn), "en", "a", 1))
    rules, words = Rules(), {i: len((t or "").split()) for i, t, *_ in rows}
    limit = lambda n: min(rules.max_word_share, (rules.word_share + rules.word_noise * rules.common_words / n) ** 0.5)
    good = {i for i, c, w, share in brute(rows) if c <= rules.max_class_distance and w <= rules.max_word_distance and share <= limit(words[i])}
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert kept == good and 0 < sum(i >= 10_000 for i in kept) < 200
