"""Fill-in-middle cuts against regular expressions and slices, the skip list against sums, and awkward rows."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import queries as Q
from tessera.llm.infill import SkipList, Towers, cut, draws_of, fill_in_middle, restored, unit_ends

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = ["", " ", "\n\t ", "a", " a", "a ", "  a b\tc\n", "ä ☃𐍈  x y", "x" * 5000, "word " * 9000, "<P", "a <S> b", "< S>", "\x0b\x0c\x1c\x00 z", "🙂 " * 300 + "end"]


def by_slices(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    u, h = UNITS.findall(text), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(u), "plain", None, None, text
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h4 % 100 < spm:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_units_are_those_of_the_expression():
    for text in ODD:
        assert np.diff(unit_ends(text), prepend=0).tolist() == [len(u) for u in UNITS.findall(text)]


def test_every_rank_is_reached_by_accumulated_widths():
    rng, towers = np.random.default_rng(3), Towers()
    for n in (1, 2, 3, 5, 16, 17, 200, 3000, 5, 700):
        widths = rng.integers(1, 30, n)
        units = SkipList(widths, towers)
        sums = np.concatenate(([0], np.cumsum(widths)))
        assert [units.offset(r) for r in range(n + 1)] == sums.tolist()
        for passed, points, _ in units.lanes:
            assert passed.sum() == n and points.sum() == sums[-1]
    assert len(SkipList(np.ones(100_000, "int64"), towers).lanes) >= 6


def test_cuts_match_slices():
    towers = Towers()
    for i, text in enumerate(ODD * 20):
        assert cut(text, draws_of(str(i), 42), towers, 90, 50) == by_slices(i, text, rate=90, spm=50)


def test_query_against_slices(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas()
    rows = {r.doc_id: r for r in Q.op12_fill_in_middle(spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == len(docs) and {r.form for r in rows.values()} == {"plain", "spm", "psm"}
    for d, text in zip(docs.doc_id, docs.text, strict=True):
        n, form, prefix, middle, output = by_slices(d, text)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(rows[d]) == (d, n, form, prefix, middle, sha(output), sha(text))


def test_odd_rows_and_columns(spark):
    given = [*enumerate(ODD), (None, "no id at all"), (3, None), (3, "a"), (3, "a")]
    df = spark.createDataFrame([(*r, i, "f", "o") for i, r in enumerate(given)], ["doc_id", "text", "_text", "FORM", "a.b"])
    out = fill_in_middle(df, rate=100)
    assert out.columns == ["doc_id", "_text", "a.b", "text", "n", "form", "prefix_chars", "middle_chars"]
    for r in out.withColumn("back", restored(F.col("text"), F.col("form"))).collect():
        doc_id, text = given[r["_text"]]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.text) == by_slices(doc_id, text, rate=100)
        assert r.back == (text or "") and r.doc_id == doc_id
    assert fill_in_middle(df.where("false")).count() == 0
