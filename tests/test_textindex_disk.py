"""What the build of a stored index moves, and the rows that its tasks make of whole blocks."""

import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import fulltext, textindex
from tests.moved import moved


@pytest.mark.parametrize("english", [True, False])
def test_a_build_moves_texts_once_and_no_words(spark, tmp_path, english):
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choices("bcdefghijklmnorstu", k=rng.randint(3, 9))) for _ in range(rng.randint(1, 900)))) for i in range(600)]
    size = sum(len(x) for _, x in rows)
    texts = spark.createDataFrame(rows, "doc long, body string")
    before = moved(spark)
    textindex.build(texts, str(tmp_path / "a"), id_col="doc", text="body", english=english)
    assert moved(spark) - before < 1.2 * size


def test_blocks_follow_lengths_in_pieces(spark, texts_of_all_lengths, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "PIECE", 3000)
    textindex.build(texts_of_all_lengths, str(tmp_path / "b"), id_col="doc", text="body", buckets=4, block=16)
    index = textindex.TextIndex(spark, str(tmp_path / "b"))
    blocks = index.documents().groupBy("block").agg(F.count("id").alias("n"), F.sum("n_bytes").alias("bytes"), F.max("n_bytes").alias("most"), F.min("n_bytes").alias("least"), F.collect_list("id").alias("ids")).collect()
    assert sorted(i for b in blocks for i in b.ids) == sorted(r.doc for r in texts_of_all_lengths.where("body is not null").collect())
    assert max(b.n for b in blocks) == 16 and all(b.bytes <= 3000 + b.most for b in blocks) and len(blocks) < 120
    rows = index.postings().select("lexeme", "block", "n_docs", "most", F.explode("entries").alias("e")).select("lexeme", "block", "n_docs", "most", "e.*").collect()
    found = {(r.id, r.lexeme): list(r.positions) for r in rows}
    wanted = {(r.doc, r.lexeme): list(r.positions) for r in fulltext.postings(texts_of_all_lengths, id_col="doc", text="body").collect()}
    assert found == wanted and len(rows) == len(wanted)
    by_row = defaultdict(list)
    for r in rows:
        by_row[r.lexeme, r.block].append(r)
    of = {i: b.block for b in blocks for i in b.ids}
    for (_, block), held in by_row.items():
        assert {r.n_docs for r in held} == {len(held)} and {r.most for r in held} == {max(len(r.positions) for r in held)} and {of[r.id] for r in held} == {block}


@pytest.fixture(scope="module")
def texts_of_all_lengths(spark):
    rng = random.Random(6)
    words = "cat cats dog running the of house houses rivers stone é ٣ naïve".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.choice((0, 1, 2, 2, 2, 9, 40, 300))))) for i in range(400)]
    return spark.createDataFrame([*rows, (900, None), (901, "..."), (902, "the of")], "doc int, body string").repartition(5)


@pytest.mark.parametrize("step", [1, 40, 10**6])
@pytest.mark.parametrize("size", [1, 7, 1000])
def test_rows_of_blocks_in_any_batches(monkeypatch, step, size):
    monkeypatch.setattr(textindex, "STEP", step)
    rng = random.Random(7)
    rows = [(100 - i, i // 9, rng.choices(["cat", "cats", "the", "stone"], k=rng.randint(0, 6))) for i in range(60)]
    table = pa.table({"id": [r[0] for r in rows], "block": [r[1] for r in rows], "words": pa.array([r[2] for r in rows], pa.list_(pa.string()))})
    found = [r for b in textindex._posted(True)(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
    wanted = defaultdict(lambda: defaultdict(list))
    for key, block, words in rows:
        for i, w in enumerate(words):
            if w != "the":
                wanted[w.rstrip("s"), block][key].append(i + 1)
    assert len(found) == len(wanted)
    for r in found:
        held = wanted[r["lexeme"], r["block"]]
        assert [(e["id"], e["positions"]) for e in r["entries"]] == sorted(held.items())
        assert r["n_docs"] == len(held) and r["most"] == max(map(len, held.values()))
    assert not list(textindex._posted(True)(iter(table.slice(0, 0).to_batches())))
