"""The stored inverted index against searches without one, what its plans read, and what its block maxima spare."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import storage
from tessera.operators import fulltext, textindex
from tessera.operators.fulltext import term

WORDS = "cat cats dog dogs running run the of house houses red green blue river rivers stone".split()
QUERIES = [
    [["cat"]], [["cat", "dog"]], [["cat dog"]], [["cat"], ["river", "-stone"]], [["running the house"], ["red"]], [["blue", "-cat dog"]], [["the"]], [["zebra"]], [["zebra", "cat"]], [["-cat"]],
]


def structured(query):
    return [[term(w.lstrip("-"), negated=w.startswith("-")) for w in words] for words in query]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(WORDS, weights=range(1, len(WORDS) + 1), k=rng.randint(1, 60)))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "..."), (903, "cat"), (904, "cat"), (905, "Cat, DOG; cat-dog!")]
    return spark.createDataFrame(rows, "doc int, body string").repartition(5)


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index") / "a")
    textindex.build(texts, folder, id_col="doc", text="body", buckets=8, block=16)
    return textindex.TextIndex(spark, folder)


@pytest.mark.parametrize("query", QUERIES, ids=str)
def test_ranks_are_those_of_reading_every_text(texts, index, query):
    wanted = sorted(((r.doc, r.score) for r in fulltext.fulltext_scores(texts, structured(query), id_col="doc", text="body").collect()), key=lambda x: (-x[1], x[0]))
    for limit in (3, 20, 1000):
        found = index.search(structured(query), limit=limit, first=2)
        assert [(r.id, r.score) for r in found.rows.collect()] == wanted[:limit]
    even = index.documents().where("id % 2 = 0").select("id")
    found = index.search(structured(query), limit=5, allowed=even, first=2).rows.collect()
    assert [(r.id, r.score) for r in found] == [x for x in wanted if x[0] % 2 == 0][:5]


def test_only_buckets_of_the_query_are_read(index):
    plan = index.postings(["cat"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(lexeme,cat)" in plan
    files = lambda rows: rows.select(F.input_file_name().alias("f")).distinct().count()
    assert files(index.postings(["cat"])) == 1 < files(index.postings())
    assert index.postings(["cat"]).select("lexeme").distinct().collect() == [("cat",)]


def test_blocks_of_low_bounds_are_skipped(spark, tmp_path):
    rows = [(i, "word " * (1 + i % 3) + "filler " * i) for i in range(600)] + [(1000 + i, "word " * (40 + i) + "filler " * 700) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, body string")
    textindex.build(df, str(tmp_path / "b"), id_col="id", text="body", buckets=4, block=16)
    index = textindex.TextIndex(spark, str(tmp_path / "b"))
    found = index.search([[term("word")]], limit=10, first=2)
    assert found.read.count() <= 3 < 30 < found.blocks.count()
    assert [r.id for r in found.rows.collect()] == list(range(1019, 1009, -1))
    assert index.documents().groupBy("block").count().agg(F.max("count")).first()[0] <= 16


def test_words_without_stems(spark, texts, tmp_path):
    textindex.build(texts, str(tmp_path / "c"), id_col="doc", text="body", english=False, block=32)
    index = textindex.TextIndex(spark, str(tmp_path / "c"))
    found = index.search([[fulltext.Term(("cats",)), fulltext.Term(("the",))]], limit=7, count=True, first=1).rows.collect()
    counts = {r.doc: (r.body or "").lower().split() for r in texts.collect()}
    wanted = sorted(((-(w.count("cats") + w.count("the")), d) for d, w in counts.items() if "cats" in w and "the" in w))[:7]
    assert [(-r.score, r.id) for r in found] == [(float(s), d) for s, d in wanted]


def test_what_is_kept_follows_its_source(spark, tmp_path):
    source, built = str(tmp_path / "t.parquet"), []
    spark.range(3).write.parquet(source)

    def build(folder):
        built.append(folder)
        spark.read.parquet(source).write.parquet(f"{folder}/x")

    first = storage.kept(spark, "test", source, build)
    assert storage.kept(spark, "test", source, build) == first and built == [first]
    spark.range(5).write.mode("append").parquet(source)
    second = storage.kept(spark, "test", source, build)
    assert second != first and spark.read.parquet(f"{second}/x").count() == 8
    with pytest.raises(RuntimeError, match="half"):
        storage.kept(spark, "broken", source, lambda folder: (_ for _ in ()).throw(RuntimeError("half")))
    assert spark.read.parquet(f"{storage.kept(spark, 'broken', source, build)}/x").count() == 8
