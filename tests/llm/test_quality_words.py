"""Quality rules on documents whose words are not those of their label, or that have no label."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.quality import quality_verdicts

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def verdicts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(10)
    letters = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(2, 9)))
    noise = [(f"noise-{x}", i, " ".join(letters() for _ in range(200)), x) for i, x in enumerate(["en", None] * 20)]
    given = docs.select(F.lit("given").alias("kind"), "doc_id", "text", "lang")
    # Fewer than the labelled ones, so that the references stay those of the languages.
    few = given.where("doc_id % 5 = 0")
    wrong = few.where("lang <> 'en'").select(F.lit("wrong").alias("kind"), "doc_id", "text", F.lit("en").alias("lang"))
    bare = few.select(F.lit("bare").alias("kind"), "doc_id", "text", F.lit(None).cast("string").alias("lang"))
    made = spark.createDataFrame(noise, given.schema)
    return quality_verdicts(given.union(wrong).union(bare).union(made)).where("not base_failed and n_words >= 80").toPandas()


def test_other_languages_and_letters_fail(verdicts):
    of = verdicts.groupby("kind").kept.mean()
    assert of["wrong"] < 0.03 and of["noise-en"] == 0 and of["noise-None"] == 0


def test_documents_without_a_language_are_judged_by_the_nearest(spark, verdicts):
    given, bare = (verdicts[verdicts.kind == x].set_index("doc_id") for x in ("given", "bare"))
    assert not bare.word_distance.isna().any() and (bare.kept == given.kept[bare.index]).mean() > 0.97
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").quality
    good = labels[labels == 1].index
    assert given.kept[given.index.intersection(good)].mean() > 0.99 and bare.kept[bare.index.intersection(good)].mean() > 0.97
