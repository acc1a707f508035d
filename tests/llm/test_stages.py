"""The pipeline's stages on nulls, empties, ties, repeated rows and an empty table."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = " ".join(f"word{i}" for i in range(60))


def test_stages_take_odd_rows(spark):
    rows = [
        (None, GOOD, "en", None, None), (None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, " \n\t", "en", None, 3), (4, GOOD, "en", "a", None),
        (4, GOOD, "en", "a", None), (5, "x" * 70_000, "en", "b", 1), (6, GOOD + " more", None, "b", 1), (7, "short", "xx", "b", 5),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        found = out.collect()
        assert stage(spark, docs.where("false"), "").count() == 0
        if name != "packing":
            assert out.columns == docs.columns
        if name == "quality":
            assert {r.doc_id for r in found} <= {None, 4, 6}
        if name == "lines":
            # The null id comes first, so its line stays and those of 4 and 6 go with all their words.
            assert sorted(r.doc_id for r in found if r.doc_id is not None) == [1, 2, 3, 5, 7]
        if name == "near_duplicates":
            # Null and blank texts are one group; the good texts go with 4, whose two rows stay.
            assert sorted(r.doc_id for r in found if r.doc_id is not None) == [1, 4, 4, 5, 7] and sum(r.doc_id is None for r in found) == 2
        if name == "mixture":
            # Sources a, b and null weigh 1, 2 and 3, so of 303 words null is due 151, two epochs of 60 and a half.
            assert sum(r.doc_id is None and r.text == GOOD for r in found) in (2, 3) and {r.doc_id for r in found} <= {r[0] for r in rows}
        if name == "packing":
            assert sum(r.length for r in found if r.doc_id == 1) == 1 and sum(r.length for r in found if r.doc_id == 2) == 1
