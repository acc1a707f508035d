"""The pipeline's lines stage on equal lines of under five words."""

import corpus_pipeline


def test_stage_folds_equal_lines_of_any_length(spark):
    long = "alpha beta gamma delta epsilon zeta"
    texts = [f"Read more\n{long}\n\nx", f"Read  more\nnew here\n\n{long} eta", "没有空格的一行\nread more", "没有空格的一行\nRead more\nRead mores", "Read more", "x\n\n"]
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, df, "").collect()}
    assert out == {0: texts[0], 1: "new here\n", 2: texts[2], 3: "Read mores"}
