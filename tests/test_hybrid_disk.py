"""The English hybrid search over a table that has no index yet: what it moves, and that it finds what reading every text finds."""

from pathlib import Path

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import fulltext, retrieval
from tessera.plans import registry, search
from tessera.sources.adapters import Domain
from tests.moved import moved

SF = "/root/testdata/sf0.01"


def test_a_first_search_moves_texts_once(spark, tmp_path):
    for p in Path(SF).iterdir():
        (tmp_path / p.name).symlink_to(p)
    d = Domain(spark, str(tmp_path))
    size = d.raw("documents").agg(F.sum(F.octet_length("text"))).first()[0]
    before = moved(spark)
    found = registry.QUERIES["hybrid_search_english"](spark, str(tmp_path)).collect()
    assert moved(spark) - before < size
    texts = registry.FILTERS.apply(d.sections()).select("doc_id", "content")
    order = Window.orderBy(F.desc("score"), "doc_id")
    words = fulltext.fulltext_scores(texts, search.TEXT_QUERY, id_col="doc_id", text="content").orderBy(F.desc("score"), "doc_id").limit(50).withColumn("rank", F.row_number().over(order))
    wanted = retrieval.fuse(words, registry.near_filtered(d), id_col="doc_id").collect()
    assert [(r.doc_id, r.keyword_rank, r.semantic_rank, r.matched_by) for r in found] == [(r.doc_id, r.keyword_rank, r.semantic_rank, r.matched_by) for r in wanted]
