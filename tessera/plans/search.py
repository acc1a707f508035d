"""Queries over English full text, and the steps around retrieval that feed and use it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.embedding import hashed_embedding
from tessera.functions.storage import broadcast_if_small, kept, stored
from tessera.operators import contracts, documents, retrieval, store, vectorindex
from tessera.operators.fulltext import term
from tessera.plans import registry
from tessera.plans.registry import query
from tessera.sources.adapters import Domain

fixed = registry.fixed

#: A question and its terms: a phrase, or two words that must occur together without a third.
QUESTION = '"th ing" or thing ther -ble'
TEXT_QUERY = [[term("th ing")], [term("thing"), term("ther"), term("ble", negated=True)]]
#: Chunks that one backfill run embeds at most.
RUN_LIMIT = 10_000


@query()
def fulltext_postings(d: Domain) -> DataFrame:
    """Stems of all documents with their positions, from the stored index."""
    rows = registry.text_index(d, english=True).postings()
    return rows.select("lexeme", F.explode("entries").alias("e")).select(F.col("e.id").alias("doc_id"), "lexeme", "e.positions")


@query("""select word as lexeme, count(*) as n_docs, sum(n)::bigint as n_occurrences, max(n)::int as most from (select doc_id, word, count(*) as n
    from (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as word from documents) group by all) group by word""")
def word_index_counts(d: Domain) -> DataFrame:
    """For each word of the stored index: the documents that hold it, its occurrences, and the most in one document, from the rows of its blocks."""
    rows = registry.text_index(d, english=False).postings()
    occurrences = F.aggregate("entries", F.lit(0), lambda n, e: n + F.size(e["positions"]))
    return rows.groupBy("lexeme").agg(F.sum("n_docs").alias("n_docs"), F.sum(occurrences).alias("n_occurrences"), F.max("most").alias("most"))


def _english(d: Domain) -> tuple[DataFrame, DataFrame]:
    allowed = registry.FILTERS.apply(d.sections()).select(F.col("doc_id").alias("id"))
    return retrieval.fulltext_channel(registry.text_index(d, english=True), TEXT_QUERY, allowed=allowed, id_col="doc_id", limit=50), registry.near_filtered(d)


@query()
def keyword_rank(d: Domain) -> DataFrame:
    """Filtered sections that match a structured query, by cover density."""
    return _english(d)[0].select("doc_id", "rank", fixed(F.col("score")).alias("score"))


@query()
def semantic_search_indexed(d: Domain) -> DataFrame:
    """The vector channel of ``semantic_search`` from the stored index: cells read of those there are, and the recall of 50 that the build measured."""
    model = lambda: d.vectors().where("embedding_model = 'model-0'")
    build = lambda folder: vectorindex.build(model(), folder, id_col="doc_id", vector="embedding", recall=0.95, k=50)
    index = vectorindex.VectorIndex(d.spark, kept(d.spark, "vectors-model-0", f"{d.folder}/embeddings.parquet", build))
    asked = contracts.query_vector(d.vectors().where("doc_id = 0").select("embedding"), 64)
    allowed = registry.FILTERS.apply(d.sections()).select(F.col("doc_id").alias("id"))
    found = index.search(asked, limit=50, allowed=allowed)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    return found.rows.select(
        F.col("id").alias("doc_id"), place.alias("rank"), fixed(F.col("score")).alias("score"), F.lit(found.read).alias("cells_read"), F.lit(found.cells).alias("cells"),
        fixed(F.lit(index.recall)).alias("recall"),
    )


def _hybrid(d: Domain) -> DataFrame:
    return retrieval.fuse(*_english(d), id_col="doc_id")


@query()
def hybrid_search_english(d: Domain) -> DataFrame:
    """Full-text and vector channels under shared filters, fused."""
    return _hybrid(d).select("doc_id", fixed(F.col("score"), 9).alias("score"), "keyword_rank", "semantic_rank", "matched_by")


@query()
def generation_envelope(d: Domain) -> DataFrame:
    """What a generator is given, one JSON text for each company found: numbered evidence and the company's latest facts.

    Evidence is bounded by the search's results and facts by 20 a company; dates are ISO, decimals plain. Only the companies found are looked up:
    their filings are broadcast to the facts if they are few.
    """
    found = stored(_hybrid(d).select("doc_id", "score"))
    place = F.row_number().over(Window.partitionBy("cik").orderBy(F.desc("score"), "doc_id"))
    cited = d.sections(found).join(F.broadcast(found), "doc_id").withColumn("n", place)
    piece = F.struct("n", F.concat(F.lit("E"), F.col("n").cast("string")).alias("id"), "accession_number", "form_type", F.date_format("filing_date", "yyyy-MM-dd").alias("filing_date"), "section_name", "content")
    evidence = stored(cited.groupBy("cik").agg(F.array_sort(F.collect_list(piece)).alias("e")))
    of = lambda rows: rows.join(F.broadcast(evidence.select("cik")), "cik", "left_semi")
    filings = broadcast_if_small(stored(of(d.filings())), 200)
    latest = registry.latest_facts(d.facts_raw(filings), F.broadcast(of(d.companies())))
    order = Window.partitionBy("cik").orderBy(F.desc("filed_date"), F.desc("end_date"), "concept", "observation_key")
    fact = F.struct("n", F.concat(F.lit("F"), F.col("n").cast("string")).alias("id"), "concept", F.col("value").cast("string").alias("value"), F.date_format("end_date", "yyyy-MM-dd").alias("end_date"), "accession_number")
    facts = latest.withColumn("n", F.row_number().over(order)).groupBy("cik").agg(F.array_sort(F.collect_list(fact)).alias("f"))
    both = facts.join(F.broadcast(evidence), "cik", "right")
    body = F.struct(F.lit(QUESTION).alias("question"), F.transform("e", lambda x: x.dropFields("n")).alias("evidence"), F.transform(F.coalesce("f", F.array()), lambda x: x.dropFields("n")).alias("facts"))
    return both.select("cik", F.to_json(body).alias("envelope"))


@query()
def embed_backfill(d: Domain) -> DataFrame:
    """One run of the backfill: the first pending chunks by id get vectors of the wanted model.

    A vector is written only where the chunk still has the text that was read.
    """
    chunks = documents.token_windows(d.raw("documents"), doc="doc_id", text="text").withColumn("content_hash", F.sha2("content", 256))
    chunks = chunks.join(d.vectors().withColumn("chunk_index", F.lit(0)), ["doc_id", "chunk_index"], "left")
    stale = F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe("model-1")
    batch = chunks.where(stale).orderBy("doc_id", "chunk_index").limit(RUN_LIMIT)
    keys = ["doc_id", "chunk_index", "content_hash"]
    made = batch.select(*keys, hashed_embedding(F.col("content")).alias("embedding"), F.lit("model-1").alias("embedding_model")).where("embedding is not null")
    target = chunks.select(*keys, "embedding", "embedding_model")
    return store.optimistic_update(target, made, keys, ["embedding", "embedding_model"]).where("updated").select("doc_id", "chunk_index", "embedding_model", "embedding")
