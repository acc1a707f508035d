"""All queries of the library, with their SQL equivalents."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import identity
from tessera.functions.storage import kept
from tessera.operators import answers, documents, evaluation, experiments, retrieval, store, textindex
from tessera.plans.views import retrieval_sql, with_views
from tessera.sources.adapters import Domain

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "hybrid_search"

SECRET = "an-example-secret-of-more-than-32-characters"
PLAN = "plan-fingerprint"
ARMS = [("control", 5000), ("treatment", 5000)]
METRICS = {"converted": "binary", "failed": "binary", "click_value": "continuous"}
TOP_K = 10
TERMS = ["the", "of"]
START, END = datetime.date(1995, 1, 1), datetime.date(1997, 12, 31)


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Domain(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def fixed(value, digits: int = 6):
    """A double as a decimal, so that two engines' last bits do not matter."""
    return F.round(value, digits).cast(f"decimal(28,{digits})")


def sql_fixed(value: str, digits: int = 6) -> str:
    return f"round({value}, {digits})::decimal(28,{digits})"


# --- sources and ingestion


@query(with_views("""select accession_number, 'https://filings.example/' || (cik::bigint)::varchar || '/' || replace(accession_number, '-', '') || '/' || primary_document as source_url
    from filings where starts_with(accession_number, cik || '-') and not regexp_matches(primary_document, '[/\\\\]') and primary_document not in ('.', '..')""", "filings"))  # fmt: skip
def filing_source_url(d: Domain) -> DataFrame:
    """Addresses of primary documents, for accession numbers that start with the issuer's key and file names that are no paths."""
    name = F.col("primary_document")
    safe = ~name.rlike(r"[/\\]") & ~name.isin(".", "..")
    ours = d.filings().where(F.expr("startswith(accession_number, concat(cik, '-'))")).where(safe)
    path = F.concat_ws("/", F.lit("https://filings.example"), F.col("cik").cast("bigint").cast("string"), F.regexp_replace("accession_number", "-", ""), "primary_document")
    return ours.select("accession_number", path.alias("source_url"))


@query(with_views("select cik, (row_number() over (partition by cik order by accession_number) - 1)::int as ordinal, accession_number, form_type, filing_date from filings", "filings"))
def filings_transpose(d: Domain) -> DataFrame:
    """Filings with their place in their company's document (``submissions_read`` reads its parallel arrays)."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("cik").orderBy("accession_number"))
    return d.filings().select("cik", (place - 1).alias("ordinal"), "accession_number", "form_type", "filing_date")


@query("""select c_custkey, case when regexp_full_match(trim(c_phone), '[0-9]{1,10}') then lpad(trim(c_phone), 10, '0') end as cik
    from (select c_custkey, case when c_acctbal < 0 then ' ' || c_custkey::varchar || ' ' when c_acctbal > 5000 then 'x' || c_name else '00000' || c_custkey::varchar || '00000' end as c_phone from customer)""")
def normalize_cik(d: Domain) -> DataFrame:
    """Issuer keys in normal form; what is no key (letters, too many digits) gives null."""
    key = F.col("c_custkey").cast("string")
    text = F.when(F.col("c_acctbal") < 0, F.concat(F.lit(" "), key, F.lit(" "))).when(F.col("c_acctbal") > 5000, F.concat(F.lit("x"), "c_name")).otherwise(F.concat(F.lit("00000"), key, F.lit("00000")))
    return d.raw("customer").select("c_custkey", identity.normalized_cik(text).alias("cik"))


@query(with_views("""select cik, accession_number, form_type from filings where form_type in ('10-K', '10-Q')
    qualify row_number() over (partition by cik order by accession_number) <= 5""", "filings"))  # fmt: skip
def select_filings(d: Domain) -> DataFrame:
    """Of each company, the first five filings of the wanted forms in the order of its document (see ``filings_transpose``)."""
    from pyspark.sql import Window

    forms = sorted({x.strip().upper() for x in (" 10-k", "10-Q")})
    wanted = d.filings().where(F.upper("form_type").isin(*forms))
    place = F.row_number().over(Window.partitionBy("cik").orderBy("accession_number"))
    return wanted.withColumn("n", place).where("n <= 5").select("cik", "accession_number", "form_type")


@query(r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as text from documents")
def normalize_text(d: Domain) -> DataFrame:
    return d.raw("documents").select("doc_id", documents.normalized_text(F.col("text")).alias("text"))


_BLOCKS = "select doc_id, (generate_subscripts(l, 1) - 1)::int as block_no, unnest(l) as block from (select doc_id, string_split(text, chr(10)) as l from documents)"
_HEAD = r"length(block) <= 40"


@query(r"""select doc_id, block_no, length(block) <= 200 and regexp_matches(block, '^(?:part\s+[ivx]+|item\s+(?:[0-9]{1,2}[a-z]?|[ivx]+)(?:\.|\s|:|-).{0,170})$', 'i') as is_heading
    from (select doc_id, block_no, case when length(block) < 40 then 'Item ' || (length(block) % 20)::varchar || 'A. ' || block when length(block) < 60 then 'Part ' || block else block end as block from (""" + _BLOCKS + "))")
def heading_detection(d: Domain) -> DataFrame:
    """Heading lines among blocks (short lines are given a heading's or nearly a heading's form)."""
    n = F.length("block")
    shaped = F.when(n < 40, F.concat(F.lit("Item "), (n % 20).cast("string"), F.lit("A. "), "block")).when(n < 60, F.concat(F.lit("Part "), "block")).otherwise(F.col("block"))
    return _blocks(d).select("doc_id", "block_no", documents.is_heading(shaped).alias("is_heading"))


def _blocks(d: Domain) -> DataFrame:
    return d.raw("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_no", "block"))


@query(f"""with b as (select *, sum(({_HEAD})::int) over (partition by doc_id order by block_no) as s from ({_BLOCKS})),
    p as (select doc_id, s, max(case when {_HEAD} then block end) as name, string_agg(block, chr(10) || chr(10) order by block_no) filter (not ({_HEAD})) as content from b group by doc_id, s)
    select doc_id, (row_number() over (partition by doc_id order by s) - 1)::int as sequence_number, coalesce(name, 'Document') as section_name, content, length(content)::int as char_count from p where content is not null""")
def sectionize(d: Domain) -> DataFrame:
    """Sections of documents whose short lines stand for headings."""
    marked = _blocks(d).withColumn("heading", F.length("block") <= 40)
    return documents.sectionize(marked, doc="doc_id", place="block_no", text="block", heading="heading")


@query(with_views("select doc_id, chunk_index, token_count, sha256(content) as content_hash from chunks", "chunks"))
def chunk_documents(d: Domain) -> DataFrame:
    chunks = documents.token_windows(d.raw("documents"), doc="doc_id", text="text")
    return chunks.select("doc_id", "chunk_index", "token_count", F.sha2("content", 256).alias("content_hash"))


@query("select doc_id, sha256(text) as content_hash from documents")
def content_hashes(d: Domain) -> DataFrame:
    return d.raw("documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query(with_views("""select (select count(*) from filings) as discovered, (select count(*) from filings where form_type in ('10-K', '10-Q')) as selected,
    (select count(*) from filings where form_type = '10-Q') as created, (select count(*) from filings where form_type = '10-K') as skipped_existing,
    (select count(*) from filings where form_type = '10-Q') as downloaded, (select count(*) from sections where form_type = '10-Q') as sections,
    (select count(*) from chunks) as chunks""", "filings", "sections", "chunks"))  # fmt: skip
def ingestion_summary(d: Domain) -> DataFrame:
    """Counts of one ingestion run in which the 10-K filings are stored already."""
    filings = d.filings()
    selected = filings.where(F.col("form_type").isin("10-K", "10-Q"))
    created = store.insert_if_absent(filings.where(F.col("form_type") == "10-K"), selected, ["accession_number"])
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    chunks = documents.token_windows(d.raw("documents"), doc="doc_id", text="text")
    sections = d.sections().where("form_type = '10-Q'")
    row = n(filings, "discovered").crossJoin(n(selected, "selected")).crossJoin(n(created, "created")).crossJoin(n(sections, "sections")).crossJoin(n(chunks, "chunks"))
    return row.select(
        "discovered", "selected", "created", (F.col("selected") - F.col("created")).alias("skipped_existing"), F.col("created").alias("downloaded"), "sections", "chunks"
    )


# --- facts


@query(with_views("select observation_key, count(*) as n, sum(value) as total from facts_raw group by observation_key", "facts_raw"))
def observation_keys(d: Domain) -> DataFrame:
    """Identities of reported facts, with the rows and the sum behind each."""
    return d.facts_raw().groupBy("observation_key").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def _facts(d: Domain) -> DataFrame:
    return store.first_wins(d.facts_raw(), ["observation_key"], "source_order")


@query(with_views("select observation_key, cik, concept, fiscal_year, value from facts", "facts"))
def facts_idempotent_insert(d: Domain) -> DataFrame:
    """The first row of each identity in source order; later ones count as existing."""
    return _facts(d).select("observation_key", "cik", "concept", "fiscal_year", "value")


@query(with_views("""select taxonomy, count(*) as observations, count(distinct observation_key) as created, count(*) - count(distinct observation_key) as existing from facts_raw group by taxonomy""", "facts_raw"))
def facts_summary(d: Domain) -> DataFrame:
    n, made = F.count(F.lit(1)), F.count_distinct("observation_key")
    return d.facts_raw().groupBy("taxonomy").agg(n.alias("observations"), made.alias("created"), (n - made).alias("existing"))


@query(with_views("""select f.cik, c.legal_name, concept, fiscal_year, value, end_date, filed_date, form_type, accession_number, observation_key from facts f join companies c using (cik)
    where concept in ('FlagA', 'FlagR') qualify row_number() over (partition by f.cik order by filed_date desc, end_date desc, concept, observation_key) <= 20""", "facts", "companies"))
def financial_facts_latest(d: Domain) -> DataFrame:
    """Each company's latest facts: by filing date, period end, concept and identity."""
    return latest_facts(d.facts_raw(), d.companies())


def latest_facts(facts: DataFrame, companies: DataFrame) -> DataFrame:
    """The latest 20 of ``facts`` for each of ``companies``, as ``financial_facts_latest`` has them."""
    from pyspark.sql import Window

    order = Window.partitionBy("cik").orderBy(F.desc("filed_date"), F.desc("end_date"), "concept", "observation_key")
    # The concept is part of a fact's identity, so the filter may go before the removal of repeated deliveries.
    wanted = facts.where(F.col("concept").isin("FlagA", "FlagR"))
    named = store.first_wins(wanted, ["observation_key"], "source_order").join(companies.select("cik", "legal_name"), "cik")
    best = named.withColumn("n", F.row_number().over(order)).where("n <= 20")
    return best.select("cik", "legal_name", "concept", "fiscal_year", "value", "end_date", "filed_date", "form_type", "accession_number", "observation_key")


@query(with_views(r"""select observation_key, concat_ws(',', case when not regexp_full_match(accession_number, '[0-9]{10}-[0-9]{2}-[0-9]{6}') then 'accession_number' end,
    case when end_date < filed_date then 'end_date' end, case when value < 10000 then 'value' end) as violated from facts""", "facts"))  # fmt: skip
def fact_contract_violations(d: Domain) -> DataFrame:
    """Names of the rules that a fact violates, in a fixed order."""
    rules = {"accession_number": F.col("accession_number").rlike("^[0-9]{10}-[0-9]{2}-[0-9]{6}$"), "end_date": F.col("end_date") >= F.col("filed_date"), "value": F.col("value") >= 10000}
    return _facts(d).select("observation_key", store.violations(rules).alias("violated"))


@query(with_views(f"""select cik, concept, fiscal_year, {sql_fixed('(total - previous)::double / abs(previous)::double * 100')} as change from (
    select cik, concept, fiscal_year, total, lag(total) over (partition by cik, concept order by fiscal_year) as previous from (select cik, concept, fiscal_year, sum(value) as total from facts group by all))
    where previous <> 0""", "facts"))  # fmt: skip
def period_over_period(d: Domain) -> DataFrame:
    """Percentage change of a concept against the company's previous reported year."""
    from pyspark.sql import Window

    totals = _facts(d).groupBy("cik", "concept", "fiscal_year").agg(F.sum("value").alias("total"))
    previous = F.lag("total").over(Window.partitionBy("cik", "concept").orderBy("fiscal_year"))
    change = (F.col("total") - F.col("previous")).cast("double") / F.abs("previous").cast("double") * 100
    return totals.withColumn("previous", previous).where("previous <> 0").select("cik", "concept", "fiscal_year", fixed(change).alias("change"))


# --- snapshots


@query(with_views("""select coalesce(i.cik, e.cik) as cik, coalesce(i.legal_name, e.legal_name) as legal_name, coalesce(i.sic, e.sic) as sic
    from (select * from companies where sic < '0015') e full join (select cik, upper(legal_name) as legal_name, sic from companies where sic >= '0010') i on e.cik = i.cik""", "companies"))  # fmt: skip
def company_upsert(d: Domain) -> DataFrame:
    """Companies of one batch replace the attributes of stored ones (nations overlap between the two)."""
    c = d.companies()
    return store.upsert(c.where("sic < '0015'"), c.where("sic >= '0010'").withColumn("legal_name", F.upper("legal_name")), "cik", ["legal_name", "sic"])


@query(with_views("select accession_number from filings where form_type = '10-K' and cik in (select cik from companies where sic < '0010')", "filings", "companies"))
def existing_accessions(d: Domain) -> DataFrame:
    stored = d.filings().where(F.col("form_type") == "10-K")
    return stored.join(d.companies().where("sic < '0010'"), "cik", "left_semi").select("accession_number")


@query(with_views("select accession_number, form_type, filing_date from filings where accession_number = (select max(accession_number) from filings)", "filings"))
def filing_lookup(d: Domain) -> DataFrame:
    """A filing by its unique key."""
    f = d.filings()
    return f.join(F.broadcast(f.agg(F.max("accession_number").alias("accession_number"))), "accession_number").select("accession_number", "form_type", "filing_date")


@query(with_views("select accession_number, form_type from filings where form_type <> '10-K'", "filings"))
def filing_insert_if_absent(d: Domain) -> DataFrame:
    f = d.filings()
    return store.insert_if_absent(f.where(F.col("form_type") == "10-K"), f, ["accession_number"]).select("accession_number", "form_type")


@query(with_views("""select accession_number, concat_ws(',', case when form_type = '8-K' then 'form_type' end, case when filing_date < date '1996-01-01' then 'filing_date' end) as fields
    from filings where form_type = '8-K' or filing_date < date '1996-01-01'""", "filings"))
def filing_identity_conflicts(d: Domain) -> DataFrame:
    """Immutable fields in which a second delivery differs (8-K refiled as amended, early dates moved)."""
    f = d.filings()
    again = f.withColumn("form_type", F.when(F.col("form_type") == "8-K", "8-K/A").otherwise(F.col("form_type"))).withColumn(
        "filing_date", F.when(F.col("filing_date") < F.lit(datetime.date(1996, 1, 1)), F.date_add("filing_date", 1)).otherwise(F.col("filing_date"))
    )
    return store.identity_conflicts(f, again, "accession_number", ["cik", "form_type", "filing_date", "primary_document"])


@query(with_views("""select c.doc_id, c.chunk_index from chunks c join sections s using (doc_id) left join vectors v on v.doc_id = c.doc_id and c.chunk_index = 0
    where v.embedding is null or v.embedding_model is distinct from 'model-1'""", "chunks", "sections", "vectors"))
def pending_embeddings(d: Domain) -> DataFrame:
    """Chunks of filed documents that lack a vector of the wanted model."""
    chunks = documents.token_windows(d.raw("documents"), doc="doc_id", text="text").join(d.sections().select("doc_id"), "doc_id")
    vectors = d.vectors().withColumn("chunk_index", F.lit(0))
    joined = chunks.join(vectors, ["doc_id", "chunk_index"], "left")
    return joined.where(F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe("model-1")).select("doc_id", "chunk_index")


@query("""select d.doc_id, sha256(text) as content_hash, case when lang = 'en' then 'new' else 'old' end as embedding_model, lang = 'en' as updated from documents d""")
def embedding_optimistic_update(d: Domain) -> DataFrame:
    """Updates take effect only where id and content hash still match (other languages' texts have moved on)."""
    target = d.raw("documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.lit("old").alias("embedding_model"))
    stale = F.when(F.col("lang") == "en", F.col("text")).otherwise(F.concat("text", F.lit("!")))
    updates = d.raw("documents").select("doc_id", F.sha2(stale, 256).alias("content_hash"), F.lit("new").alias("embedding_model"))
    return store.optimistic_update(target, updates, ["doc_id", "content_hash"], ["embedding_model"])


# --- retrieval

FILTERS = retrieval.Filters(forms=("10-K", "10-q"), filed_from=START, filed_to=END)
_FILTERED = f"select * from sections where form_type in ('10-K', '10-Q') and filing_date between date '{START}' and date '{END}'"
_COUNTS = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) as c{i}" for i, t in enumerate(TERMS))
_KEYWORD = f"""select doc_id, score, row_number() over (order by score desc, doc_id)::int as rank from (select doc_id, (c0 + c1)::double as score from (
    select doc_id, {_COUNTS} from (select doc_id, regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+') as w from filtered)) where c0 > 0 and c1 > 0) order by score desc, doc_id limit 50"""
_SEMANTIC = """select doc_id, score, row_number() over (order by score desc, doc_id)::int as rank from (select v.doc_id, list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)) as score
    from vectors v join filtered using (doc_id) where embedding_model = 'model-0') order by score desc, doc_id limit 50"""


def text_index(d: Domain, *, english: bool) -> textindex.TextIndex:
    """The stored index of all documents, built by the first query that needs it."""
    build = lambda folder: textindex.build(d.raw("documents"), folder, id_col="doc_id", text="text", english=english)
    return textindex.TextIndex(d.spark, kept(d.spark, "stems" if english else "words", f"{d.folder}/documents.parquet", build))


def _words(d: Domain) -> DataFrame:
    allowed = FILTERS.apply(d.sections()).select(F.col("doc_id").alias("id"))
    return retrieval.keyword_channel(text_index(d, english=False), TERMS, allowed=allowed, id_col="doc_id", limit=50)


def near_filtered(d: Domain) -> DataFrame:
    probe = d.vectors().where("doc_id = 0").select(F.col("embedding").alias("q"))
    filtered = FILTERS.apply(d.sections()).select("doc_id")
    return retrieval.semantic_channel(filtered.join(d.vectors(), "doc_id"), probe, id_col="doc_id", model="model-0", limit=50)


@query(with_views("select doc_id, accession_number, form_type, filing_date, section_name from filtered", "sections", filtered=_FILTERED))
def filing_metadata_filter(d: Domain) -> DataFrame:
    return FILTERS.apply(d.sections()).select("doc_id", "accession_number", "form_type", "filing_date", "section_name")


@query(with_views(f"select doc_id, rank, {sql_fixed('score')} as score from ({_KEYWORD})", "sections", filtered=_FILTERED))
def keyword_search(d: Domain) -> DataFrame:
    return _words(d).select("doc_id", "rank", fixed(F.col("score")).alias("score"))


@query(with_views(f"select doc_id, rank, {sql_fixed('score')} as score from ({_SEMANTIC})", "sections", "vectors", filtered=_FILTERED))
def semantic_search(d: Domain) -> DataFrame:
    return near_filtered(d).select("doc_id", "rank", fixed(F.col("score")).alias("score"))


_FUSED = """select doc_id, coalesce(1.0::double / (60 + k.rank), 0) + coalesce(1.0::double / (60 + s.rank), 0) as score, k.rank as keyword_rank, s.rank as semantic_rank,
    concat_ws(',', case when k.rank is not null then 'keyword' end, case when s.rank is not null then 'semantic' end) as matched_by
    from keyword k full join semantic s using (doc_id) order by score desc, coalesce(s.rank, 201), coalesce(k.rank, 201), doc_id limit 20"""


@query(with_views(f"select doc_id, {sql_fixed('score', 9)} as score, keyword_rank, semantic_rank, matched_by from ({_FUSED})", "sections", "vectors", filtered=_FILTERED, keyword=_KEYWORD, semantic=_SEMANTIC))
def rrf_fusion(d: Domain) -> DataFrame:
    fused = retrieval.fuse(_words(d), near_filtered(d), id_col="doc_id")
    return fused.select("doc_id", fixed(F.col("score"), 9).alias("score"), "keyword_rank", "semantic_rank", "matched_by")


@query(with_views(f"select f.doc_id, {sql_fixed('f.score', 9)} as score, matched_by, accession_number, form_type, filing_date, section_name, sha256(content) as content_hash from ({_FUSED}) f join sections using (doc_id)", "sections", "vectors", filtered=_FILTERED, keyword=_KEYWORD, semantic=_SEMANTIC))
def hybrid_search(d: Domain) -> DataFrame:
    """Both channels under shared filters, fused, with the citation of each result."""
    fused = retrieval.fuse(_words(d), near_filtered(d), id_col="doc_id")
    cited = d.sections().join(F.broadcast(fused), "doc_id")
    return cited.select("doc_id", fixed(F.col("score"), 9).alias("score"), "matched_by", "accession_number", "form_type", "filing_date", "section_name", F.sha2("content", 256).alias("content_hash"))


# --- answers


@query("select conv_id, turn, 'E' || row_number() over (partition by conv_id order by turn)::varchar as evidence_id from conversations where role = 'assistant'")
def evidence_ids(d: Domain) -> DataFrame:
    """Ids that are local to a request, in rank order."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return d.raw("conversations").where("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("E"), n.cast("string")).alias("evidence_id"))


_CITED = "select conv_id, turn, (conv_id * 7 + turn) as doc_id from conversations where role = 'assistant'"


@query(f"select conv_id, turn, doc_id as citation from ({_CITED}) c where not exists (select 1 from labels l where l.doc_id = c.doc_id)")
def unknown_citations(d: Domain) -> DataFrame:
    """Citations of sources outside the known set."""
    cited = d.raw("conversations").where("role = 'assistant'").selectExpr("conv_id", "turn", "conv_id * 7 + turn as doc_id")
    return cited.join(d.raw("labels").select("doc_id"), "doc_id", "left_anti").select("conv_id", "turn", F.col("doc_id").alias("citation"))


@query("""select conv_id, case when max((role = 'system')::int) = 1 then 'needs_review' when sum((role = 'assistant')::int) = 0 then 'insufficient_evidence' else 'grounded' end as status
    from conversations group by conv_id""")
def answer_status(d: Domain) -> DataFrame:
    """A failed check asks for review; no claim is insufficient evidence; else the answer is grounded."""
    failed, claims = F.max((F.col("role") == "system").cast("int")), F.sum((F.col("role") == "assistant").cast("int"))
    status = F.when(failed == 1, "needs_review").when(claims == 0, "insufficient_evidence").otherwise("grounded")
    return d.raw("conversations").groupBy("conv_id").agg(status.alias("status"))


@query("select conv_id, arg_max(role, turn) as status, arg_max(role, turn) = 'assistant' as release_authorized from conversations group by conv_id")
def workflow_status(d: Domain) -> DataFrame:
    """The latest state of each thread."""
    latest = F.max_by("role", "turn")
    return d.raw("conversations").groupBy("conv_id").agg(latest.alias("status"), (latest == "assistant").alias("release_authorized"))


@query("""select conv_id, 'turn:' || turn::varchar as feedback_key, (1 + length(text) % 5)::int as evidence_quality from conversations where role = 'user'""")
def feedback_idempotent(d: Domain) -> DataFrame:
    """Feedback delivered twice is stored once, by thread and key."""
    rows = d.raw("conversations").where("role = 'user'").select("conv_id", F.concat(F.lit("turn:"), F.col("turn").cast("string")).alias("feedback_key"), (F.length("text") % 5 + 1).alias("evidence_quality"), F.lit(0).alias("delivery"))
    twice = rows.union(rows.withColumn("delivery", F.lit(1)))
    return store.first_wins(twice, ["conv_id", "feedback_key"], "delivery").drop("delivery")


# --- evaluation


def _metrics(d: Domain, system: str) -> DataFrame:
    return evaluation.retrieval_metrics(d.judgments(), d.ranked(system), TOP_K)


def _case_metric(name: str, metric: str) -> None:
    sql = with_views(f"select case_id, {sql_fixed('value')} as value from m where metric = '{metric}'", "judgments", "ranked_control", m=retrieval_sql("ranked_control", TOP_K))

    def run(d: Domain) -> DataFrame:
        return _metrics(d, "control").where(F.col("metric") == metric).select("case_id", fixed(F.col("value")).alias("value"))

    run.__name__ = name
    query(sql)(run)


_case_metric("eval_recall_at_k", "recall")
_case_metric("eval_mrr", "reciprocal_rank")
_case_metric("eval_ndcg", "ndcg")

_PAIR = {"c": retrieval_sql("ranked_control", TOP_K), "t": retrieval_sql("ranked_treatment", TOP_K)}
_PAIRED = "select metric, case_id, c.value as control, t.value as treatment, t.value - c.value as delta from c join t using (case_id, metric)"
_SYSTEMS = ("judgments", "ranked_control", "ranked_treatment")


@query(with_views(f"select metric, {sql_fixed('avg(value)')} as value, {sql_fixed('sum(value)')} as numerator, count(*) as denominator from t group by metric", *_SYSTEMS, **_PAIR))
def eval_system_report(d: Domain) -> DataFrame:
    return evaluation.system_report(_metrics(d, "treatment")).select("metric", fixed(F.col("value")).alias("value"), fixed(F.col("numerator")).alias("numerator"), "denominator")


@query(with_views(f"select metric, case_id, {sql_fixed('delta')} as delta from ({_PAIRED})", *_SYSTEMS, **_PAIR))
def eval_paired_deltas(d: Domain) -> DataFrame:
    return evaluation.paired(_metrics(d, "control"), _metrics(d, "treatment")).select("metric", "case_id", fixed(F.col("delta")).alias("delta"))


@query(with_views(f"select metric, {sql_fixed('avg(delta) / nullif(stddev_samp(delta), 0)', 4)} as effect_size, {sql_fixed('avg(delta) / nullif(abs(avg(control)), 0)', 4)} as relative_delta from ({_PAIRED}) group by metric", *_SYSTEMS, **_PAIR))
def eval_effect_size(d: Domain) -> DataFrame:
    pairs = evaluation.paired(_metrics(d, "control"), _metrics(d, "treatment"))
    nonzero = lambda x: F.nullif(x, F.lit(0.0))
    return pairs.groupBy("metric").agg(
        fixed(F.avg("delta") / nonzero(F.stddev_samp("delta")), 4).alias("effect_size"), fixed(F.avg("delta") / nonzero(F.abs(F.avg("control"))), 4).alias("relative_delta")
    )


@query()
def eval_comparison(d: Domain) -> DataFrame:
    """Bootstrap intervals and sign tests, from a seeded generator that SQL does not have."""
    return evaluation.comparison(evaluation.paired(_metrics(d, "control"), _metrics(d, "treatment")))


@query(f"select event_type, {sql_fixed('quantile_cont(value, 0.5)')} as p50, {sql_fixed('quantile_cont(value, 0.95)')} as p95, count(*) as n from events group by event_type")
def eval_latency_percentiles(d: Domain) -> DataFrame:
    """Exact percentiles with linear interpolation, by selection."""
    found = evaluation.percentiles(d.raw("events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})
    return found.select("event_type", fixed(F.col("p50")).alias("p50"), fixed(F.col("p95")).alias("p95"), "n")


@query("""select 'missing' as kind, item_id as case_id from benchmark where item_id not in (select conv_id from conversations) union all
    select 'unexpected', conv_id from (select distinct conv_id from conversations) where conv_id not in (select item_id from benchmark)""")
def eval_case_mismatch(d: Domain) -> DataFrame:
    """Cases without an observation, and observations without a case."""
    cases, seen = d.raw("benchmark").select(F.col("item_id").alias("case_id")), d.raw("conversations").select(F.col("conv_id").alias("case_id")).distinct()
    side = lambda a, b, kind: a.join(b, "case_id", "left_anti").select(F.lit(kind).alias("kind"), "case_id")
    return side(cases, seen, "missing").union(side(seen, cases, "unexpected"))


@query(f"""select (conv_id % (select count(*) from benchmark)) as case_id, {sql_fixed('avg((l.doc_id is not null)::int)')} as citation_validity, count(*) as citations
    from ({_CITED}) c left join labels l using (doc_id) group by 1""")
def eval_citations(d: Domain) -> DataFrame:
    """Share of citations, counted by occurrence, that name a known source."""
    n = d.raw("benchmark").agg(F.count(F.lit(1)).alias("n_cases"))
    cited = d.raw("conversations").where("role = 'assistant'").selectExpr("conv_id", "conv_id * 7 + turn as doc_id").crossJoin(F.broadcast(n))
    known = cited.join(d.raw("labels").select("doc_id", F.lit(1).alias("known")), "doc_id", "left")
    return known.groupBy(F.expr("conv_id % n_cases").alias("case_id")).agg(fixed(F.avg(F.coalesce("known", F.lit(0)))).alias("citation_validity"), F.count(F.lit(1)).alias("citations"))


# --- experiments

_PADS = [bytes(b ^ x for b in SECRET.encode().ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]
_UNITS = "select distinct unit_id from user_events"
_HASHED = f"select unit_id, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || ('exp:v1:' || unit_id)::blob))) as unit_hash from ({_UNITS})"
_BUCKETS = f"select *, (('0x' || substr(sha256('{PLAN}:' || unit_hash), 1, 16))::ubigint % 10000)::int as bucket from hashed"
_ARMED = "select *, case when bucket < 5000 then 'control' else 'treatment' end as variant from buckets"
_EXP = {"hashed": _HASHED, "buckets": _BUCKETS, "armed": _ARMED}


def _assigned(d: Domain) -> DataFrame:
    hashed = d.user_events().select("unit_id").distinct().withColumn("unit_hash", identity.unit_hash(SECRET, "exp", "v1", F.col("unit_id")))
    with_bucket = hashed.withColumn("bucket", identity.bucket(PLAN, F.col("unit_hash")))
    return with_bucket.withColumn("variant", experiments.variant(F.col("bucket"), ARMS))


def _observed(d: Domain) -> DataFrame:
    return experiments.observations(d.user_events()).join(_assigned(d).select("unit_id", "variant"), "unit_id")


@query(with_views("select unit_id, unit_hash from hashed", "user_events", hashed=_HASHED))
def unit_hash(d: Domain) -> DataFrame:
    return _assigned(d).select("unit_id", "unit_hash")


@query(with_views("select unit_id, bucket, variant from armed", "user_events", **_EXP))
def variant_buckets(d: Domain) -> DataFrame:
    return _assigned(d).select("unit_id", "bucket", "variant")


@query(with_views("""select unit_id, case when unit_id in (select unit_id from user_events where event_type = 'signup') then 'control' else variant end as variant from armed""", "user_events", **_EXP))
def sticky_assignments(d: Domain) -> DataFrame:
    """Units that had signed up are assigned already, and stay so."""
    units = _assigned(d).withColumnRenamed("variant", "fresh")
    old = d.user_events().where("event_type = 'signup'").select("unit_id").distinct().join(units.select("unit_id", "unit_hash"), "unit_id").select("unit_hash", F.lit("control").alias("variant"))
    return experiments.sticky(units, old, F.col("fresh")).select("unit_id", "variant")


@query(with_views(f"select unit_id, exposed, converted, failed, {sql_fixed('click_value')} as click_value from observed", "observed"))
def experiment_observations(d: Domain) -> DataFrame:
    return experiments.observations(d.user_events()).select("unit_id", "exposed", "converted", "failed", fixed(F.col("click_value")).alias("click_value"))


_Z = "1.959963984540054::double"
_SUMMARY = """select variant, metric, count(*) as n, avg(value) as mean, coalesce(stddev_samp(value), 0) as sd from (
    select variant, unnest(['converted', 'failed', 'click_value']) as metric, unnest([converted, failed, click_value]) as value from observed join armed using (unit_id) where exposed) where value is not null group by all"""


@query(with_views(f"""select variant, metric, n, {sql_fixed('mean')} as mean,
    {sql_fixed(f"case when metric <> 'click_value' then greatest(0, (mean + {_Z}*{_Z}/(2*n)) / (1 + {_Z}*{_Z}/n) - {_Z}*sqrt(mean*(1-mean)/n + {_Z}*{_Z}/(4*n*n)) / (1 + {_Z}*{_Z}/n)) when n = 1 then mean else mean - {_Z}*sd/sqrt(n) end")} as low,
    {sql_fixed(f"case when metric <> 'click_value' then least(1, (mean + {_Z}*{_Z}/(2*n)) / (1 + {_Z}*{_Z}/n) + {_Z}*sqrt(mean*(1-mean)/n + {_Z}*{_Z}/(4*n*n)) / (1 + {_Z}*{_Z}/n)) when n = 1 then mean else mean + {_Z}*sd/sqrt(n) end")} as high
    from summary""", "observed", **_EXP, summary=_SUMMARY))  # fmt: skip
def experiment_arm_summary(d: Domain) -> DataFrame:
    rows = experiments.arm_summary(_observed(d), METRICS)
    return rows.select("variant", "metric", "n", *(fixed(F.col(c)).alias(c) for c in ("mean", "low", "high")))


@query()
def experiment_comparison(d: Domain) -> DataFrame:
    """Differences of the arms, with p values from the error function, which SQL lacks."""
    return experiments.compared(experiments.arm_summary(_observed(d), METRICS), METRICS, "control", "treatment")


@query(with_views("select variant, count(*) as exposed_units, count(*) >= 62 as ready from observed join armed using (unit_id) where exposed group by variant", "observed", **_EXP))
def experiment_readiness(d: Domain) -> DataFrame:
    """Exposed units of each arm against the planned number; nothing else is told before both are ready."""
    planned = experiments.sample_size(0.4, 0.25)
    n = F.count(F.lit(1))
    return _observed(d).where("exposed").groupBy("variant").agg(n.alias("exposed_units"), (n >= planned).alias("ready"))


@query(with_views("""select event_id, case when exposed_at is null or ts < exposed_at then 'before_exposure' when event_type = 'view' and ts > exposed_at then 'repeated_exposure'
    when event_type = 'purchase' and n > 1 then 'repeated_outcome' else 'accepted' end as verdict from (
    select *, row_number() over (partition by unit_id, event_type, coalesce(ts >= exposed_at, false) order by ts, event_id) as n from user_events join (select unit_id, min(case when event_type = 'view' then ts end) as exposed_at from user_events group by unit_id) using (unit_id))""", "user_events"))
def event_acceptance(d: Domain) -> DataFrame:
    """Outcomes need an earlier exposure; one exposure and one primary outcome count for each unit."""
    from pyspark.sql import Window

    events = d.user_events()
    first = events.groupBy("unit_id").agg(F.min(F.when(F.col("event_type") == "view", F.col("ts"))).alias("exposed_at"))
    late = F.coalesce(F.col("ts") >= F.col("exposed_at"), F.lit(False))
    n = F.row_number().over(Window.partitionBy("unit_id", "event_type", late).orderBy("ts", "event_id"))
    kind = F.col("event_type")
    verdict = F.when(~late, "before_exposure").when((kind == "view") & (F.col("ts") > F.col("exposed_at")), "repeated_exposure").when((kind == "purchase") & (F.col("n") > 1), "repeated_outcome").otherwise("accepted")
    return events.join(first, "unit_id").withColumn("n", n).select("event_id", verdict.alias("verdict"))


# --- calculations


def _calculations(d: Domain) -> tuple[DataFrame, DataFrame]:
    """Every company and concept proposes the change of its yearly totals; facts are the totals."""
    totals = _facts(d).groupBy("cik", "concept", "fiscal_year").agg(F.sum("value").alias("total"))
    facts = totals.select(F.concat_ws(":", "cik", "concept", F.col("fiscal_year").cast("string")).alias("fact_id"), F.col("total").cast("string").alias("value"), F.lit("USD").alias("unit"))
    sets = totals.groupBy("cik", "concept").agg(F.array_sort(F.collect_list("fiscal_year")).alias("y"), F.min_by("total", "fiscal_year").alias("a"), F.max_by("total", "fiscal_year").alias("b"))
    ids = F.transform(F.array(F.array_min("y"), F.array_max("y")), lambda y: F.concat_ws(":", "cik", "concept", y.cast("string")))
    n = F.size("y")
    kind = F.when(n == 1, "difference").when(n == 2, "sum").when(n == 3, "difference").otherwise("average")
    rows = sets.select(
        F.concat_ws(":", "cik", "concept").alias("calc_id"), kind.alias("operation"), F.when(n == 1, F.slice(ids, 1, 1)).otherwise(ids).alias("fact_ids"),
        F.when(n == 2, F.col("a") + F.col("b")).otherwise(F.col("b") - F.col("a")).cast("string").alias("reported"), F.lit("usd").alias("reported_unit"),
    )
    return rows, facts


@query(with_views("""select cik || ':' || concept as calc_id, case n when 1 then 'wrong number of facts' when 2 then null when 3 then null else 'unknown operation' end as failure,
    n = 2 or (n = 3 and abs((b - a) - (a - b)) <= greatest(0.01, abs(a - b) * 0.0001)) as passed
    from (select cik, concept, count(*) as n, arg_min(total, fiscal_year) as a, arg_max(total, fiscal_year) as b from (select cik, concept, fiscal_year, sum(value) as total from facts group by all) group by cik, concept)""", "facts"))
def calc_validation(d: Domain) -> DataFrame:
    """Proposed calculations recomputed exactly; some are wrong, of the wrong arity or unknown."""
    return answers.validated(*_calculations(d)).select("calc_id", "failure", "passed")


@query()
def calc_values(d: Domain) -> DataFrame:
    """Recomputed values as exact decimal text, which keeps trailing zeros."""
    return answers.validated(*_calculations(d)).where("failure is null").select("calc_id", "operation", "expected")
