"""Queries over HTML filings, nested facts, contracts, outcomes and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.embedding import hashed_embedding
from tessera.operators import answers, evaluation, experiments, filings, store
from tessera.plans import registry
from tessera.plans.registry import query, sql_fixed
from tessera.plans.views import with_views
from tessera.sources.adapters import Domain

fixed = registry.fixed

# --- filings as HTML


@query()
def html_sections(d: Domain) -> DataFrame:
    """Sections of HTML filings, read block by block."""
    rows = filings.filing_sections(d.raw("pages"), key="page_id", html="html")
    return rows.select("page_id", "sequence_number", "section_name", "char_count", F.sha2("content", 256).alias("content_hash"))


@query()
def document_rejections(d: Domain) -> DataFrame:
    """How many filings can be read, and why the others cannot."""
    return filings.read_filings(d.raw("pages"), key="page_id", html="html").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query()
def embed_documents(d: Domain) -> DataFrame:
    """Vectors of all documents by the hashing embedder."""
    return d.raw("documents").select("doc_id", hashed_embedding(F.col("text")).alias("embedding"))


# --- facts


@query(with_views("""select cik, taxonomy, concept, unit, (row_number() over (partition by cik, taxonomy, concept, unit
    order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1)::int as ordinal, value, accession_number from facts_raw""", "facts_raw"))  # fmt: skip
def facts_flatten(d: Domain) -> DataFrame:
    """Facts with their place in their company's taxonomy, concept and unit, in source order.

    ``company_facts_read`` reads nested documents; nothing is nested here, so no company's facts ever form one row.
    """
    keys = ["cik", "taxonomy", "concept", "unit"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("source_order"))
    return d.facts_raw().select(*keys, (place - 1).alias("ordinal"), "value", "accession_number")


@query(with_views("""select failure, count(*) as n from (select case count(*) when 1 then 'wrong number of facts' when 2 then null when 3 then null else 'unknown operation' end as failure
    from (select distinct cik, concept, fiscal_year from facts) group by cik, concept) where failure is not null group by failure""", "facts"))  # fmt: skip
def calc_failures(d: Domain) -> DataFrame:
    """Calculations that cannot be checked, by reason."""
    found = answers.validated(*registry._calculations(d)).where("failure is not null")
    return found.groupBy("failure").agg(F.count(F.lit(1)).alias("n"))


# --- retrieval and answers


@query(with_views("""select s.doc_id, sha256(s.content) as keyword_hash, sha256(s.content || '!') as semantic_hash from sections s join vectors v using (doc_id) where v.embedding_model = 'model-1'""", "sections", "vectors"))
def rrf_hash_conflicts(d: Domain) -> DataFrame:
    """Chunks that two channels return with different content (those of one model have moved on)."""
    words = d.sections().select("doc_id", F.sha2("content", 256).alias("keyword_hash"))
    moved = F.when(F.col("embedding_model") == "model-1", F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    near = d.sections().join(d.vectors(), "doc_id").select("doc_id", F.sha2(moved, 256).alias("semantic_hash"))
    return words.join(near, "doc_id").where("keyword_hash <> semantic_hash")


@query("""select conv_id, sha256(string_agg(text || ' [E' || n::varchar || ']', chr(10) || chr(10) order by turn)) as answer_hash, count(*) as claims from (
    select conv_id, turn, text, row_number() over (partition by conv_id order by turn) as n from conversations where role = 'assistant') group by conv_id""")
def answer_render(d: Domain) -> DataFrame:
    """Claims with their citations as one text, a blank line apart."""
    claims = d.raw("conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("c"))
    parts = F.transform("c", lambda x, i: F.concat(x["text"], F.lit(" [E"), (i + 1).cast("string"), F.lit("]")))
    return claims.select("conv_id", F.sha2(F.array_join(parts, "\n\n"), 256).alias("answer_hash"), F.size("c").cast("long").alias("claims"))


@query("""select conv_id, concat_ws(',', case when n > 2 then 'claims' end, case when ids <> n then 'evidence_ids' end, case when longest > 1500 then 'statement' end) as violated from (
    select conv_id, count(*) as n, count(distinct turn % 3) as ids, max(length(text)) as longest from conversations where role = 'assistant' group by conv_id)""")
def draft_contract_violations(d: Domain) -> DataFrame:
    """Rules that a draft violates: number of claims, unique evidence, length of statements."""
    drafts = d.raw("conversations").where("role = 'assistant'").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("turn") % 3).alias("ids"), F.max(F.length("text")).alias("longest")
    )
    rules = {"claims": F.col("n") <= 2, "evidence_ids": F.col("ids") == F.col("n"), "statement": F.col("longest") <= 1500}
    return drafts.select("conv_id", store.violations(rules).alias("violated"))


# --- evaluation

_OBSERVED = """select conv_id as case_id, bool_or(role = 'assistant') as completed, not bool_or(role = 'assistant') as abstained, conv_id % 5 = 0 as expected_abstain,
    sum((role = 'system' and turn % 2 = 1)::int) as findings,
    count(*) filter (role = 'assistant') as n_claims, coalesce(bool_and(case when turn % 7 = 5 then false else length(text) % 4 <> 0 end and turn % 6 <> 3) filter (role = 'assistant'), true) as supported,
    count(*) filter (role = 'user') as n_checks, coalesce(avg((length(text) % 6 <> 0)::int) filter (role = 'user'), 1) as passed
    from conversations group by conv_id"""


def _observed(d: Domain) -> DataFrame:
    """One row for each conversation: assistant turns are claims, user turns checks, odd system turns findings; some citations are not valid, some reviewers are against it."""
    role, n = F.col("role"), F.length("text")
    claim = F.struct(F.when(F.col("turn") % 7 != 5, n % 4 != 0).alias("supported"), (F.col("turn") % 6 != 3).alias("valid"))
    answered = F.max(role == "assistant")
    return d.raw("conversations").groupBy(F.col("conv_id").alias("case_id")).agg(
        answered.alias("completed"), (~answered).alias("abstained"), (F.first("conv_id") % 5 == 0).alias("expected_abstain"),
        F.sum(((role == "system") & (F.col("turn") % 2 == 1)).cast("int")).alias("findings"),
        F.collect_list(F.when(role == "assistant", claim)).alias("claims"), F.collect_list(F.when(role == "user", n % 6 != 0)).alias("checks"),
        F.when(F.first("conv_id") % 9 < 2, F.first("conv_id") % 9 == 1).alias("approved"),
    )


@query(f"""select case_id, completed, completed and abstained = expected_abstain and (case when expected_abstain then abstained else n_claims > 0 or n_checks > 0 end)
    and findings = 0 and supported and passed = 1 and case_id % 9 <> 0 as verified from ({_OBSERVED})""")
def eval_verified_completion(d: Domain) -> DataFrame:
    """Cases that meet every condition of a verified completion."""
    return evaluation.verified_completion(_observed(d))


@query(f"""select case_id, case when n_checks > 0 then {sql_fixed('passed::double')} end as numerical_accuracy, (abstained = expected_abstain)::int as abstention_accuracy,
    (findings > 0)::int as safety_violation_rate, (not completed)::int as failure_rate from ({_OBSERVED})""")
def eval_outcomes(d: Domain) -> DataFrame:
    """Outcome metrics of each case; a metric without support is null."""
    passed = F.size(F.filter("checks", lambda x: x)) / F.nullif(F.size("checks"), F.lit(0))
    flag = lambda x, name: x.cast("int").alias(name)
    return _observed(d).select(
        "case_id", fixed(passed).alias("numerical_accuracy"), flag(F.col("abstained") == F.col("expected_abstain"), "abstention_accuracy"),
        flag(F.col("findings") > 0, "safety_violation_rate"), flag(~F.col("completed"), "failure_rate"),
    )


_TAIL = "least(1, 2 * list_sum(list_transform(range(0, least(up, down)::bigint + 1), lambda i: exp(lgamma(up + down + 1) - lgamma(i + 1) - lgamma(up + down - i + 1) - (up + down) * ln(2)))))"


@query(with_views(f"""select metric, up, down, case when up + down > 0 then {sql_fixed(_TAIL)} end as sign_p
    from (select metric, sum((delta > 0)::int)::bigint as up, sum((delta < 0)::int)::bigint as down from ({registry._PAIRED}) group by metric)""", *registry._SYSTEMS, **registry._PAIR))  # fmt: skip
def eval_sign_test(d: Domain) -> DataFrame:
    """Exact sign tests of the paired deltas."""
    pairs = evaluation.paired(registry._metrics(d, "control"), registry._metrics(d, "treatment"))
    return evaluation.sign_test(pairs).select("metric", "up", "down", fixed(F.col("sign_p")).alias("sign_p"))


@query("""select lang as dataset, count(*) as cases, lang <> 'fr' and count(*) >= 20 as allowed, concat_ws(',', case when lang = 'fr' then 'data_classification' end, case when count(*) < 20 then 'cases' end) as violated
    from documents where lang is not null group by lang""")
def eval_claim_gate(d: Domain) -> DataFrame:
    """Datasets whose results may be published: public data and enough cases."""
    sets = d.raw("documents").where("lang is not null").groupBy(F.col("lang").alias("dataset")).agg(F.count(F.lit(1)).alias("cases"))
    rules = {"data_classification": F.col("dataset") != "fr", "cases": F.col("cases") >= 20}
    return sets.withColumn("violated", store.violations(rules)).withColumn("allowed", F.col("violated") == "")


@query(with_views("""select case_id, concat_ws(',', case when top <> n then 'ranks' end, case when keys <> n then 'sources' end) as violated
    from (select case_id, max(rank) as top, count(*) as n, count(distinct doc_id % 1000) as keys from ranked_control where case_id % 3 = 0 or rank % 11 <> 3 group by case_id)""", "ranked_control"))
def eval_contract_violations(d: Domain) -> DataFrame:
    """Observations whose ranks have gaps or whose sources repeat (in two cases of three, each eleventh rank is lost)."""
    seen = d.ranked("control").where("case_id % 3 = 0 or rank % 11 <> 3").groupBy("case_id").agg(
        F.max("rank").alias("top"), F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("doc_id") % 1000).alias("keys")
    )
    rules = {"ranks": F.col("top") == F.col("n"), "sources": F.col("keys") == F.col("n")}
    return seen.select("case_id", store.violations(rules).alias("violated"))


# --- experiments


@query("""select event_id, concat_ws(',', case when not regexp_full_match(event_key, '[A-Za-z0-9][A-Za-z0-9._:-]{2,199}') then 'event_key' end,
    case when event_type = 'view' and metric_value is not null then 'exposure_metric' end, case when event_type <> 'view' and metric_value is null then 'outcome_metric' end) as violated
    from (select event_id, event_type, case when event_id % 7 = 0 then '!' else event_type end || ':' || event_id::varchar as event_key, case when event_id % 3 <> 0 then value end as metric_value from events)""")
def event_contract_violations(d: Domain) -> DataFrame:
    """Rules that an event violates: its key's form, and a metric only where one belongs (some events are broken)."""
    key = F.concat(F.when(F.col("event_id") % 7 == 0, "!").otherwise(F.col("event_type")), F.lit(":"), F.col("event_id").cast("string"))
    value = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    exposure = F.col("event_type") == "view"
    # Fixed value: the pattern of an event's key.
    rules = {"event_key": key.rlike(r"^[A-Za-z0-9][A-Za-z0-9._:-]{2,199}$"), "exposure_metric": ~exposure | value.isNull(), "outcome_metric": exposure | value.isNotNull()}
    return d.raw("events").select("event_id", store.violations(rules).alias("violated"))


@query("select event_type, count(*) as n, count(distinct user_id) as units from events where event_type not in ('view', 'purchase', 'error', 'click') group by event_type")
def experiment_audit(d: Domain) -> DataFrame:
    """Telemetry of metrics that the plan does not have."""
    known = d.spark.createDataFrame([("view",), ("purchase",), ("error",), ("click",)], "event_type string")
    strange = d.raw("events").join(F.broadcast(known), "event_type", "left_anti")
    return strange.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("units"))


_ARMS = "select metric, max(case when variant = 'control' then mean end) as c, max(case when variant = 'treatment' then mean end) as t, sum(case when metric = 'click_value' then sd * sd else mean * (1 - mean) end / n) as v, min(n) as n, count(*) as arms from summary group by metric"


@query(with_views(f"""select case when n < 62 or arms < 2 then 'collecting' when halt then 'halt' when t - c >= 0.25 and t - c - {registry._Z} * sqrt(v) > 0 then 'ship' when t - c + {registry._Z} * sqrt(v) < 0 then 'keep_control' else 'inconclusive' end as decision,
    case when n >= 62 and arms = 2 then {sql_fixed('t - c')} end as delta
    from pairs, (select coalesce(bool_or(t - c > 0.01), false) as halt from pairs where metric = 'failed') where metric = 'converted'""", "observed", **registry._EXP, summary=registry._SUMMARY, pairs=_ARMS))  # fmt: skip
def experiment_decision(d: Domain) -> DataFrame:
    """What the experiment's result says, once both arms are full."""
    summary = experiments.arm_summary(registry._observed(d), registry.METRICS)
    rows = experiments.compared(summary, registry.METRICS, "control", "treatment")
    arms = summary.where("metric = 'converted'").select("variant", "n")
    found = experiments.decision(rows, arms, planned=experiments.sample_size(0.4, 0.25), primary="converted", effect=0.25, guardrails={"failed": 0.01})
    return found.select("decision", fixed(F.col("delta")).alias("delta"))
