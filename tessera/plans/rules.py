"""Queries over the contracts of what is stored, sent and published: each gives the rules that a row breaks, or the row's verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import answers, contracts, evaluation, store
from tessera.plans import registry
from tessera.plans.registry import query, sql_fixed
from tessera.plans.views import with_views
from tessera.sources.adapters import Domain

_SEEN = """select case_id, array_agg(rank order by rank, doc_id) as ranks, array_agg((case when case_id % 5 = 0 then doc_id % 500 else doc_id end)::varchar order by rank, doc_id) as keys from ranked_control where case_id % 3 = 0 or rank % 11 <> 3 group by case_id"""
_SAID = """select case_id, array_agg('c' || (case when case_id % 4 = 1 then turn % 2 else conv_id * 100 + turn end)::varchar order by conv_id, turn) as claims, array_agg(case when turn % 9 = 8 then '-' else 'k' end || (conv_id * 100 + turn)::varchar order by conv_id, turn) as checks
    from (select conv_id % (select count(*) from benchmark) as case_id, conv_id, turn from conversations where role = 'assistant') group by case_id"""


@query(with_views("""select case_id, concat_ws(',', case when list_sort(ranks) <> range(1, len(ranks) + 1) then 'ranks' end, case when len(list_distinct(keys)) <> len(keys) then 'sources' end,
    case when case_id % 7 = 2 then 'available' end, case when not (len(keys) = 0 or case_id % 7 <> 3) then 'retrieved' end, case when len(list_distinct(claims)) <> len(claims) then 'claim_ids' end,
    case when len(list_filter(checks, lambda x: not regexp_full_match(x, '[A-Za-z0-9][A-Za-z0-9._-]{0,99}'))) > 0 then 'check_ids' end, case when case_id % 6 in (1, 2) then 'error_type' end,
    case when case_id % 10 = 4 then 'latency_ms' end, case when case_id % 10 = 7 then 'cost_usd' end) as violated
    from (select case_id, ranks, keys, coalesce(claims, []::varchar[]) as claims, coalesce(checks, []::varchar[]) as checks from seen left join said using (case_id))""", "ranked_control", seen=_SEEN, said=_SAID))  # fmt: skip
def eval_observation_violations(d: Domain) -> DataFrame:
    """Rules of the observation contract that a case's observation breaks (ranks are lost, sources and ids repeat, errors do not fit)."""
    case = F.col("case_id")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id", c))), lambda x: x[c])
    key = F.when(case % 5 == 0, F.col("doc_id") % 500).otherwise(F.col("doc_id")).cast("string")
    seen = d.ranked("control").where("case_id % 3 = 0 or rank % 11 <> 3").withColumn("key", key).withColumn("r", F.col("rank")).groupBy("case_id").agg(listed("r").alias("ranks"), listed("key").alias("keys"))
    n = d.raw("benchmark").agg(F.count(F.lit(1)).alias("n_cases"))
    ids = (F.col("conv_id") * 100 + F.col("turn")).cast("string")
    talk = d.raw("conversations").where("role = 'assistant'").crossJoin(F.broadcast(n)).select(F.expr("conv_id % n_cases").alias("case_id"), "turn", ids.alias("id"))
    claim = F.concat(F.lit("c"), F.when(case % 4 == 1, (F.col("turn") % 2).cast("string")).otherwise(F.col("id")))
    said = talk.groupBy("case_id").agg(F.collect_list(claim).alias("claim_ids"), F.collect_list(F.concat(F.when(F.col("turn") % 9 == 8, "-").otherwise("k"), F.col("id"))).alias("check_ids"))
    none = F.array().cast("array<string>")
    available = F.when(case % 7 == 2, F.concat("keys", F.slice("keys", 1, 1))).when(case % 7 == 3, none).otherwise(F.array_distinct("keys"))
    made = seen.join(said, "case_id", "left").select(
        "case_id", "ranks", "keys", available.alias("available"), F.coalesce("claim_ids", none).alias("claim_ids"), F.coalesce("check_ids", none).alias("check_ids"), (case % 2 == 0).alias("completed"),
        F.when((case % 2 == 1) & (case % 6 != 1) | (case % 6 == 2), "timeout").alias("error_type"), F.when(case % 10 == 4, -1.0).otherwise(5.0).alias("latency_ms"),
        F.when(case % 10 == 7, float("nan")).when(case % 10 != 3, 0.5).alias("cost_usd"),
    )
    return made.select("case_id", store.violations(contracts.observation_rules()).alias("violated"))


@query("""select lang as dataset, count(*) as cases, violated = '' as allowed, violated from (select lang, doc_id, concat_ws(',', case when lang = 'fr' then 'data_classification' end, case when lang = 'es' then 'run_types' end,
    case when count(*) over (partition by lang) < 120 then 'cases' end, case when lang in ('es', 'it') then 'git_sha' end) as violated from documents where lang is not null) group by lang, violated""")
def eval_publication_gate(d: Domain) -> DataFrame:
    """Comparisons that may be published: public data, offline runs of known revisions on both sides, and enough cases."""
    lang = F.col("lang")
    sets = d.raw("documents").where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("cases"))
    made = sets.select(
        lang.alias("dataset"), "cases", F.when(lang == "fr", "synthetic").otherwise("public_sec_derived").alias("data_classification"),
        F.array(F.lit("offline_benchmark"), F.when(lang == "es", "production_shadow").otherwise("offline_benchmark")).alias("run_types"),
        F.array(F.lit("abc"), F.when(~lang.isin("es", "it"), "abd")).alias("git_shas"),
    )
    found = made.withColumn("violated", store.violations(contracts.publication_rules(least_cases=120)))
    return found.select("dataset", "cases", (F.col("violated") == "").alias("allowed"), "violated")


_SETS = """select s.source as dataset, sha256('{"cases":[' || string_agg('"' || doc_id::varchar || '"', ',' order by doc_id::varchar) || '],"dataset_id":"' || source || '"}') as fingerprint,
    list(doc_id::varchar) as cases from documents s where source is not null group by source"""


@query(f"""select dataset, run, concat_ws(',', case when run = 1 then 'dataset_id' end, case when run in (1, 2) then 'dataset_fingerprint' end, case when run in (2, 3) then 'cases' end) as violated, run = 3 and len(cases) > 0 as late_cases
    from ({_SETS}), (select unnest([0, 1, 2, 3]) as run)""")
def eval_run_contract(d: Domain) -> DataFrame:
    """Runs against their dataset: its id, the fingerprint of its cases, and exactly its cases (runs 1 to 3 of each dataset are of others, or lack or add cases)."""
    docs = d.raw("documents").where("source is not null").select(F.col("source").alias("dataset"), F.col("doc_id").cast("string").alias("case_id"))
    run = F.explode(F.array(*map(F.lit, range(4)))).alias("run")
    sets = contracts.dataset_fingerprints(docs)
    other = F.concat("dataset", F.when(F.col("run") == 1, "-old").otherwise(""))
    first = docs.groupBy("dataset").agg(F.min("case_id").alias("least"))
    seen = docs.join(F.broadcast(first), "dataset").select("dataset", "case_id", "least", run).where("run <> 2 or case_id <> least").select("dataset", "run", "case_id")
    extra = docs.select("dataset").distinct().select("dataset", F.lit(3).alias("run"), F.lit("unheard of").alias("case_id"))
    cases = seen.unionByName(extra)
    claimed = contracts.dataset_fingerprints(cases.where("run <> 3").select(F.concat("dataset", F.lit("|"), F.col("run").cast("string")).alias("key"), other.alias("dataset"), "case_id"), "key")
    runs = sets.select("dataset", run).withColumn("key", F.concat("dataset", F.lit("|"), F.when(F.col("run") == 3, 0).otherwise(F.col("run")).cast("string")))
    runs = runs.join(claimed.select("key", F.col("fingerprint").alias("dataset_fingerprint")), "key").select("dataset", "run", other.alias("dataset_id"), "dataset_fingerprint")
    found = contracts.run_faults(runs, cases, sets, docs)
    return found.select("dataset", "run", "violated", (F.col("unexpected") > 0).alias("late_cases"))


@query("""select event_id, concat_ws(',', case when event_id % 7 = 0 then 'event_key' end, case when event_type <> 'view' and event_id % 11 = 5 then 'metric_name' end, case when event_type = 'view' and (event_id % 3 <> 0 or event_id % 13 = 1) then 'exposure_metric' end,
    case when event_type <> 'view' and event_id % 3 = 0 and event_id % 13 <> 1 then 'outcome_metric' end, case when event_id % 13 = 1 then 'finite' end, case when event_id % 4 = 2 then 'occurred_at' end) as violated from events""")
def event_shape_violations(d: Domain) -> DataFrame:
    """Rules that an event's shape breaks: its key, a metric only where one belongs and with a name of the right form, a finite value, a time with its zone."""
    n, exposure = F.col("event_id"), F.col("event_type") == "view"
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    made = d.raw("events").select(
        "event_id", F.concat(F.when(n % 7 == 0, "!").otherwise(F.col("event_type")), F.lit(":"), n.cast("string")).alias("event_key"), F.when(exposure, "exposure").otherwise("outcome").alias("event_type"),
        F.when(exposure, F.lit(None)).when(n % 11 == 5, "No Name").otherwise("clicked").alias("metric_name"), F.when(n % 13 == 1, float("inf")).when(n % 3 != 0, F.col("value")).alias("metric_value"),
        F.concat(at, F.when(n % 4 == 2, "").when(n % 4 == 1, "+02:00").otherwise("Z")).alias("occurred_at"),
    )
    return made.select("event_id", store.violations(contracts.event_rules()).alias("violated"))


@query("""select doc_id, case when batch % 5 = 1 then 'refused' when lang = 'en' then 'updated' else 'stale' end as verdict, case when batch % 5 <> 1 then null when batch % 3 = 0 and doc_id = first then 'repeated' when batch % 3 = 1 and doc_id = first then 'dimensions' when batch % 3 = 2 and doc_id = first then 'not_finite' end as fault
    from (select *, doc_id % 40 as batch, min(doc_id) over (partition by doc_id % 40) as first from documents)""")
def embedding_update_verdicts(d: Domain) -> DataFrame:
    """Batches of vectors to store: one with a repeated id, other dimensions or a component that is not finite is refused whole; the rest takes effect where the text is still the one read."""
    docs = d.raw("documents").select("doc_id", "lang", F.sha2("text", 256).alias("content_hash"), (F.col("doc_id") % 40).alias("batch"))
    first = docs.groupBy("batch").agg(F.min("doc_id").alias("first"))
    read = F.when(F.col("lang") == "en", F.col("content_hash")).otherwise(F.concat("content_hash", F.lit("!")))
    wrong = (F.col("batch") % 5 == 1) & (F.col("doc_id") == F.col("first"))
    good = F.array(F.lit(1.0), F.lit(2.0))
    vector = F.when(wrong & (F.col("batch") % 3 == 1), F.array(F.lit(1.0))).when(wrong & (F.col("batch") % 3 == 2), F.array(F.lit(1.0), F.lit(float("nan")))).otherwise(good)
    sent = docs.join(F.broadcast(first), "batch").select("batch", "doc_id", read.alias("content_hash"), vector.alias("vector"), (wrong & (F.col("batch") % 3 == 0)).alias("twice"))
    sent = sent.select("batch", "doc_id", "content_hash", "vector", F.explode(F.sequence(F.lit(1), F.when(F.col("twice"), 2).otherwise(1))).alias("sending"))
    judged = store.checked_updates(sent, batch="batch", key="doc_id", fault=contracts.vector_fault(F.col("vector"), 2))
    return store.applied(docs.select("doc_id", "content_hash"), judged, ["doc_id", "content_hash"]).dropDuplicates(["doc_id"]).select("doc_id", "verdict", "fault")


@query(with_views("""select accession_number, concat_ws(',', case when form_type = '10-Q' and filing_id % 9 = 0 then 'cik' end, case when form_type = '8-K' then 'form_type' end, case when filing_date < date '1996-01-01' then 'filing_date' end,
    case when filing_id % 5 = 0 then 'report_date' end, case when filing_id % 17 = 3 then 'primary_document' end, case when filing_id % 17 in (3, 4) then 'source_url' end, case when filing_id % 23 = 1 then 'content_hash' end) as fields
    from filings where (form_type = '10-Q' and filing_id % 9 = 0) or form_type = '8-K' or filing_date < date '1996-01-01' or filing_id % 5 = 0 or filing_id % 17 in (3, 4) or filing_id % 23 = 1""", "filings"))  # fmt: skip
def filing_immutable_fields(d: Domain) -> DataFrame:
    """All immutable fields of a filing in which a second delivery differs."""
    n = F.col("filing_id")
    url = lambda name: F.concat(F.lit("https://filings.example/"), "cik", F.lit("/"), name)
    stored = d.filings().withColumns({"report_date": F.when(n % 5 > 0, F.date_sub("filing_date", 30)), "source_url": url("primary_document"), "content_hash": F.sha2(n.cast("string"), 256)})
    early = F.col("filing_date") < F.lit("1996-01-01").cast("date")
    again = stored.withColumns({
        "cik": F.when((F.col("form_type") == "10-Q") & (n % 9 == 0), "9999999999").otherwise(F.col("cik")), "form_type": F.when(F.col("form_type") == "8-K", "8-K/A").otherwise(F.col("form_type")),
        "filing_date": F.when(early, F.date_add("filing_date", 1)).otherwise(F.col("filing_date")), "report_date": F.when(n % 5 == 0, F.lit("2001-01-01").cast("date")).otherwise(F.col("report_date")),
        "primary_document": F.when(n % 17 == 3, "other.htm").otherwise(F.col("primary_document")), "source_url": F.when(n % 17 == 3, url(F.lit("other.htm"))).when(n % 17 == 4, "https://elsewhere.example/").otherwise(F.col("source_url")),
        "content_hash": F.when(n % 23 == 1, F.sha2(F.lit("changed"), 256)).otherwise(F.col("content_hash")),
    })
    return store.identity_conflicts(stored, again, "accession_number", store.FILING_FIELDS)


@query(with_views("""select request_id, case when c = 1 then 'concepts' else '' end as violated, count(observation_key) as facts, coalesce(max(case when observation_key is not null then fact_id end), '') as last_id from (
    select a.*, f.observation_key, 'F' || row_number() over (partition by request_id order by filed_date desc, end_date desc, concept, observation_key)::varchar as fact_id, row_number() over (partition by request_id order by filed_date desc, end_date desc, concept, observation_key) as n
    from (select c_custkey as request_id, c_custkey % 6 as c, (c_custkey * 7) % 5 as most, lpad(c_custkey::varchar, 10, '0') as cik from customer) a
    left join facts f on f.cik = a.cik and a.c not in (1, 2) and a.most > 0 and (a.c <> 3 and concept = 'FlagR' or a.c = 3 and concept in ('FlagA', 'FlagN'))) where n <= greatest(most, 1) group by request_id, c""", "facts"))  # fmt: skip
def fact_requests(d: Domain) -> DataFrame:
    """Facts that requests for evidence get, numbered from F1: none without an issuer or with a limit of 0; blank or repeated concepts are refused."""
    n = F.col("c_custkey")
    one = lambda *x: F.array(*map(F.lit, x))
    asked = d.raw("customer").select(
        n.alias("request_id"), F.when(n % 6 != 2, F.concat(F.lit(" "), n.cast("string"))).alias("cik"),
        F.when(n % 6 == 1, one("FlagR", " FlagR")).when(n % 6 == 3, one(" FlagN", "FlagA ")).otherwise(one("FlagR")).alias("concepts"), (n * 7 % 5).cast("int").alias("limit"),
    )
    found = answers.fact_evidence(asked, d.facts_raw().transform(lambda x: store.first_wins(x, ["observation_key"], "source_order")))
    return found.groupBy("request_id", "violated").agg(F.count("observation_key").alias("facts"), F.coalesce(F.max("fact_id"), F.lit("")).alias("last_id"))


@query(with_views("""select observation_key, concat_ws(',', case when not regexp_full_match(accession_number, '[0-9]{10}-[0-9]{2}-[0-9]{6}') then 'accession_number' end, case when length(concept) not between 1 and 200 or fiscal_year % 7 = 3 then 'concept' end,
    case when fiscal_year % 5 = 2 then 'unit' end, case when fiscal_year % 5 = 1 then 'form_type' end, case when concept = 'FlagN' and fiscal_year % 2 = 0 then 'value' end, case when concept = 'FlagR' then 'dates' end) as violated from facts""", "facts"))  # fmt: skip
def fact_shape_violations(d: Domain) -> DataFrame:
    """Rules that an observation's fields break as text: names within their lengths, an exact decimal, dates, an accession number (some are spoilt)."""
    y = F.col("fiscal_year")
    spoilt = registry._facts(d).select(
        "observation_key", "accession_number", F.when(y % 7 == 3, F.repeat(F.lit("x"), 501)).otherwise(F.col("concept")).alias("concept"), F.when(y % 5 == 2, "").otherwise(F.col("unit")).alias("unit"),
        F.when(y % 5 == 1, F.repeat(F.lit("F"), 21)).otherwise(F.col("form_type")).alias("form_type"), F.when((F.col("concept") == "FlagN") & (y % 2 == 0), "12e").otherwise(F.col("value").cast("string")).alias("value"),
        F.when(F.col("concept") == "FlagR", "2024-02-30").otherwise(F.col("end_date").cast("string")).alias("end"), F.col("filed_date").cast("string").alias("filed"),
    )
    return spoilt.select("observation_key", store.violations(contracts.fact_rules()).alias("violated"))


@query("""select user_id, sha256('{"arms":[{"is_control":true,"name":"control","points":5000},{"is_control":false,"name":"treatment","points":' || (5000 + user_id % 3)::varchar || '}],"experiment_key":"exp-' || user_id::varchar
    || '","planned":' || count(*)::varchar || ',"primary":{"direction":"higher_is_better","kind":"binary","name":"clicked"}}') as fingerprint, 5000 + user_id % 3 = 5000 as same_as_loaded from events group by user_id""")
def plan_fingerprints(d: Domain) -> DataFrame:
    """Fingerprints of plans by their canonical JSON text, from bounded plan files; those that are loaded unchanged have the fingerprint of the plan sent."""
    u = F.col("user_id")
    arm = lambda control, name, points: F.struct(F.lit(control).alias("is_control"), F.lit(name).alias("name"), points.cast("long").alias("points"))
    made = lambda extra: F.to_json(F.struct(
        F.array(arm(True, "control", F.lit(5000)), arm(False, "treatment", 5000 + extra)).alias("arms"), F.concat(F.lit("exp-"), u.cast("string")).alias("experiment_key"), F.col("n").alias("planned"),
        F.struct(F.lit("higher_is_better").alias("direction"), F.lit("binary").alias("kind"), F.lit("clicked").alias("name")).alias("primary"),
    ))
    users = d.raw("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    loaded = contracts.bounded_plans(users.select("user_id", made(u % 3).alias("body"), made(F.lit(0)).alias("sent")), body="body")
    return loaded.select("user_id", F.sha2("body", 256).alias("fingerprint"), (F.sha2("body", 256) == F.sha2("sent", 256)).alias("same_as_loaded"))


_BOTH = "select 'control' as part, metric, value from c union all select 'treatment', metric, value from t"


@query(with_views(f"""select part, metric, {sql_fixed('avg(value)')} as value, count(*) as cases from ({_BOTH}) where value is not null group by all
    union all select 'delta', metric, {sql_fixed('avg(delta)')}, count(*) from ({registry._PAIRED}) where delta is not null group by metric""", *registry._SYSTEMS, **registry._PAIR))  # fmt: skip
def eval_report(d: Domain) -> DataFrame:
    """One report of a comparison: each system's metrics over the cases that support them, and the paired differences."""
    control, treatment = registry._metrics(d, "control"), registry._metrics(d, "treatment")
    found = evaluation.report(control, treatment)
    return found.select("part", "metric", registry.fixed(F.col("value")).alias("value"), "cases")
