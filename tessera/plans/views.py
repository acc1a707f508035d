"""The domain tables of ``sources.adapters`` as common table expressions, for the SQL equivalents."""

PAD = "case when length({0}::varchar) >= {1} then {0}::varchar else lpad({0}::varchar, {1}, '0') end"


def pad(value: str, width: int) -> str:
    return PAD.format(value, width)


VIEWS = {
    "companies": f"select {pad('c_custkey', 10)} as cik, c_name as legal_name, {pad('c_nationkey', 4)} as sic from customer",
    "filings": f"""select o_orderkey as filing_id, {pad('o_custkey', 10)} as cik,
        {pad('o_custkey', 10)} || '-' || {pad('(year(o_orderdate) % 100)', 2)} || '-' || {pad('o_orderkey', 6)} as accession_number,
        case o_orderstatus when 'F' then '10-K' when 'O' then '10-Q' else '8-K' end as form_type,
        o_orderdate::date as filing_date, 'doc-' || o_orderkey::varchar || '.htm' as primary_document from orders""",
    "facts_raw": """select *, sha256(concat_ws('|', cik, taxonomy, concept, unit, start_date::varchar, end_date::varchar, filed_date::varchar,
        fiscal_year::varchar, fiscal_period, form_type, accession_number)) as observation_key from (
        select cik, case l_linestatus when 'F' then 'us-gaap' else 'dei' end as taxonomy, 'Flag' || l_returnflag as concept, 'USD' as unit,
        l_extendedprice::decimal(18,2) as value, make_date(year(l_shipdate), 1, 1) as start_date, make_date(year(l_shipdate), 12, 31) as end_date,
        filing_date as filed_date, year(l_shipdate)::int as fiscal_year, 'FY' as fiscal_period, form_type, accession_number,
        l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice from lineitem join filings on l_orderkey = filing_id)""",
    "facts": """select * from facts_raw qualify row_number() over (partition by observation_key
        order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) = 1""",
    "sections": "select doc_id, cik, accession_number, form_type, filing_date, source as section_name, text as content from documents join filings on doc_id = filing_id",
    "vectors": "select vec_id as doc_id, embedding, 'model-' || (label % 2)::varchar as embedding_model from embeddings",
    "tokens": r"select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') as t from documents",
    "chunks": """select doc_id, i::int as chunk_index, len(t[i*450+1:i*450+500])::int as token_count, array_to_string(t[i*450+1:i*450+500], ' ') as content
        from (select doc_id, t, unnest(range(case when len(t) <= 500 then 1 else ceil((len(t) - 500) / 450.0)::bigint + 1 end)) as i from tokens where len(t) > 0)""",
    "judgments": "select doc_id % (select count(*) from benchmark) as case_id, doc_id, 1 + quality + (1 - toxic) as grade from documents join labels using (doc_id)",
    "ranked_control": """select doc_id % (select count(*) from benchmark) as case_id, doc_id,
        row_number() over (partition by doc_id % (select count(*) from benchmark) order by n_chars desc, doc_id)::int as rank from documents""",
    "ranked_treatment": """select doc_id % (select count(*) from benchmark) as case_id, doc_id,
        row_number() over (partition by doc_id % (select count(*) from benchmark) order by coalesce(quality, 0) desc, n_chars desc, doc_id)::int as rank
        from documents left join labels using (doc_id)""",
    "user_events": "select 'user-' || user_id::varchar as unit_id, event_id, ts, event_type, value from events",
    "observed": """select unit_id, bool_or(exposed_at is not null) as exposed,
        max(case when event_type = 'purchase' and ts >= exposed_at and ts < exposed_at + interval 24 hour then 1.0::double else 0.0::double end) as converted,
        max(case when event_type = 'error' and ts >= exposed_at and ts < exposed_at + interval 24 hour then 1.0::double else 0.0::double end) as failed,
        avg(case when event_type = 'click' and ts >= exposed_at and ts < exposed_at + interval 24 hour then value end) as click_value
        from user_events join (select unit_id, min(case when event_type = 'view' then ts end) as exposed_at from user_events group by unit_id) using (unit_id) group by unit_id""",
}
NEEDS = {
    "facts_raw": ["filings"], "facts": ["facts_raw"], "sections": ["filings"], "chunks": ["tokens"], "observed": ["user_events"],
}


def with_views(sql: str, *names: str, **extra: str) -> str:
    """``sql`` behind the named views and those that they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} as ({VIEWS[n]})" for n in order] + [f"{n} as ({q})" for n, q in extra.items()]
    return f"with {', '.join(parts)} {sql}" if parts else sql


def retrieval_sql(channel: str, k: int = 60) -> str:
    """Per-case ``case_id, metric, value`` of a ranked view, at the stated depth (see queries)."""
    return f"""select case_id, unnest(['recall', 'reciprocal_rank', 'ndcg']) as metric, unnest([recall, rr, coalesce(dcg / best, 0)]) as value from (
        select case_id, sum((rank is not null)::int) / count(*) as recall, coalesce(1.0::double / min(rank), 0) as rr,
        coalesce(sum(case when rank is not null then (2.0::double ^ grade - 1) / log2(rank + 1.0::double) end), 0) as dcg,
        sum(case when ideal <= {k} then (2.0::double ^ grade - 1) / log2(ideal + 1.0::double) end) as best
        from (select j.*, r.rank, row_number() over (partition by j.case_id order by grade desc, j.doc_id) as ideal
        from judgments j left join (select * from {channel} where rank <= {k}) r on j.case_id = r.case_id and j.doc_id = r.doc_id) group by case_id)"""
