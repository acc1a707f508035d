"""What an envelope moves once the search is done, and that it holds its companies' latest facts."""

import json

from pyspark.sql import functions as F

from tessera.plans import registry, search
from tessera.sources.adapters import Domain
from tests.moved import moved

SF = "/root/testdata/sf0.01"


def test_only_found_companies_are_looked_up(spark, monkeypatch):
    d = Domain(spark, SF)
    found = registry.hybrid_search(d)
    found = spark.createDataFrame([(r.doc_id, float(r.score)) for r in found.select("doc_id", "score").collect()], "doc_id long, score double")
    monkeypatch.setattr(search, "_hybrid", lambda _: found)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as between large tables
    try:
        latest = {}
        for r in registry.QUERIES["financial_facts_latest"](spark, SF).orderBy("cik", F.desc("filed_date"), F.desc("end_date"), "concept", "observation_key").collect():
            latest.setdefault(r.cik, []).append((r.concept, str(r.value), str(r.end_date), r.accession_number))
        before = moved(spark)
        rows = {r.cik: json.loads(r.envelope) for r in search.generation_envelope(d).collect()}
        assert moved(spark) - before < 8 * d.raw("lineitem").count()  # the facts of 20 companies of 1,500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    wanted = {r.doc_id: r.cik for r in d.sections().join(found, "doc_id").select("doc_id", "cik").collect()}
    assert len(wanted) == 20 and sorted(rows) == sorted(set(wanted.values()))
    for cik, x in rows.items():
        assert [(f["concept"], f["value"], f["end_date"], f["accession_number"]) for f in x["facts"]] == latest.get(cik, [])
        assert [f["id"] for f in x["facts"]] == [f"F{i + 1}" for i in range(len(x["facts"]))] and len(x["evidence"]) == sum(c == cik for c in wanted.values())
