"""What reading companies' fact documents moves, and the bound on a document's observations."""

import json

import pytest

from tessera.plans import registry
from tessera.sources import company_json
from tessera.sources.adapters import Domain
from tests.moved import moved

SF = "/root/testdata/sf0.01"


def test_facts_move_once_to_their_filings(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as between large tables
    try:
        lines = Domain(spark, SF).raw("lineitem").count()
        before = moved(spark)
        assert registry.QUERIES["company_facts_read"](spark, SF).count() == 29936
        assert moved(spark) - before < 60 * lines
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def read(spark, body, limit, **more):
    texts = spark.createDataFrame([("0000000007", 5, json.dumps(body))], "cik string, place int, body string")
    return company_json.company_facts(texts, cik="cik", body="body", limit=limit, **more)


def test_a_document_of_too_many_facts_is_an_error(spark):
    facts = {"us-gaap": {"A": {"units": {"USD": [{"val": 1}, {"val": 2}], "EUR": [{"val": 3}]}}, "B": {"units": {"USD": [{"val": 4}]}}, "odd": 3, "none": {"units": None}, "bare": {}, "words": {"units": {"USD": "x"}}},
             "DEI": {"C": {"units": {"n": [1, None]}}}, "other": {"D": {"units": {"n": list(range(99))}}}, "dei ": []}
    body = {"cik": 7, "facts": facts}
    wanted = read(spark, body, 100_000).count()
    assert wanted >= 6
    assert read(spark, body, wanted).count() == wanted
    for limit in (wanted - 1, 0):
        with pytest.raises(Exception, match="too many facts of company 0000000007"):
            read(spark, body, limit).count()
    assert read(spark, {"cik": 7, "facts": {"dei": {"C": {"units": {"n": [1, 2]}}}}}, 2).count() == 2
    with pytest.raises(Exception, match="too many facts"):
        read(spark, {"cik": 7, "facts": {"dei": {"C": {"units": {"n": [1, 2, 3]}}}}}, 2).count()
    assert [(r.place, r.value) for r in read(spark, {"cik": 7, "facts": {"dei": {"C": {"units": {"n": [{"val": 2}]}}}}}, 2, keep=["place"]).collect()] == [(5, 2)]
