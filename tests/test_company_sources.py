"""The folder source of submissions, and fact documents as variants."""

import datetime
import json
import os

import pytest

from tessera.sources import company_folder, company_json


def write(folder, cik, n, of=None):
    recent = {"accessionNumber": [f"{cik}-{i}" for i in range(n)], "form": ["10-K"] * n, "filingDate": ["2024-01-02"] * n, "reportDate": ["", *["2023-12-31"] * (n - 1)][:n], "primaryDocument": ["x"] * n}
    (folder / f"{cik:010d}.json").write_text(json.dumps({"cik": str(of or cik), "filings": {"recent": recent}, "unheard": [1]}))


def test_filings_of_a_folder(spark, tmp_path):
    company_folder.register(spark)
    for cik in range(1, 31):
        write(tmp_path, cik, cik % 4)
    (tmp_path / "notes.txt").write_text("no document")
    read = spark.read.format("company_submissions").option("groups", 4).load(str(tmp_path))
    assert read.count() == sum(c % 4 for c in range(1, 31)) and read.rdd.getNumPartitions() == 4
    row = read.where("cik = '0000000007' and ordinal < 2").orderBy("ordinal").collect()
    assert [(r.ordinal, r.accession_number, r.report_date) for r in row] == [(0, "7-0", None), (1, "7-1", datetime.date(2023, 12, 31))]
    one = read.where("cik = '0000000007'")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 3
    assert read.where("cik in ('0000000003', '0000000002')").count() == 5 and read.where("cik = 'none'").count() == 0
    write(tmp_path, 40, 1, of=41)
    with pytest.raises(Exception, match="no document of company"):
        spark.read.format("company_submissions").load(f"file://{tmp_path}").collect()


def test_a_stream_of_documents_reads_what_is_new(spark, tmp_path):
    company_folder.register(spark)
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def run():
        stream = spark.readStream.format("company_submissions").load(str(source))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(company_folder.SCHEMA).parquet(out).count()

    write(source, 1, 3)
    assert run() == 3 and run() == 3
    write(source, 2, 2)
    os.utime(source / "0000000002.json")
    assert run() == 5


def test_facts_as_variants(spark):
    fact = {"val": "85777000000", "accn": "a", "fy": 2024, "form": "10-K", "filed": "2024-01-02", "end": "2023-12-31", "frame": "CY2023", "unheard": {"of": [1, 2]}}
    body = {"cik": 7, "facts": {"us-gaap": {"Sales": {"label": "x", "units": {"USD": [fact, {**fact, "val": 1.5}], "EUR": [{**fact, "val": None}]}}, "Empty": {"units": {}}}, "dei": {}}}
    read = lambda b: company_json.company_facts(spark.createDataFrame([("0000000007", b)], "cik string, body string"), cik="cik", body="body")
    rows = {(r.unit, str(r.value)): r for r in read(json.dumps(body)).collect()}
    assert set(rows) == {("USD", "85777000000.00"), ("USD", "1.50"), ("EUR", "None")}
    assert rows["USD", "1.50"].fiscal_year == 2024 and rows["USD", "1.50"].end_date == datetime.date(2023, 12, 31)
    assert rows["USD", "1.50"].other.toPython()["unheard"] == {"of": [1, 2]}
    assert read('{"cik": 7}').count() == 0 and read('{"cik": 7, "facts": {"us-gaap": []}}').count() == 0
    for bad in ('{"cik": 8}', "no json", "[]"):
        with pytest.raises(Exception, match="no document of company"):
            read(bad).collect()
