"""Contracts, artifacts, JSON sources and acceptance on small inputs with known results."""

import datetime
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import contracts, experiments, investigations
from tessera.sources import company_json


def test_search_requests_are_normal_or_refused(spark):
    day = datetime.date(2024, 1, 2)
    plain = {"text": " sales ", "top_k": 10, "candidate_k": 50, "cik": " 320193", "forms": [" 10-q", "10-K"], "sections": ["b", " a"], "filed_from": None, "filed_to": day, "wanted": ""}
    wrong = [
        ("text", {"text": " "}), ("top_k", {"top_k": 0}), ("top_k", {"top_k": 51, "candidate_k": 60}), ("candidate_k", {"top_k": 20, "candidate_k": 10}), ("candidate_k", {"candidate_k": 201}),
        ("form_types", {"forms": ["10-K", "10-k "]}), ("form_types", {"forms": [" "]}), ("filed_from", {"filed_from": day + datetime.timedelta(1)}), ("cik", {"cik": "12x"}),
        ("section_names", {"sections": ["a", "a"]}), ("", {"cik": None, "forms": [], "sections": []}), ("top_k,form_types", {"top_k": -1, "forms": ["8-K", ""]}),
    ]
    rows = [plain, *(plain | change | {"wanted": name} for name, change in wrong)]
    schema = "text string, top_k int, candidate_k int, cik string, forms array<string>, sections array<string>, filed_from date, filed_to date, wanted string"
    found = contracts.normal_requests(spark.createDataFrame(rows, schema)).collect()
    assert [r.violated for r in found] == [r["wanted"] for r in rows]
    assert (found[0].text, found[0].cik, found[0].forms, found[0].sections) == ("sales", "0000320193", ["10-K", "10-Q"], ["a", "b"])


def test_vectors_of_a_provider(spark):
    one = lambda rows: spark.createDataFrame([(r,) for r in rows], "v array<double>")
    assert contracts.query_vector(one([[1.0, 2.0]]), 2) == [1.0, 2.0]
    for bad in ([], [[1.0]], [[1.0, 2.0], [1.0, 2.0]], [[1.0, float("nan")]], [None], [[1.0, None]]):
        with pytest.raises(ValueError):
            contracts.query_vector(one(bad), 2)
    texts = [(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (2, 1, " "), (3, 0, "a"), (4, 0, "a"), (4, 1, "b"), (5, 0, "a"), (6, 0, "a"), (7, 0, "a")]
    found = [(1, 1, [2.0]), (1, 0, [1.0]), (2, 0, [1.0]), (2, 1, [1.0]), (3, 1, [1.0]), (4, 0, [1.0]), (4, 0, [2.0]), (5, 0, [1.0, 2.0]), (6, 0, [float("inf")])]
    rows = contracts.provided_vectors(spark.createDataFrame(texts, "batch int, place int, text string"), spark.createDataFrame(found, "batch int, index int, vector array<double>"), 1).collect()
    assert {(r.batch, r.place): r.vector for r in rows if r.fault is None} == {(1, 0): [1.0], (1, 1): [2.0]}
    assert {r.batch: r.fault for r in rows if r.fault} == {2: "blank_text", 3: "indexes", 4: "indexes", 5: "dimensions", 6: "not_finite", 7: "indexes"}
    assert all(r.vector is None for r in rows if r.fault) and len(rows) == len(texts)


def test_fingerprints_are_of_canonical_text():
    text = '{"a":"\\u00e9","b":[1,2.5,null]}'
    assert contracts.fingerprint({"b": [1, 2.5, None], "a": "é"}) == hashlib.sha256(text.encode()).hexdigest()


def test_artifacts_are_bounded_and_typed(spark, tmp_path):
    path = str(tmp_path / "report" / "x.json")
    contracts.write_report(path, {"n": 3, "name": "é"})
    assert json.load(open(path)) == {"n": 3, "name": "é"} and [p.name for p in (tmp_path / "report").iterdir()] == ["x.json"]
    assert contracts.load_artifact(spark, path, "n int, name string").collect() == [(3, "é")]
    with pytest.raises(ValueError):
        contracts.load_artifact(spark, path, "n int, name string", limit=5)
    contracts.write_report(path, {"n": "three", "name": "é"})
    with pytest.raises(ValueError):
        contracts.load_artifact(spark, path, "n int, name string")
    with pytest.raises(TypeError):
        contracts.write_report(path, {"n": {1}})
    assert json.load(open(path))["n"] == "three" and len(list((tmp_path / "report").iterdir())) == 1


def test_answers_from_drafts(spark):
    cases = spark.createDataFrame([(i,) for i in range(1, 7)], "case_id long")
    passages = spark.createDataFrame([(i, 2) for i in (1, 2, 3, 4, 5)], "case_id long, n int")
    facts = spark.createDataFrame([(1, 1)], "case_id long, n int")
    claims = spark.createDataFrame([(1, 0, "Up.", ["E1", "F1"]), (1, 1, "Down.", ["E2"]), (2, 0, "No.", ["E3", "X", "F1"]), (6, 0, "Unread.", ["E9"])], "case_id long, place int, statement string, ids array<string>")
    sums = spark.createDataFrame([(1, 0, "Sum.", ["F1"], True, ""), (3, 0, "Off.", ["F1"], False, "wrong sum"), (3, 1, "Off.", ["F1"], False, "wrong sum"), (5, 0, "Sum.", ["F1"], True, "")], "case_id long, place int, statement string, ids array<string>, passed boolean, message string")
    limits = spark.createDataFrame([(3, 0, "few pages"), (3, 1, "wrong sum"), (6, 0, "unread")], "case_id long, place int, text string")
    found = {r.case_id: r for r in investigations.investigate(cases, passages, facts, claims, sums, limits).collect()}
    assert (found[1].status, found[1].answer) == ("grounded", "Up. [E1] [F1]\n\nDown. [E2]\n\nSum. [F1]") and found[1].review_reasons == [investigations.REVIEW]
    assert (found[2].status, found[2].answer, found[2].unknown_evidence) == ("rejected", None, ["E3", "X", "F1"])
    assert (found[3].status, found[3].answer, found[3].limitations) == ("needs_review", investigations.NOTHING, ["few pages", "wrong sum"])
    assert found[3].review_reasons == [investigations.REVIEW, investigations.FAILED, investigations.NO_CLAIMS]
    assert (found[4].status, found[4].limitations, found[4].review_reasons) == ("insufficient_evidence", [], [investigations.REVIEW, investigations.NO_CLAIMS])
    assert (found[5].status, found[5].answer) == ("grounded", "Sum. [F1]")
    assert (found[6].status, found[6].answer, found[6].limitations) == ("insufficient_evidence", investigations.NOTHING, [investigations.NO_PASSAGES])
    assert found[6].review_reasons == [investigations.REVIEW, investigations.NO_EVIDENCE] and all(r.requires_human_review for r in found.values())


def test_events_as_they_arrive(spark):
    t = [datetime.datetime(2024, 1, 1, h) for h in range(12)]
    rows = [
        ("early", "exposure", None, None, t[0], "before_assignment"), ("o1", "outcome", "converted", 1.0, t[2], "before_exposure"), ("x", "exposure", None, None, t[3], "accepted"),
        ("x", "exposure", None, None, t[3], "duplicate"), ("x", "exposure", None, None, t[4], "conflict"), ("x2", "exposure", None, None, t[4], "repeated_exposure"),
        ("o0", "outcome", "converted", 0.5, t[5], "not_binary"), ("u", "outcome", "other", 1.0, t[5], "unknown_metric"), ("o1", "outcome", "converted", 1.0, t[6], "accepted"),
        ("o1", "outcome", "converted", 1.0, t[6], "duplicate"), ("o1", "outcome", "converted", 0.0, t[6], "conflict"), ("o2", "outcome", "converted", 1.0, t[7], "repeated_outcome"),
        ("v", "outcome", "value", 7.5, t[8], "accepted"),
    ]
    schema = "assignment_id long, assigned_at timestamp, n int, event_key string, event_type string, metric_name string, metric_value double, occurred_at timestamp, wanted string"
    df = spark.createDataFrame([(1, t[1], i, *r) for i, r in enumerate(rows)], schema)
    found = experiments.accepted_events(df, {"converted": "binary", "value": "continuous"}, order=["n"]).orderBy("n").collect()
    assert [r.verdict for r in found] == [r.wanted for r in found]


def test_a_key_in_conflict_leaves_its_metric_free(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [(1, "e", "exposure", None, None), (2, "K", "outcome", "a", 1.0), (3, "K", "outcome", "b", 1.0), (4, "K2", "outcome", "b", 1.0)]
    df = spark.createDataFrame([(1, at, n, k, t, m, v, at) for n, k, t, m, v in rows], "assignment_id long, assigned_at timestamp, n int, event_key string, event_type string, metric_name string, metric_value double, occurred_at timestamp")
    found = experiments.accepted_events(df, {"a": "binary", "b": "binary"}, order=["n"]).orderBy("n").collect()
    assert [r.verdict for r in found] == ["accepted", "accepted", "conflict", "accepted"]


def looped(rows, kinds):
    """Verdicts on (assignment, n, key, type, metric, value, occurred, assigned, metadata), one by one."""
    taken, out = {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        a, n, key, kind, metric, value, occurred, assigned, more = r
        have = taken.setdefault(a, {})
        what, metrics = (kind, metric, value, occurred, tuple(sorted(more.items()))), {x[1] for x in have.values()}
        if key in have:
            out[a, n] = "duplicate" if have[key] == what else "conflict"
        elif occurred < assigned:
            out[a, n] = "before_assignment"
        elif kind == "outcome" and metric not in kinds:
            out[a, n] = "unknown_metric"
        elif kind == "outcome" and kinds[metric] == "binary" and value not in (0.0, 1.0):
            out[a, n] = "not_binary"
        elif kind == "exposure" and None in metrics:
            out[a, n] = "repeated_exposure"
        elif kind == "outcome" and None not in metrics:
            out[a, n] = "before_exposure"
        elif metric in metrics:
            out[a, n] = "repeated_outcome"
        else:
            have[key], out[a, n] = what, "accepted"
    return out


KINDS = {"a": "binary", "b": "binary", "c": "continuous"}
EVENTS = "assignment_id long, n long, event_key string, event_type string, metric_name string, metric_value double, occurred_at timestamp, assigned_at timestamp, metadata map<string,string>"


def event_log(rng, n):
    """Events whose keys are often used again, for the same or for another metric, and are often sent twice."""
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.2:
            old = rng.choice(rows)
            rows.append((old[0], i, *old[2:]))
            continue
        kind, metric = ("exposure", None) if rng.random() < 0.25 else ("outcome", rng.choice("abcz"))
        value = None if metric is None else rng.choice([0.0, 1.0, 0.5])
        day = datetime.datetime(2024, 1, rng.randint(1, 5))
        rows.append((rng.randint(1, n // 25), i, f"k{rng.randint(0, 6)}", kind, metric, value, day, datetime.datetime(2024, 1, 2), {"m": str(rng.randint(0, 1))}))
    return rows


def test_verdicts_are_those_of_a_plain_loop(spark):
    rows = event_log(random.Random(6), 3000)
    found = experiments.accepted_events(spark.createDataFrame(rows, EVENTS), KINDS, order=["n"]).collect()
    wanted = looped(rows, KINDS)
    assert {(r.assignment_id, r.n): r.verdict for r in found} == wanted and len(found) == len(rows) and len(set(wanted.values())) == 9


def test_effects_follow_directions(spark):
    rows = spark.createDataFrame([("a", 0.3), ("b", 0.3), ("c", -0.3)], "metric string, delta double")
    ways = {"a": "higher_is_better", "b": "lower_is_better", "c": "lower_is_better"}
    found = {r.metric: (r.gain, r.practical, r.breached) for r in experiments.effects(rows, ways, {"a": 0.2, "c": 0.3}, {"b": 0.3, "c": 0.1}).collect()}
    assert found == {"a": (0.3, True, None), "b": (-0.3, None, False), "c": (0.3, True, False)}


def test_documents_of_companies(spark):
    body = {"cik": "7", "filings": {"recent": {"accessionNumber": ["a", "b"], "form": ["10-K", "8-K"], "filingDate": ["2024-01-02", "2024-01-01"], "reportDate": ["", "2023-12-31"], "primaryDocument": ["x", "y"]}}}
    texts = lambda b, cik="0000000007": spark.createDataFrame([(cik, json.dumps(b))], "cik string, body string")
    found = company_json.submissions(texts(body), cik="cik", body="body").collect()
    assert [(r.ordinal, r.accession_number, r.report_date) for r in found] == [(0, "a", None), (1, "b", datetime.date(2023, 12, 31))]
    uneven = json.loads(json.dumps(body))
    uneven["filings"]["recent"]["form"].pop()
    for wrong in (texts(uneven), texts(body, "0000000008")):
        with pytest.raises(Exception, match="of company"):
            company_json.submissions(wrong, cik="cik", body="body").collect()
    fact = {"val": 1.25, "accn": "a", "fy": 2024, "form": "10-K", "filed": "2024-01-02", "end": "2023-12-31"}
    facts = {"cik": "7", "facts": {"dei": {"Shares": {"units": {"pure": [fact]}}}, "us-gaap": {"Sales": {"units": {"USD": [fact, fact], "EUR": [fact]}}}}}
    read = lambda **more: company_json.company_facts(texts(facts), cik="cik", body="body", **more)
    assert read().count() == 4 and read(taxonomies=[" US-GAAP"]).count() == 3 and read(taxonomies=["ifrs"]).count() == 0
    assert str(read(taxonomies=["dei"]).first().value) == "1.25"
    with pytest.raises(Exception, match="too many facts"):
        read(limit=3).collect()
    with pytest.raises(ValueError):
        read(taxonomies=[" "])


def test_threads(spark):
    rows = [(1, "resume", "not_found"), (2, "get", "not_found"), (3, "start", "started"), (4, "start", "conflict"), (5, "get", "shown"), (6, "resume", "resumed"), (7, "resume", "conflict"), (8, "get", "shown")]
    df = spark.createDataFrame([(1, *r) for r in rows], "t int, n int, command string, wanted string")
    assert all(r.verdict == r.wanted for r in investigations.thread_verdicts(df, thread="t", order=["n"], command="command").collect())


def test_assignment_requests(spark):
    rows = [(1, "a", 1, "before_start"), (2, "a", 5, "assigned"), (3, "a", 6, "existing"), (4, "b", 10, "after_end"), (5, "b", 9, "not_running")]
    df = spark.createDataFrame(rows, "n int, unit string, at int, wanted string")
    status = F.when(F.col("n") == 5, "stopped").otherwise("running")
    found = experiments.assignment_requests(df, unit="unit", at="at", order=["n"], starts=F.lit(5), ends=F.lit(10), status=status).collect()
    assert all(r.verdict == r.wanted for r in found)
