"""Operators on small inputs with known results."""

import datetime
import hashlib
import hmac
from decimal import Decimal
from random import Random

import pytest
from pyspark.sql import functions as F

from tessera.functions import identity
from tessera.functions.embedding import hashed_embedding
from tessera.functions.english import lexeme, stem
from tessera.operators import answers, documents, evaluation, experiments, filings, fulltext, retrieval, store


def test_fusion_orders_by_score_then_ranks(spark):
    rows = lambda ids: spark.createDataFrame([(x, i + 1, 0.5) for i, x in enumerate(ids)], "id string, rank int, score double")
    fused = retrieval.fuse(rows(["a", "b"]), rows(["b", "c"]), id_col="id").collect()
    assert [r.id for r in fused] == ["b", "a", "c"]
    assert fused[0].score == pytest.approx(1 / 61 + 1 / 62) and fused[0].matched_by == "keyword,semantic"
    with pytest.raises(ValueError):
        retrieval.fuse(rows(["a"]), rows(["b"]), id_col="id", weights=(0, 0))


def test_graded_ndcg_counts_the_ideal_order(spark):
    judged = spark.createDataFrame([(1, 10, 3), (1, 11, 1)], "case_id long, doc_id long, grade int")
    ranked = spark.createDataFrame([(1, 99, 1), (1, 10, 2)], "case_id long, doc_id long, rank int")
    found = {r.metric: r.value for r in evaluation.retrieval_metrics(judged, ranked, 2).collect()}
    log3 = 1.584962500721156
    assert found["recall"] == 0.5 and found["reciprocal_rank"] == 0.5
    assert found["ndcg"] == pytest.approx((7 / log3) / (7 + 1 / log3))


def test_comparison_of_a_known_pair(spark):
    deltas = [1.0, -0.5, 2.0, 0.0, 0.25]
    pairs = spark.createDataFrame([("m", i, 1.0, 1.0 + d, d) for i, d in enumerate(deltas)], "metric string, case_id long, control double, treatment double, delta double")
    row = evaluation.comparison(pairs, iterations=200).first()
    rng = Random(17)
    means = sorted(sum(deltas[rng.randrange(5)] for _ in deltas) / 5 for _ in range(200))
    # Ranks 4.975 and 194.025 of 0 to 199.
    assert row.low == pytest.approx(means[4] + 0.975 * (means[5] - means[4])) and row.high == pytest.approx(means[194] + 0.025 * (means[195] - means[194]))
    assert (row.n, row.delta, row.sign_p) == (5, pytest.approx(0.55), pytest.approx(0.625)) and row.relative_delta == pytest.approx(0.55)


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_blocks_of_a_comparison_draw_as_one(spark, block):
    random = Random(3)
    deltas = {m: {f"case {random.random()}": random.gauss(0.2, 1) for _ in range(n)} for m, n in (("a", 33), ("b", 90), ("c", 1))}
    rows = [(m, c, 0.0, d, d) for m, cases in deltas.items() for c, d in cases.items()]
    pairs = spark.createDataFrame(rows, "metric string, case_id string, control double, treatment double, delta double").repartition(5)
    found = {r.metric: (r.low, r.high) for r in evaluation.comparison(pairs, iterations=100, block=block).collect()}
    for place, m in enumerate("abc"):
        rng, values = Random(17 + place), [deltas[m][c] for c in sorted(deltas[m])]
        means = sorted(sum(values[rng.randrange(len(values))] for _ in values) / len(values) for _ in range(100))
        at = lambda q: means[int(q * 99)] + (q * 99 - int(q * 99)) * (means[min(int(q * 99) + 1, 99)] - means[int(q * 99)])  # noqa: B023, E731
        assert found[m] == (pytest.approx(at(0.025)), pytest.approx(at(0.975)))


def test_comparison_of_no_pairs(spark):
    none = spark.createDataFrame([], "metric string, case_id long, control double, treatment double, delta double")
    assert evaluation.comparison(none).count() == 0


def test_power_plan():
    assert experiments.sample_size(0.5, 0.1) == 388 and experiments.sample_size(0.4, 0.25) == 62


def test_windows_overlap(spark):
    df = spark.createDataFrame([(i, " ".join(map(str, range(n)))) for i, n in enumerate((1, 10, 11, 25))] + [(9, None), (10, "  ")], "d long, text string")
    rows = documents.token_windows(df, doc="d", text="text", size=10, overlap=3).orderBy("d", "chunk_index").collect()
    for d, n in enumerate((1, 10, 11, 25)):
        found = [list(map(int, r.content.split())) for r in rows if r.d == d]
        assert sorted({x for w in found for x in w}) == list(range(n)) and all(len(w) <= 10 for w in found)
        assert all(b[0] == a[-1] - 2 for a, b in zip(found, found[1:], strict=False))
    assert {r.d for r in rows} == {0, 1, 2, 3}


def test_headings(spark):
    rows = [("ITEM 1A. RISK FACTORS", True), ("Part II", True), ("Part II, Item 1", False), ("Item 7", False), ("Items 1 and 2", False)]
    found = spark.createDataFrame(rows, "t string, e boolean").select(documents.is_heading(F.col("t")).alias("h"), "e").collect()
    assert all(r.h == r.e for r in found)


def test_keyed_hash_is_hmac(spark):
    secret = "s" * 40
    got = spark.createDataFrame([(" u1 ",)], "u string").select(identity.unit_hash(secret, "e", "v", F.col("u"))).first()[0]
    assert got == hmac.new(secret.encode(), b"e:v:u1", hashlib.sha256).hexdigest()


def test_calculations_fail_softly(spark):
    facts = spark.createDataFrame([("F1", "40", "USD"), ("F2", "100", "USD"), ("F3", "0", "USD"), ("F4", "5", "shares")], "fact_id string, value string, unit string")
    cases = [
        ("a", "percentage_change", ["F1", "F2"], "150", "%", None, "150.0", True),
        ("b", "identity", ["F1"], "40.001", "usd", None, "40", True),
        ("c", "sum", ["F1"], "40", "USD", "wrong number of facts", None, False),
        ("d", "ratio", ["F1", "F3"], "1", "ratio", "division by zero", None, False),
        ("e", "sum", ["F1", "F4"], "45", "USD", "facts have different units", None, False),
        ("f", "difference", ["F1", "F9"], "1", "USD", "unknown fact", None, False),
        ("g", "difference", ["F1", "F2"], "-60", "EUR", None, "-60", False),
        ("h", "sum", ["F1", "F2"], "141", "USD", None, "140", False),
        ("i", "ratio", ["F2", "F1"], "2.5", "ratio", None, "2.5", True),
        ("j", "identity", ["F1"], "x", "USD", None, "40", False),
    ]
    df = spark.createDataFrame([c[:5] for c in cases], "calc_id string, operation string, fact_ids array<string>, reported string, reported_unit string")
    found = {r.calc_id: r for r in answers.validated(df, facts).collect()}
    for name, *_, why, expected, passed in cases:
        r = found[name]
        assert (r.failure, r.passed) == (why, passed), name
        assert (r.expected is None) == (expected is None) and (expected is None or Decimal(r.expected) == Decimal(expected))


FILING = """<html><head><style>p {color: red}</style><script>var x = '<p>no</p>';</script></head><body><h1>Annual report</h1><p>Opening words.</p>
<p>ITEM 1A. RISK FACTORS</p><div><p>Risk one &amp; two.</p></div><p>Risk one &amp; two.</p><p> </p>
<table><tr><th><p>Year</p></th><th>Sales</th></tr><tr><td>2024</td><td> 10 </td></tr></table></body></html>"""


def test_filing_blocks_become_sections(spark):
    pages = [FILING, "plain words only", "<script>x</script>", "<p>a<p>b", "<h2>h</h2><p>x</p><p>x</p><h2>only a head</h2>"]
    df = spark.createDataFrame(list(enumerate(pages)), "k long, html string")
    found = {r.k: [tuple(x) for x in r.sections] for r in filings.read_filings(df, key="k", html="html").collect()}
    assert found[0] == [("Annual report", "Opening words."), ("ITEM 1A. RISK FACTORS", "Risk one & two.\n\nYear | Sales\n\n2024 | 10")]
    assert found[1] == [("Document", "plain words only")] and found[2] == [] and found[3] == [("Document", "a b\n\nb")] and found[4] == [("h", "x")]
    blocks = {r.k: [tuple(x) for x in r.blocks] for r in filings.read_blocks(df, key="k", html="html").collect()}
    assert blocks[4] == [("h2", "h"), ("p", "x"), ("h2", "only a head")] and blocks[2] == []


def test_filing_rejections(spark):
    many = "".join(f"<h2>h{i}</h2><p>x</p>" for i in range(251))
    df = spark.createDataFrame([(1, FILING), (2, ""), (3, None), (4, "<script>x</script>"), (5, many)], "k long, html string")
    states = {r.k: (r.status, len(r.sections)) for r in filings.read_filings(df, key="k", html="html").collect()}
    assert states == {1: ("ok", 2), 2: ("empty", 0), 3: ("empty", 0), 4: ("no_text", 0), 5: ("too_many_sections", 0)}
    assert filings.filing_sections(df.limit(0), key="k", html="html").count() == 0


def test_hashed_embeddings_are_unit_vectors(spark):
    df = spark.createDataFrame([("a b c",), ("A, b; C",), ("",), (None,)], "t string")
    a, b, blank, null = (r.e for r in df.select(hashed_embedding(F.col("t")).alias("e")).collect())
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-6 and blank is None and null is None


def test_decisions_follow_their_precedence(spark):
    def of(n, delta, low, high, failed):
        rows = spark.createDataFrame([("converted", delta, low, high), ("failed", failed, 0.0, 0.0)], "metric string, delta double, low double, high double")
        arms = spark.createDataFrame([("control", n), ("treatment", 100)], "variant string, n long")
        return experiments.decision(rows, arms, planned=62, primary="converted", effect=0.1, guardrails={"failed": 0.01}).first()

    assert tuple(of(10, 0.3, 0.1, 0.5, 0.0)) == ("collecting", None)
    assert of(90, 0.3, 0.1, 0.5, 0.02).decision == "halt"
    assert of(90, 0.3, 0.1, 0.5, 0.01).decision == "ship"
    assert of(90, -0.3, -0.5, -0.1, 0.0).decision == "keep_control"
    assert of(90, 0.05, 0.01, 0.1, 0.0).decision == "inconclusive"


# --- full text


def test_stems():
    known = {
        "consistency": "consist", "conspiracies": "conspiraci", "knitting": "knit", "hoping": "hope", "hopping": "hop", "ties": "tie", "cries": "cri", "gas": "gas",
        "kiwis": "kiwi", "happy": "happi", "relational": "relat", "generation": "generat", "general": "general", "communism": "communism", "agreed": "agre",
        "feed": "feed", "electricity": "electr", "liabilities": "liabil", "skies": "sky", "by": "by", "say": "say", "controlling": "control", "proceed": "proceed",
    }
    assert {w: stem(w) for w in known} == known
    assert lexeme("the") is None and lexeme("rates") == "rate"


def _covers(places, query):
    """Minimal covers by trying every stretch of positions; phrases and negation left out."""
    wanted = {s for terms in query for t in terms for s in t.stems}
    at = sorted({p for s, found in places.items() if s in wanted for p in found})
    holds = lambda a, b: any(all(any(a <= p <= b for p in places.get(t.stems[0], ())) for t in terms) for terms in query)
    rank = 0.0
    for a in at:
        for b in (x for x in at if x >= a):
            inner = any(holds(x, y) for x in at for y in at if a <= x <= y <= b and (x, y) != (a, b))
            if holds(a, b) and not inner:
                inside = sum(a <= p <= b for p in at)
                rank += 0.1 / (1 + (b - a) - (inside - 1))
    return rank


def _query(*alternatives):
    return [[fulltext.term(w.lstrip("-"), negated=w.startswith("-")) for w in words] for words in alternatives]


def test_cover_density_equals_all_stretches(spark):
    random = Random(5)
    texts, at = [], []
    for _ in range(200):
        slots = random.sample(range(1, 30), 9)
        places = {s: sorted(slots[i * 3 : i * 3 + random.randint(1, 3)]) for i, s in enumerate(("cat", "dog", "owl"))}
        words = {p: s for s, found in places.items() for p in found}
        at.append(places)
        texts.append((len(texts), " ".join(words.get(p, "zzz") for p in range(1, 31))))
    df = spark.createDataFrame(texts, "id long, body string")
    for query in (_query(["cat"]), _query(["cat", "dog"]), _query(["cat", "dog"], ["owl"]), _query(["cat", "dog", "owl"]), _query(["cat"], ["dog"])):
        found = {r.id: r.score for r in fulltext.fulltext_scores(df, query, id_col="id", text="body").collect()}
        assert found == pytest.approx({i: _covers(places, query) for i, places in enumerate(at)})


def test_structured_queries(spark):
    rows = [(1, "Supply constraints hit the supplies"), (2, "constraints of supply"), (3, "supply"), (4, None), (5, ""), (6, "risk of the suppliers constraint")]
    df = spark.createDataFrame(rows, "id long, body string")
    find = lambda *query: {r.id: r.score for r in fulltext.fulltext_scores(df, _query(*query), id_col="id", text="body").collect()}
    assert find(["supply"]) == pytest.approx({1: 0.2, 2: 0.1, 3: 0.1})
    assert find(["supply constraints"]) == pytest.approx({1: 0.1})
    assert find(["constraints of supply"]) == pytest.approx({2: 0.05}) and find(["constraints supply"]) == {}
    assert find(["supply", "-constraints"]) == pytest.approx({3: 0.1}) and set(find(["risk"], ["supply"])) == {1, 2, 3, 6}
    assert find(["the", "of"]) == {} and find() == {} and find([""]) == {} and find(["-supply"]) == {5: 0.0, 6: 0.0}
    assert find(["supply", "constraints"])[1] == pytest.approx(0.1 + 0.1 / 3)
    assert find(["supply", "-risk"], ["risk", "-supply", "constraint"]).keys() == {1, 2, 3, 6}
    at = {(r.id, r.lexeme): list(r.positions) for r in fulltext.postings(df, id_col="id", text="body").collect()}
    assert at[1, "suppli"] == [1, 5] and at[2, "suppli"] == [3] and (2, "of") not in at


def test_positions_of_long_texts_have_no_bound(spark):
    text = "filler " * 40_000 + "cat dog " + "filler " * 50 + "dog cat"
    df = spark.createDataFrame([(1, text)], "id long, body string")
    assert fulltext.fulltext_scores(df, _query(["cat dog"]), id_col="id", text="body").first().score == pytest.approx(0.1)
    assert max(r.positions[-1] for r in fulltext.postings(df, id_col="id", text="body", stems=["cat"]).collect()) == 40_054


# --- lifecycle and streams


def test_transitions_equal_a_loop(spark):
    random = Random(3)
    rows = [(t, i, random.choice(experiments.STATUSES)) for t in range(40) for i in range(8)]
    log = spark.createDataFrame(rows, "t int, i int, s string")
    expected, state = {}, {}
    for t, i, s in rows:
        now = state.get(t, "draft")
        expected[t, i] = "unchanged" if s == now else "accepted" if (now, s) in experiments.CHANGES else "rejected"
        state[t] = s if expected[t, i] == "accepted" else now
    found = experiments.transitions(log, thread="t", order=["i"], status="s").collect()
    assert {(r.t, r.i): r.verdict for r in found} == expected


def test_registrations_and_upserts(spark):
    rows = spark.createDataFrame([("k", "a", 1), ("k", "a", 2), ("k", "b", 3), (None, "a", 4), (None, None, 5)], "k string, f string, n int")
    found = {r.n: r.verdict for r in store.registrations(rows, ["k"], "f", "n").collect()}
    assert found == {1: "registered", 2: "unchanged", 3: "conflict", 4: "registered", 5: "conflict"}
    old = spark.createDataFrame([(1, "x", "y")], "k int, a string, b string")
    new = spark.createDataFrame([(1, None, "z")], "k int, a string, b string")
    assert [tuple(r) for r in store.upsert(old, new, "k", ["a", "b"]).collect()] == [(1, None, "z")]
