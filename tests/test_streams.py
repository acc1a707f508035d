"""Streams of events over several runs against their batch forms, timers that free state, and rows behind the watermark."""

import datetime
import random

from pyspark.sql import functions as F
from tests.test_contracts import EVENTS, KINDS, event_log, looped

from tessera.operators import experiments
from tessera.streaming import telemetry

DAY = lambda n, h=0: datetime.datetime(2024, 1, n, h)


def test_exposures_across_runs(spark, tmp_path):
    schema = "unit_id string, event_id long, ts timestamp_ntz, event_type string, value double"
    batches = [
        [("u", 1, DAY(1), "purchase"), ("u", 2, DAY(2), "view"), ("u", 3, DAY(3), "purchase"), (None, 4, DAY(1), "view")],
        [("u", 5, DAY(1), "view"), ("u", 6, DAY(4), "purchase"), ("u", 7, DAY(4), "view"), ("v", 8, DAY(5), "view")],
        [("v", 9, DAY(6), "purchase"), ("v", 10, DAY(6), "purchase"), ("u", 11, DAY(9), "error")],
    ]
    for rows in batches:
        made = spark.createDataFrame([(*r, 1.0) for r in rows], schema)
        made.write.mode("append").parquet(f"{tmp_path}/in")
        ended = telemetry.exposure_stream(spark, f"{tmp_path}/in", made.schema, f"{tmp_path}/run")
        assert ended.batches == 1
    assert telemetry.exposure_stream(spark, f"{tmp_path}/in", made.schema, f"{tmp_path}/run").batches == 0
    found = {r.event_id: r.verdict for r in spark.read.parquet(ended.folder).collect()}
    assert found == {
        1: "before_exposure", 2: "accepted", 3: "accepted", 4: "before_exposure", 5: "before_exposure", 6: "repeated_outcome", 7: "repeated_exposure",
        8: "accepted", 9: "accepted", 10: "repeated_outcome", 11: "accepted",
    }


def test_acceptance_over_runs_is_that_of_the_batch(spark, tmp_path):
    rows = event_log(random.Random(9), 900)
    for i in range(3):  # each run is a restart of the query from its checkpoint
        part = spark.createDataFrame([r for r in rows if 300 * i <= r[1] < 300 * (i + 1)], EVENTS)
        part.write.mode("append").parquet(f"{tmp_path}/in")
        ended = telemetry.accept_stream(spark, f"{tmp_path}/in", part.schema, KINDS, f"{tmp_path}/run", arrival=F.col("n"))
    found = {(r.assignment_id, r.arrival): r.verdict for r in spark.read.parquet(ended.folder).collect()}
    whole = experiments.accepted_events(spark.createDataFrame(rows, EVENTS), KINDS, order=["n"]).collect()
    assert found == looped(rows, KINDS) == {(r.assignment_id, r.n): r.verdict for r in whole}


def test_a_timer_frees_state(spark, tmp_path):
    at = lambda a, n, key, day, kind="exposure", metric=None, value=None: (a, n, key, kind, metric, value, DAY(day), DAY(1), {})
    runs = [[at(1, 0, "k", 1), at(1, 1, "o", 2, "outcome", "a", 1.0)], [at(2, 2, "k", 20), at(1, 3, "k", 1)], [at(1, 4, "k", 28), at(3, 5, "k", 2)], []]
    for rows in runs:
        part = spark.createDataFrame(rows, EVENTS)
        part.write.mode("append").parquet(f"{tmp_path}/in")
        ended = telemetry.accept_stream(spark, f"{tmp_path}/in", part.schema, KINDS, f"{tmp_path}/run", arrival=F.col("n"), closes_after_days=5)
        late = ended.late if rows is runs[2] else 0
        if rows is runs[2]:
            assert late == 1  # the event of day 2 is behind the watermark
    found = {r.arrival: r.verdict for r in spark.read.parquet(ended.folder).collect()}
    # On day 28 the first assignment's state is gone, and its key is free.
    assert found == {0: "accepted", 1: "accepted", 2: "accepted", 4: "accepted"} | ({3: found[3]} if 3 in found else {})


def test_outcomes_within_the_window(spark, tmp_path):
    rng, rows = random.Random(3), []
    for i in range(600):
        rows.append((f"u{rng.randint(0, 30)}", i, DAY(1) + datetime.timedelta(hours=i // 4, minutes=rng.randint(0, 59)), rng.choice(["view", "purchase", "click", "error"]), rng.random()))
    rows += [("w", 900, DAY(3), "view", 0.0), ("w", 901, DAY(4), "purchase", 0.0), ("x", 902, DAY(3), "view", 0.0), ("x", 903, DAY(3, 23), "purchase", 0.0), ("y", 904, DAY(3), "click", 9.0)]
    events = spark.createDataFrame(rows, "unit_id string, event_id long, ts timestamp_ntz, event_type string, value double")
    step = lambda: telemetry.exposure_stream(spark, f"{tmp_path}/in", events.schema, f"{tmp_path}/judged")
    assert len(telemetry.replayed(events, "ts", f"{tmp_path}/in", step, slices=3)) == 3
    ended = telemetry.outcomes_in_window(spark, f"{tmp_path}/judged/rows", f"{tmp_path}/joined")
    assert ended.late == 0
    found = telemetry.observed(events, spark.read.parquet(f"{tmp_path}/judged/rows"), spark.read.parquet(ended.folder))
    tidy = lambda df: sorted((r.unit_id, r.exposed, r.converted, r.failed, r.click_value and round(r.click_value, 9)) for r in df.collect())
    assert tidy(found) == tidy(experiments.observations(events))
