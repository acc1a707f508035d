"""Experiment events as they arrive, by Structured Streaming: verdicts from keyed state, and outcomes joined to exposures within a window."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from tessera.functions.storage import shared_folder
from tessera.operators.experiments import event_body, event_faults

_STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY = 86_400_000


class Acceptance(StatefulProcessor):
    """One assignment's accepted keys (with the digest of their events) and metrics, in a state store; events in their order of arrival.

    At most one exposure and one event a metric are ever accepted, so the state of an assignment is bounded, whatever arrives. ``closes_ms``
    after the assignment a timer on the watermark frees it.
    """

    def __init__(self, closes_ms: int | None) -> None:
        self.closes_ms = closes_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.keys = handle.getMapState("keys", "event_key string", "body string")
        self.metrics = handle.getMapState("metrics", "metric string", "event_key string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        place = lambda r: tuple(r.arrival.values()) if isinstance(r.arrival, dict) else r.arrival  # noqa: E731  a struct comes as a dictionary
        for r in sorted(rows, key=place):
            verdict = self._verdict(r)
            if verdict == "accepted":
                if self.closes_ms and not self.keys.exists():
                    self.handle.registerTimer(r.assigned_ms + self.closes_ms)
                self.keys.updateValue((r.event_key,), (r.body,))
                self.metrics.updateValue((r.metric,), (r.event_key,))
            yield Row(assignment_id=key[0], arrival=r.arrival, verdict=verdict)

    def _verdict(self, r: Row) -> str:
        if self.keys.containsKey((r.event_key,)):
            return "duplicate" if self.keys.getValue((r.event_key,))[0] == r.body else "conflict"
        if r.wrong:
            return r.wrong
        if r.metric and not self.metrics.containsKey(("",)):
            return "before_exposure"
        if self.metrics.containsKey((r.metric,)):
            return "repeated_outcome" if r.metric else "repeated_exposure"
        return "accepted"

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.keys.clear()
        self.metrics.clear()
        return iter(())

    def close(self) -> None:
        pass


class FirstOutcome(StatefulProcessor):
    """One unit's exposure and whether its purchase has been accepted; events by time, then id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.exposed = handle.getValueState("exposed", "at timestamp_ntz")
        self.bought = handle.getValueState("bought", "event_id long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        ordered = sorted(rows, key=lambda r: (r.ts, r.event_id))
        at = self.exposed.get()[0] if self.exposed.exists() else min((r.ts for r in ordered if r.event_type == "view" and key[0] is not None), default=None)
        if at is not None and not self.exposed.exists():
            self.exposed.update((at,))
        for r in ordered:
            if at is None or r.ts < at:
                verdict = "before_exposure"
            elif r.event_type == "view" and r.ts > at:
                verdict = "repeated_exposure"
            elif r.event_type == "purchase" and self.bought.exists():
                verdict = "repeated_outcome"
            else:
                verdict = "accepted"
                if r.event_type == "purchase":
                    self.bought.update((r.event_id,))
            yield Row(**{**r.asDict(), "verdict": verdict})

    def close(self) -> None:
        pass


@dataclass(frozen=True)
class Ended:
    """Where a stream that has run out wrote its rows, in how many batches with rows, and how many rows it dropped as later than the watermark."""

    folder: str
    batches: int
    late: int


def _session(spark: SparkSession) -> SparkSession:
    """A session of its own settings for the store that keyed state needs, so that the caller's stay as they are."""
    session = spark.newSession()
    session.conf.set(*_STORE)
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return session


def _source(session: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return session.readStream.schema(schema).parquet(folder)


def _run(rows: DataFrame, folder: str) -> Ended:
    """Write all that a stream has ready; what an earlier run with the folder has done, by its checkpoint, is not done again."""
    stream = rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress")
    started = stream.trigger(availableNow=True).start()
    started.awaitTermination()
    steps = started.recentProgress
    late = sum(o["numRowsDroppedByWatermark"] for p in steps for o in p["stateOperators"])
    return Ended(f"{folder}/rows", sum(p["numInputRows"] > 0 for p in steps), late)


def accept_stream(spark: SparkSession, source: str, schema: StructType, kinds: dict[str, str], folder: str, *, arrival: Column, closes_after_days: int | None = None) -> Ended:
    """Judge the events in the files of ``source`` that no run has seen: ``assignment_id, arrival, verdict``, as ``accepted_events`` gives them.

    ``arrival`` orders an assignment's events and names them; what a later run sees has arrived later. The keyed state outlives the run: with the same ``folder`` the
    next run goes on where this one ended. With ``closes_after_days`` the events' times make a watermark of that delay, later events are dropped and counted, and an
    assignment's state goes when the watermark is so many days past it. A task sorts one assignment's events of one run.
    """
    session = _session(spark)
    events = _source(session, source, schema)
    wrong, outcome = event_faults(kinds), F.col("event_type") != "exposure"
    lean = events.select(
        "assignment_id", "event_key", arrival.alias("arrival"), F.when(outcome, F.coalesce("metric_name", F.lit("?"))).otherwise("").alias("metric"), wrong.alias("wrong"),
        event_body(events).alias("body"), F.unix_millis(F.col("assigned_at").cast("timestamp")).alias("assigned_ms"), F.col("occurred_at").cast("timestamp").alias("at"),
    )
    timed = lean.withWatermark("at", f"{closes_after_days} days") if closes_after_days else lean.drop("at")
    kind = f"assignment_id {lean.schema['assignment_id'].dataType.simpleString()}, arrival {lean.schema['arrival'].dataType.simpleString()}, verdict string"
    processor = Acceptance(closes_after_days * _DAY if closes_after_days else None)
    judged = timed.groupBy("assignment_id").transformWithState(processor, kind, "Append", "EventTime" if closes_after_days else "None")
    return _run(judged, folder)


def exposure_stream(spark: SparkSession, source: str, schema: StructType, folder: str) -> Ended:
    """The events ``unit_id, event_id, ts, event_type, value`` of ``source``'s files that no run has seen, with a ``verdict``: one exposure and one purchase count for each unit.

    An event without a unit is before its exposure. Later runs see later events.
    """
    events = _source(_session(spark), source, schema).select("unit_id", "event_id", "ts", "event_type", "value")
    judged = events.groupBy("unit_id").transformWithState(FirstOutcome(), StructType([*events.schema, StructField("verdict", StringType())]), "Append", "None")
    return _run(judged, folder)


def outcomes_in_window(spark: SparkSession, judged: str, folder: str, *, window_hours: int = 24, delay: str = "1 hour") -> Ended:
    """Outcomes within the window after their unit's exposure, from the rows of ``exposure_stream``: two streams, joined on unit and interval.

    Both sides have watermarks of ``delay``, so the join's state holds what the window can still need; rows later than that are dropped, and
    their number is told apart from that of the joined ones.
    """
    session = _session(spark)
    schema = spark.read.parquet(judged).schema
    read = lambda: _source(session, judged, schema)
    exposures = read().where("event_type = 'view' and verdict = 'accepted'").select("unit_id", F.col("ts").cast("timestamp").alias("exposed_at")).withWatermark("exposed_at", delay)
    outcomes = read().where("event_type <> 'view'").select(F.col("unit_id").alias("of"), F.col("ts").cast("timestamp").alias("at"), "event_id", "event_type", "value").withWatermark("at", delay)
    inside = F.expr(f"unit_id = of and at >= exposed_at and at < exposed_at + interval {window_hours} hours")
    return _run(exposures.join(outcomes, inside).select("unit_id", "exposed_at", "event_id", "event_type", "value"), folder)


def observed(events: DataFrame, judged: DataFrame, joined: DataFrame) -> DataFrame:
    """One row for each unit, as ``experiments.observations``, of what the streams have told so far."""
    exposed = judged.where("event_type = 'view' and verdict = 'accepted'").select("unit_id").distinct().withColumn("exposed", F.lit(True))
    once = joined.dropDuplicates(["unit_id", "event_id"])
    hit = lambda kind: F.max(F.when(F.col("event_type") == kind, 1.0).otherwise(0.0))
    found = once.groupBy("unit_id").agg(hit("purchase").alias("converted"), hit("error").alias("failed"), F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("click_value"))
    units = events.select("unit_id").distinct().join(exposed, "unit_id", "left").join(found, "unit_id", "left")
    nought = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return units.select("unit_id", F.coalesce("exposed", F.lit(False)).alias("exposed"), nought("converted"), nought("failed"), "click_value")


def replayed(events: DataFrame, at: str, folder: str, step: Callable[[], Ended], slices: int = 4) -> list[Ended]:
    """Write ``events`` to ``folder`` by equal spans of time in turn, as a source would bring them, and run ``step`` after each, which goes on where it ended."""
    span = events.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    if span["lo"] is None:
        events.write.parquet(folder)
        return [step()]
    wide, ended = (span["hi"] - span["lo"]) / slices, []
    for i in range(slices):
        part = events.where(F.col(at) >= F.lit(span["lo"] + wide * i))
        part = part.where(F.col(at) < F.lit(span["lo"] + wide * (i + 1))) if i + 1 < slices else part
        part.write.mode("append").parquet(folder)
        ended.append(step())
    return ended


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
