"""Controlled experiments: assignment, telemetry, arm summaries, readiness and decisions."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Statuses of an experiment in order, and the changes that are allowed.
STATUSES = ("draft", "running", "stopped", "completed")
CHANGES = (("draft", "running"), ("running", "stopped"), ("running", "completed"), ("stopped", "completed"))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def sample_size(baseline: float, effect: float, confidence: float = 0.95, power: float = 0.8) -> int:
    """Units that each of two arms needs to show ``effect`` over the rate ``baseline``."""
    z = NormalDist().inv_cdf
    a, b, changed = z(1 - (1 - confidence) / 2), z(power), baseline + effect
    mean = (baseline + changed) / 2
    root = a * math.sqrt(2 * mean * (1 - mean)) + b * math.sqrt(baseline * (1 - baseline) + changed * (1 - changed))
    return math.ceil(root**2 / effect**2)


def planned_units(baseline: Column, effect: float, confidence: float = 0.95, power: float = 0.8) -> Column:
    """As ``sample_size``, for a column of rates; null where a rate does not lie between 0 and 1."""
    changed = baseline + effect
    mean = (baseline + changed) / 2
    root = normal_quantile(1 - (1 - confidence) / 2) * F.sqrt(2 * mean * (1 - mean)) + normal_quantile(power) * F.sqrt(baseline * (1 - baseline) + changed * (1 - changed))
    return F.when((baseline > 0) & (changed < 1), F.ceil(F.pow(root, 2) / F.pow(F.lit(effect), 2)).cast("long"))


def transitions(log: DataFrame, *, thread: str, order: list[str], status: str) -> DataFrame:
    """``log`` with a ``verdict`` on each wanted status: accepted, unchanged, or rejected.

    Every thread starts as a draft, and a rejected change leaves the status as it is. Statuses only move
    forward, so the status before a row is the furthest one wanted since the thread first ran.
    """
    before = Window.partitionBy(thread).orderBy(*order)
    rank = F.array_position(F.array(*(F.lit(x) for x in STATUSES)), F.col(status)) - 1
    rows = log.withColumn("_rank", rank).withColumn("_ran", F.max(F.col("_rank") == 1).over(before))
    state = F.coalesce(F.max(F.when(F.col("_ran"), F.col("_rank"))).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_state", state)
    allowed = F.lit(False)
    for a, b in CHANGES:
        allowed = allowed | ((F.col("_state") == STATUSES.index(a)) & (F.col("_rank") == STATUSES.index(b)))
    verdict = F.when(F.col("_rank") == F.col("_state"), "unchanged").when(allowed, "accepted").otherwise("rejected")
    return rows.select(*log.columns, verdict.alias("verdict"))


def variant(bucket: Column, arms: list[tuple[str, int]]) -> Column:
    """The arm whose cumulative basis points first exceed the bucket."""
    chosen, total = None, 0
    for name, points in arms:
        total += points
        chosen = F.when(bucket < total, name) if chosen is None else chosen.when(bucket < total, name)
    return chosen


def sticky(units: DataFrame, existing: DataFrame, fresh: Column) -> DataFrame:
    """Units with their arm; an assignment that exists wins over the fresh one."""
    old = existing.select("unit_hash", F.col("variant").alias("_old"))
    return units.join(old, "unit_hash", "left").withColumn("variant", F.coalesce("_old", fresh)).drop("_old")


def observations(events: DataFrame, window_hours: int = 24) -> DataFrame:
    """One row for each unit: first exposure, and the outcomes within the window after it."""
    first = events.groupBy("unit_id").agg(F.min(F.when(F.col("event_type") == "view", F.col("ts"))).alias("exposed_at"))
    joined = events.join(first, "unit_id")
    inside = (F.col("ts") >= F.col("exposed_at")) & (F.col("ts") < F.col("exposed_at") + F.expr(f"interval {window_hours} hours"))
    hit = lambda kind: F.max(F.when(inside & (F.col("event_type") == kind), 1.0).otherwise(0.0))
    return joined.groupBy("unit_id").agg(
        F.max(F.col("exposed_at").isNotNull()).alias("exposed"),
        hit("purchase").alias("converted"),
        hit("error").alias("failed"),
        F.avg(F.when(inside & (F.col("event_type") == "click"), F.col("value"))).alias("click_value"),
    )


def arm_summary(rows: DataFrame, metrics: dict[str, str], confidence: float = 0.95) -> DataFrame:
    """``variant, metric, n, mean, low, high``: Wilson intervals for binary metrics, normal ones otherwise."""
    z = NormalDist().inv_cdf(1 - (1 - confidence) / 2)
    long = rows.where("exposed").unpivot(["variant"], list(metrics), "metric", "value").where("value is not null")
    base = long.groupBy("variant", "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"))
    n, p = F.col("n"), F.col("mean")
    binary = F.col("metric").isin([m for m, kind in metrics.items() if kind == "binary"])
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    plain = z * F.col("sd") / F.sqrt(n)
    single = n == 1
    low = F.when(binary, F.greatest(F.lit(0.0), centre - spread)).otherwise(F.when(single, p).otherwise(p - plain))
    high = F.when(binary, F.least(F.lit(1.0), centre + spread)).otherwise(F.when(single, p).otherwise(p + plain))
    return base.select("variant", "metric", "n", "mean", "sd", low.alias("low"), high.alias("high"))


def compared(summary: DataFrame, metrics: dict[str, str], control: str, treatment: str, confidence: float = 0.95) -> DataFrame:
    """Per metric: difference, unpooled Wald interval, and two-sided p value."""
    z = NormalDist().inv_cdf(1 - (1 - confidence) / 2)
    binary = F.col("metric").isin([m for m, kind in metrics.items() if kind == "binary"])
    square = F.when(binary, F.col("mean") * (1 - F.col("mean"))).otherwise(F.col("sd") * F.col("sd")) / F.col("n")
    arms = summary.withColumn("v", square)
    c = arms.where(F.col("variant") == control).select("metric", F.col("mean").alias("control_mean"), F.col("v").alias("cv"))
    t = arms.where(F.col("variant") == treatment).select("metric", F.col("mean").alias("treatment_mean"), F.col("v").alias("tv"))
    both = c.join(t, "metric").select("metric", "control_mean", "treatment_mean", (F.col("treatment_mean") - F.col("control_mean")).alias("delta"), F.sqrt(F.col("cv") + F.col("tv")).alias("se"))

    def p_value(delta: pd.Series, se: pd.Series) -> pd.Series:
        return pd.Series([math.erfc(abs(d / s) / math.sqrt(2)) if s else float(d == 0) for d, s in zip(delta, se, strict=True)])

    return both.select("metric", "control_mean", "treatment_mean", "delta", (F.col("delta") - z * F.col("se")).alias("low"), (F.col("delta") + z * F.col("se")).alias("high"), F.pandas_udf(p_value, "double")("delta", "se").alias("p_value"))


def decision(compared_rows: DataFrame, arms: DataFrame, *, planned: int, primary: str, effect: float, guardrails: dict[str, float]) -> DataFrame:
    """One row, ``decision, delta``: nothing is told (``collecting``, null) until every arm has its planned units.

    ``arms(variant, n)`` counts the exposed units that have the primary outcome. A guardrail whose degradation exceeds its
    limit halts; then a practical effect with an interval above 0 ships, one below 0 keeps the
    control, and all else is inconclusive.
    """
    ready = arms.agg((F.coalesce(F.min("n"), F.lit(0)) >= planned).alias("enough"), (F.count(F.lit(1)) == 2).alias("both"))
    of = lambda column: F.max(F.when(F.col("metric") == primary, F.col(column)))
    worse = F.lit(False)
    for name, limit in guardrails.items():
        worse = worse | ((F.col("metric") == name) & (F.col("delta") > limit))
    row = compared_rows.agg(of("delta").alias("d"), of("low").alias("low"), of("high").alias("high"), F.coalesce(F.max(worse), F.lit(False)).alias("halt"))
    told = F.col("enough") & F.col("both")
    choice = (
        F.when(~told, "collecting").when(F.col("halt"), "halt").when((F.col("d") >= effect) & (F.col("low") > 0), "ship")
        .when(F.col("high") < 0, "keep_control").otherwise("inconclusive")
    )
    return row.crossJoin(F.broadcast(ready)).select(choice.alias("decision"), F.when(told, F.col("d")).alias("delta"))


def assignment_requests(requests: DataFrame, *, unit: str, at: str, order: list[str], starts, ends, status: Column) -> DataFrame:
    """``requests`` with a ``verdict``: ``assigned`` (a unit's first one that is accepted), ``existing``, or why it is not accepted.

    Requests count only while the experiment is running and in ``[starts, ends)``, also those of units that are assigned already.
    """
    verdict = F.when(status != "running", "not_running").when(F.col(at) < starts, "before_start").when(F.col(at) >= ends, "after_end")
    rows = requests.withColumn("_why", verdict).withColumn("_at", F.struct(*order))
    first = rows.where("_why is null").groupBy(unit).agg(F.min("_at").alias("_first"))
    named = F.coalesce("_why", F.when(F.col("_at") == F.col("_first"), "assigned").otherwise("existing"))
    return rows.join(first, unit, "left").select(*requests.columns, named.alias("verdict"))


def event_faults(kinds: dict[str, str]) -> Column:
    """Why an event is unsound whatever came before it, or null: it precedes its assignment, or its metric is not registered, or not binary though it must be."""
    outcome = F.col("event_type") != "exposure"
    kind = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))[F.col("metric_name")]
    return (
        F.when(F.col("occurred_at") < F.col("assigned_at"), "before_assignment")
        .when(outcome & kind.isNull(), "unknown_metric").when(outcome & (kind == "binary") & ~F.col("metric_value").isin(0.0, 1.0), "not_binary")
    )


def event_body(events: DataFrame) -> Column:
    """A digest of all that makes two events of one key the same event; ``metadata``, a map, counts if there is such a column."""
    more = [F.to_json(F.array_sort(F.map_entries("metadata")))] if "metadata" in events.columns else []
    text = lambda c: F.coalesce(c.cast("string"), F.lit("\x00"))
    parts = [*(text(F.col(c)) for c in ("event_type", "metric_name", "metric_value", "occurred_at")), *map(text, more)]
    return F.sha2(F.concat_ws("\x01", *parts), 256)


def accepted_events(events: DataFrame, kinds: dict[str, str], *, order: list[str]) -> DataFrame:
    """``events`` with a ``verdict`` on each, in the order of their arrival within an assignment.

    ``events`` has ``assignment_id, assigned_at, event_key, event_type`` (exposure or outcome), ``metric_name, metric_value, occurred_at`` and
    perhaps ``metadata`` (a map). An event key that was accepted before is a ``duplicate`` if all of its event is the same, else a ``conflict``. Then an
    event must not precede its assignment, an outcome needs a registered metric (``kinds`` by name), 0 or 1 if that is binary, an accepted
    exposure before it and none of its metric before; one exposure counts. An event that is refused leaves its key and its metric free.

    What is accepted is settled in order from few candidates: an assignment's first sound exposure, and of each metric the first sound event after it
    for each key, of which as many keys as there are metrics are enough, since each other metric takes one key at most. So an
    assignment may hold any share of all events: minima are taken before the exchange, and the fold runs over a bounded list.
    """
    exposure = F.col("event_type") == "exposure"
    rows = events.withColumns({"_at": F.struct(*order), "_wrong": event_faults(kinds), "_body": event_body(events)})
    first = rows.where(exposure & F.col("_wrong").isNull()).groupBy("assignment_id").agg(
        F.min("_at").alias("_seen"), F.min_by(F.struct(F.col("event_key").alias("key"), F.col("_body").alias("body")), "_at").alias("_exposure")
    )
    rows = rows.join(first, "assignment_id", "left")
    after = F.coalesce(F.col("_at") > F.col("_seen"), F.lit(False))
    able = rows.where(~exposure & F.col("_wrong").isNull() & after & (F.col("event_key") != F.col("_exposure.key")))
    each = able.groupBy("assignment_id", "metric_name", "event_key").agg(F.min("_at").alias("at"), F.min_by("_body", "_at").alias("body"))
    place = F.row_number().over(Window.partitionBy("assignment_id", "metric_name").orderBy("at"))
    few = each.withColumn("_place", place).where(F.col("_place") <= len(kinds))
    candidates = few.groupBy("assignment_id").agg(F.array_sort(F.collect_list(F.struct("at", F.col("metric_name").alias("metric"), F.col("event_key").alias("key"), "body"))).alias("c"))
    clash = lambda taken, x: F.exists(taken, lambda t: (t["metric"] == x["metric"]) | (t["key"] == x["key"]))
    taken = F.aggregate("c", F.slice("c", 1, 0), lambda taken, x: F.when(clash(taken, x), taken).otherwise(F.array_append(taken, x)))
    outcomes = candidates.select("assignment_id", F.explode(taken).alias("t")).select("assignment_id", F.col("t.key").alias("event_key"), F.col("t.at").alias("_key_at"), F.col("t.body").alias("_key_body"))
    keys = outcomes.unionByName(first.select("assignment_id", F.col("_exposure.key").alias("event_key"), F.col("_seen").alias("_key_at"), F.col("_exposure.body").alias("_key_body")))
    late = F.coalesce(F.col("_at") > F.col("_key_at"), F.lit(False))
    verdict = (
        F.when(late, F.when(F.col("_body") == F.col("_key_body"), "duplicate").otherwise("conflict"))
        .when(F.col("_wrong").isNotNull(), F.col("_wrong")).when(F.coalesce(F.col("_at") == F.col("_key_at"), F.lit(False)), "accepted")
        .when(exposure, "repeated_exposure").when(~after, "before_exposure").otherwise("repeated_outcome")
    )
    return rows.join(keys, ["assignment_id", "event_key"], "left").select(*events.columns, verdict.alias("verdict"))


def effects(rows: DataFrame, directions: dict[str, str], least: dict[str, float], most: dict[str, float]) -> DataFrame:
    """``metric, direction, gain, practical, breached``: differences in the direction that is better, against the plan.

    ``gain`` is the difference, turned round where lower is better; a practical effect is at least ``least``, and a guardrail
    is breached by a loss of more than ``most``. Metrics without such a bound have null there.
    """
    literal = lambda values: F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[F.col("metric")]
    lower = literal(directions) == "lower_is_better"
    gain = F.when(lower, -F.col("delta")).otherwise(F.col("delta"))
    return rows.select("metric", literal(directions).alias("direction"), gain.alias("gain"), (gain >= literal(least)).alias("practical"), (-gain > literal(most)).alias("breached"))
