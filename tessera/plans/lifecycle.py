"""Queries over the planning, registration and lifecycle of experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import experiments, store
from tessera.plans import chains, registry
from tessera.plans.registry import query, sql_fixed
from tessera.plans.views import with_views
from tessera.sources.adapters import Domain
from tessera.streaming import telemetry

EFFECT = 0.05


@query(f"""select event_type, n, ceil(power({experiments.normal_quantile(0.975)} * sqrt(2 * m * (1 - m)) + {experiments.normal_quantile(0.8)} * sqrt(p * (1 - p) + c * (1 - c)), 2) / power({EFFECT}, 2))::bigint as planned
    from (select event_type, n, p, p + {EFFECT} as c, (p + p + {EFFECT}) / 2 as m from (select event_type, count(*) as n, count(*)::double / (select count(*) from events) as p from events group by event_type))""")
def power_plan(d: Domain) -> DataFrame:
    """Units an arm needs to show the effect over each event type's share."""
    events = d.raw("events")
    total = events.agg(F.count(F.lit(1)).alias("total"))
    shares = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total))
    return shares.select("event_type", "n", experiments.planned_units(F.col("n") / F.col("total"), EFFECT).alias("planned"))


@query("""select event_id, case when first_id = event_id then 'registered' when fingerprint = first_print then 'unchanged' else 'conflict' end as verdict from (
    select event_id, fingerprint, first_value(event_id) over w as first_id, first_value(fingerprint) over w as first_print
    from (select *, sha256(event_type || ':' || (value > 50)::int::varchar) as fingerprint from events) window w as (partition by user_id, event_type order by event_id))""")
def experiment_registration(d: Domain) -> DataFrame:
    """Plans delivered again under their key: unchanged by fingerprint, or a conflict with the first."""
    mark = F.sha2(F.concat_ws(":", "event_type", (F.col("value") > 50).cast("int").cast("string")), 256)
    rows = d.raw("events").withColumn("fingerprint", mark)
    return store.registrations(rows, ["user_id", "event_type"], "fingerprint", "event_id").select("event_id", "verdict")


_RANK = "case event_type when 'signup' then 0 when 'error' then 2 when 'purchase' then 3 else 1 end"


@query(with_views(f"""select event_id, case when target = state then 'unchanged' when (state = 0 and target = 1) or (state = 1 and target > 1) or (state = 2 and target = 3) then 'accepted' else 'rejected' end as verdict
    from (select event_id, target, coalesce(max(case when started then target end) over (partition by unit_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as state
    from (select *, max((target = 1)::int) over (partition by unit_id order by ts, event_id) = 1 as started from (select unit_id, ts, event_id, {_RANK} as target from user_events)))""", "user_events"))  # fmt: skip
def experiment_lifecycle(d: Domain) -> DataFrame:
    """Verdicts on wanted status changes, by what the thread's status was (event types stand for statuses)."""
    names = F.create_map(*(F.lit(x) for pair in (("signup", "draft"), ("error", "stopped"), ("purchase", "completed"), ("view", "running"), ("click", "running")) for x in pair))
    log = d.user_events().withColumn("status", names[F.col("event_type")])
    return experiments.transitions(log, thread="unit_id", order=["ts", "event_id"], status="status").select("event_id", "verdict")


@query(with_views("""select event_id, case when exposed_at is null or ts < exposed_at then 'before_exposure' when event_type = 'view' and ts > exposed_at then 'repeated_exposure'
    when event_type = 'purchase' and n > 1 then 'repeated_outcome' else 'accepted' end as verdict from (
    select *, row_number() over (partition by unit_id, event_type, coalesce(ts >= exposed_at, false) order by ts, event_id) as n from user_events join (select unit_id, min(case when event_type = 'view' then ts end) as exposed_at from user_events group by unit_id) using (unit_id))""", "user_events"))
def event_acceptance_stream(d: Domain) -> DataFrame:
    """The acceptance of events by keyed state, in four runs of a stream over what has arrived by then."""
    return _judged(d)[0].select("event_id", "verdict")


def _judged(d: Domain) -> tuple[DataFrame, str]:
    base, events = telemetry.new_folder(d.spark), d.user_events()
    telemetry.replayed(events, "ts", f"{base}/in", lambda: telemetry.exposure_stream(d.spark, f"{base}/in", events.schema, f"{base}/judged"))
    return d.spark.read.parquet(f"{base}/judged/rows"), base


@query(chains.EVENT_INGEST_SQL)
def event_ingest_stream(d: Domain) -> DataFrame:
    """The verdicts of ``event_ingest`` from a stream with keyed state, in four runs over what has arrived by then."""
    base, sent = telemetry.new_folder(d.spark), chains.sent_events(d)
    arrival = F.struct("occurred_at", "event_id", "delivery")
    step = lambda: telemetry.accept_stream(d.spark, f"{base}/in", sent.schema, registry.METRICS, f"{base}/judged", arrival=arrival, closes_after_days=400)
    telemetry.replayed(sent, "occurred_at", f"{base}/in", step)
    return d.spark.read.parquet(f"{base}/judged/rows").select("arrival.event_id", "arrival.delivery", "verdict")


@query(with_views(f"select unit_id, exposed, converted, failed, {sql_fixed('click_value')} as click_value from observed", "observed"))
def experiment_observations_stream(d: Domain) -> DataFrame:
    """The rows of ``experiment_observations`` from streams: exposures by keyed state, outcomes joined to them within a day."""
    judged, base = _judged(d)
    telemetry.outcomes_in_window(d.spark, f"{base}/judged/rows", f"{base}/joined")
    found = telemetry.observed(d.user_events(), judged, d.spark.read.parquet(f"{base}/joined/rows"))
    return found.select("unit_id", "exposed", "converted", "failed", registry.fixed(F.col("click_value")).alias("click_value"))
