"""Snapshot operators: upsert, insert-if-absent, optimistic updates and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Fields of a filing that a later delivery must not change.
FILING_FIELDS = ["cik", "form_type", "filing_date", "report_date", "primary_document", "source_url", "content_hash"]


def upsert(existing: DataFrame, incoming: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """All keys of both; an incoming row replaces the attributes of an existing one."""
    both = existing.alias("e").join(incoming.withColumn("_new", F.lit(True)).alias("i"), key, "full_outer")
    new = F.col("_new").isNotNull()
    return both.select(key, *(F.when(new, F.col(f"i.{a}")).otherwise(F.col(f"e.{a}")).alias(a) for a in attributes))


def first_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row for each key: the first in ``order``, whatever the partitioning."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return rows.withColumn("_n", place).where("_n = 1").drop("_n")


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    return incoming.join(existing.select(*key), key, "left_anti")


def registrations(rows: DataFrame, key: list[str], fingerprint: str, order: str) -> DataFrame:
    """``rows`` with a ``verdict``: the first of a key registers it; later ones are unchanged, or conflict in fingerprint.

    Firsts are minima, so a key may hold any share of the rows. Null keys are one key.
    """
    first = rows.groupBy(*(F.col(k).alias(f"_{k}") for k in key)).agg(F.min(F.struct(order, fingerprint)).alias("_first"))
    same = [rows[k].eqNullSafe(first[f"_{k}"]) for k in key]
    verdict = F.when(F.col(order).eqNullSafe(F.col("_first")[order]), "registered").when(F.col(fingerprint).eqNullSafe(F.col("_first")[fingerprint]), "unchanged").otherwise("conflict")
    return rows.join(first, same).select(*rows.columns, verdict.alias("verdict"))


def identity_conflicts(existing: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys that both have with different immutable fields, and those fields in the stated order."""
    both = existing.alias("e").join(incoming.alias("i"), key)
    names = F.array_compact(F.array(*(F.when(~F.col(f"e.{f}").eqNullSafe(F.col(f"i.{f}")), F.lit(f)) for f in fields)))
    return both.select(key, names.alias("names")).where(F.size("names") > 0).select(key, F.array_join("names", ",").alias("fields"))


def optimistic_update(target: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``target`` with ``columns`` replaced where an update has the same keys; ``updated`` says where."""
    hit = updates.withColumn("_hit", F.lit(True)).alias("u")
    joined = target.alias("t").join(hit, keys, "left")
    new = F.coalesce(F.col("_hit"), F.lit(False))
    kept = [c for c in target.columns if c not in columns and c not in keys]
    return joined.select(*keys, *(F.col(f"t.{c}") for c in kept), *(F.when(new, F.col(f"u.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in columns), new.alias("updated"))


def checked_updates(sent: DataFrame, *, batch: str, key: str, fault: Column) -> DataFrame:
    """``sent`` with the ``fault`` of each update (``repeated`` where its batch names the key twice, else what ``fault`` says) and whether its batch is ``refused``: one fault is enough."""
    times = sent.groupBy(batch, key).agg((F.count(F.lit(1)) > 1).alias("_twice"))
    judged = sent.join(times, [batch, key]).withColumn("fault", F.when(F.col("_twice"), "repeated").otherwise(fault)).drop("_twice")
    return judged.join(judged.groupBy(batch).agg((F.count("fault") > 0).alias("refused")), batch)


def applied(target: DataFrame, judged: DataFrame, keys: list[str]) -> DataFrame:
    """``judged`` updates with a ``verdict``: ``refused``, ``updated`` where ``target`` has the same keys, else ``stale``."""
    hit = target.select(*keys).distinct().withColumn("_hit", F.lit(True))
    verdict = F.when(F.col("refused"), "refused").when(F.col("_hit"), "updated").otherwise("stale")
    return judged.join(hit, keys, "left").withColumn("verdict", verdict).drop("_hit")


def violations(rules: dict) -> Column:
    """Names of the violated rules, in the stated order, joined by commas; a null verdict is a violation."""
    return F.array_join(F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()))), ",")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
