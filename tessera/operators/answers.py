"""Exact recomputation of proposed calculations over reported facts."""

from __future__ import annotations

from decimal import Decimal, InvalidOperation, localcontext

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import identity

# Tolerances of a reported value.
ABSOLUTE = Decimal("0.01")
RELATIVE = Decimal("0.0001")

ARITY = {"identity": (1, 1), "sum": (2, None), "difference": (2, 2), "ratio": (2, 2), "percentage_change": (2, 2)}


def expected_value(operation: str, values: list[Decimal]) -> Decimal:
    """The result in 28 digits, half even; arity and zero divisors are checked before."""
    first = values[0]
    with localcontext() as context:
        context.prec = 28
        match operation:
            case "identity":
                return first
            case "sum":
                return sum(values[1:], first)
            case "difference":
                return first - values[1]
            case "ratio":
                return first / values[1]
            case "percentage_change":
                return (values[1] - first) / abs(first) * 100
    raise ValueError(operation)


def failure(operation: Column, known: Column, n: Column, units: Column, divisor_is_zero: Column) -> Column:
    """Why a calculation cannot be checked, or null: unknown facts come first, then arity, units, zero."""
    wrong = F.lit(False)
    for name, (low, high) in ARITY.items():
        short = n < low
        wrong = wrong | ((operation == name) & (short if high is None else short | (n > high)))
    return (
        F.when(~operation.isin(*ARITY), "unknown operation")
        .when(known < n, "unknown fact")
        .when(wrong, "wrong number of facts")
        .when(units > 1, "facts have different units")
        .when(divisor_is_zero, "division by zero")
    )


def validated(calculations: DataFrame, facts: DataFrame) -> DataFrame:
    """``calc_id, operation, failure, expected, passed`` for ``calculations(calc_id, operation, fact_ids, reported, reported_unit)``.

    ``facts(fact_id, value, unit)`` hold exact values as text. A calculation passes if its reported value lies
    within the larger of the two tolerances and its unit agrees (``ratio`` and ``%`` for those operations).
    Nothing raises: what cannot be computed has a failure and did not pass.
    """
    wanted = calculations.select("calc_id", F.posexplode("fact_ids").alias("place", "fact_id"))
    found = wanted.join(facts.select("fact_id", "value", "unit"), "fact_id", "left")
    by_calc = found.groupBy("calc_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("unit").alias("known"), F.count_distinct("unit").alias("units"), F.first("unit", True).alias("unit"),
        F.array_sort(F.collect_list(F.struct("place", "value"))).alias("v"),
    )
    rows = calculations.drop("fact_ids").join(by_calc, "calc_id", "left").withColumn("values", F.transform("v", lambda x: x["value"]))
    operation = F.col("operation")
    divisor = F.when(operation == "ratio", F.get("values", F.lit(1))).when(operation == "percentage_change", F.get("values", F.lit(0)))
    zero = F.coalesce(F.expr("try_cast(d as decimal(38,10))") == 0, F.lit(False))
    n = F.coalesce("n", F.lit(0))
    rows = rows.withColumn("d", divisor).withColumn("failure", failure(operation, F.coalesce("known", F.lit(0)), n, F.coalesce("units", F.lit(0)), zero))

    def compute(operations: pd.Series, values: pd.Series, failures: pd.Series) -> pd.Series:
        out = []
        for name, texts, why in zip(operations, values, failures, strict=True):
            try:
                out.append(None if isinstance(why, str) else format(expected_value(name, [Decimal(x) for x in texts]), "f"))
            except (InvalidOperation, TypeError):
                out.append(None)
        return pd.Series(out, dtype=object)

    def close(expected: pd.Series, reported: pd.Series) -> pd.Series:
        def near(a, b) -> bool:
            try:
                a, b = Decimal(a), Decimal(b)
                return bool(abs(b - a) <= max(ABSOLUTE, abs(a) * RELATIVE))
            except (InvalidOperation, TypeError):
                return False

        return pd.Series([near(a, b) for a, b in zip(expected, reported, strict=True)], dtype=bool)

    unit = F.when(operation == "ratio", "ratio").when(operation == "percentage_change", "%").otherwise(F.col("unit"))
    priced = rows.withColumn("expected", F.pandas_udf(compute, "string")("operation", "values", "failure"))
    same = F.coalesce(F.lower("reported_unit") == F.lower(unit), F.lit(False))
    passed = F.col("failure").isNull() & same & F.pandas_udf(close, "boolean")("expected", "reported")
    return priced.select("calc_id", "operation", "failure", "expected", passed.alias("passed"))


def fact_evidence(asked: DataFrame, facts: DataFrame) -> DataFrame:
    """``request_id, violated, n, fact_id, observation_key``: the facts that each request gets, latest first, numbered F1 and on.

    ``asked(request_id, cik, concepts, limit)``: without an issuer, or with a limit of 0, no facts are asked for; blank or repeated concepts (once trimmed)
    are refused (``violated``). A request without facts has one row, null from ``n`` on.
    """
    tidy = F.array_sort(F.transform("concepts", lambda x: F.trim(x)))
    sound = ~F.exists(tidy, lambda c: c == "") & (F.size(F.array_distinct(tidy)) == F.size(tidy))
    rows = asked.select("request_id", identity.normalized_cik(F.col("cik")).alias("cik"), tidy.alias("concepts"), "limit", F.when(sound, "").otherwise("concepts").alias("violated"))
    wanted = rows.where("violated = '' and cik is not null and limit > 0").select("request_id", "cik", "limit", F.explode("concepts").alias("concept"))
    held = wanted.join(facts.select("cik", "concept", "filed_date", "end_date", "observation_key"), ["cik", "concept"])
    n = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("filed_date"), F.desc("end_date"), "concept", "observation_key"))
    first = held.withColumn("n", n).where("n <= limit").select("request_id", "n", F.concat(F.lit("F"), F.col("n").cast("string")).alias("fact_id"), "observation_key")
    return rows.select("request_id", "violated").join(first, "request_id", "left")
