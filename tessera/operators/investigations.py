"""Whole answers: drafts checked against their evidence, rendered, with limitations and reasons for review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The sentences of an answer that no draft writes.
NOTHING = "The available SEC evidence is insufficient to produce a grounded answer."
NO_PASSAGES = "No filing passages matched the bounded retrieval request."
REVIEW = "financial analysis requires qualified human review"
NO_EVIDENCE = "insufficient retrieved evidence"
FAILED = "one or more generated calculations failed deterministic validation"
NO_CLAIMS = "generation produced no supported claims"


def investigate(cases: DataFrame, passages: DataFrame, facts: DataFrame, claims: DataFrame, calculations: DataFrame, limitations: DataFrame) -> DataFrame:
    """``case_id, status, answer, limitations, review_reasons, requires_human_review, unknown_evidence``: one row for each case.

    ``cases`` has ``case_id``; ``passages`` and ``facts`` count as E1, E2, ... and F1, F2, ... by ``(case_id, n)``; ``claims`` has ``(case_id, place,
    statement, ids)``, ``calculations`` ``(case_id, place, statement, ids, passed, message)``, ``limitations`` ``(case_id, place, text)``.

    A case without passages ends there: its draft and facts are not looked at. A claim that cites what the case does not have makes
    the draft ``rejected``, with those ids and no answer. Else a failed calculation needs review; nothing to state is
    insufficient evidence; all other answers are grounded. Parts of a case are gathered in one row, as one request bounds them.
    """
    held = lambda df, name, *columns: df.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("place", *columns))).alias(name))
    known = lambda df, letter: df.groupBy("case_id").agg(F.max("n").alias(letter))
    rows = cases.select("case_id")
    for part in (
        known(passages, "e"), known(facts, "f"), held(claims, "claims", "statement", "ids"),
        held(calculations, "sums", "statement", "ids", "passed", "message"), held(limitations, "limits", "text"),
    ):
        rows = rows.join(part, "case_id", "left")
    rows = rows.withColumn("found", F.coalesce(F.col("e") > 0, F.lit(False)))
    for name, kind in (("claims", "struct<place: int, statement: string, ids: array<string>>"), ("sums", "struct<place: int, statement: string, ids: array<string>, passed: boolean, message: string>"), ("limits", "struct<place: int, text: string>")):
        rows = rows.withColumn(name, F.when(F.col("found") & F.col(name).isNotNull(), F.col(name).cast(f"array<{kind}>")).otherwise(F.array().cast(f"array<{kind}>")))
    number = lambda x: F.substring(x, 2, 9).try_cast("int")
    most = lambda x: F.when(F.startswith(x, F.lit("E")), F.col("e")).when(F.startswith(x, F.lit("F")), F.col("f"))
    cited = F.flatten(F.transform("claims", lambda c: c["ids"]))
    unknown = F.filter(cited, lambda x: ~F.coalesce(number(x).between(1, most(x)), F.lit(False)))
    good, bad = F.filter("sums", lambda s: s["passed"]), F.filter("sums", lambda s: ~s["passed"])
    rows = rows.select("case_id", "found", "claims", "limits", unknown.alias("unknown_evidence"), good.alias("good"), bad.alias("bad"))
    silent = (F.size("claims") == 0) & (F.size("good") == 0)
    rejected, failed = F.size("unknown_evidence") > 0, F.size("bad") > 0
    status = F.when(rejected, "rejected").when(failed, "needs_review").when(silent, "insufficient_evidence").otherwise("grounded")
    sentence = lambda x: F.concat(x["statement"], F.lit(" "), F.array_join(F.transform(x["ids"], lambda i: F.concat(F.lit("["), i, F.lit("]"))), " "))
    text = F.array_join(F.concat(F.transform("claims", sentence), F.transform("good", sentence)), "\n\n")
    limits = F.when(~F.col("found"), F.array(F.lit(NO_PASSAGES))).otherwise(
        F.array_distinct(F.concat(F.transform("limits", lambda x: x["text"]), F.transform("bad", lambda x: x["message"])))
    )
    reasons = F.array_compact(F.array(
        F.lit(REVIEW), F.when(~F.col("found"), NO_EVIDENCE), F.when(failed, FAILED), F.when(F.col("found") & silent, NO_CLAIMS)
    ))
    return rows.select(
        "case_id", status.alias("status"), F.when(~rejected, F.when(silent, NOTHING).otherwise(text)).alias("answer"), limits.alias("limitations"),
        reasons.alias("review_reasons"), F.lit(True).alias("requires_human_review"), "unknown_evidence",
    )


def claim_metrics(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """``case_id, citations, citation_validity, citation_precision, citation_coverage, faithfulness``; what has no support is null.

    ``claims`` has ``case_id, ids, supported`` (null while unjudged) and ``sources`` ``id, relevant``, the available ones once each.
    Citations count by occurrence: valid are those of available sources, precise those of relevant ones; covered is a claim with a
    citation; faithful are the supported ones of the judged claims.
    """
    of_claim = claims.groupBy("case_id").agg(
        F.avg((F.size("ids") > 0).cast("int")).alias("citation_coverage"), F.avg(F.col("supported").cast("int")).alias("faithfulness")
    )
    cited = claims.select("case_id", F.explode("ids").alias("id")).join(sources, "id", "left")
    of_citation = cited.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("citations"), F.avg(F.col("relevant").isNotNull().cast("int")).alias("citation_validity"),
        F.avg(F.coalesce("relevant", F.lit(False)).cast("int")).alias("citation_precision"),
    )
    both = of_claim.join(of_citation, "case_id", "left")
    return both.select("case_id", F.coalesce("citations", F.lit(0)).alias("citations"), "citation_validity", "citation_precision", "citation_coverage", "faithfulness")


def thread_verdicts(log: DataFrame, *, thread: str, order: list[str], command: str) -> DataFrame:
    """``log`` with a ``verdict`` on each command of a thread: started, resumed, shown, ``not_found`` or ``conflict``.

    A thread is there from its first start on, and its review is pending until the first resume after that.
    """
    rank = F.struct(*order)
    first = log.where(F.col(command) == "start").groupBy(thread).agg(F.min(rank).alias("_began"))
    begun = log.join(first, thread, "left").withColumn("_at", rank).withColumn("_there", F.coalesce(F.col("_at") > F.col("_began"), F.lit(False)))
    done = begun.where((F.col(command) == "resume") & F.col("_there")).groupBy(thread).agg(F.min("_at").alias("_ended"))
    c = F.col(command)
    verdict = (
        F.when(c == "start", F.when(F.col("_at") == F.col("_began"), "started").otherwise("conflict"))
        .when(~F.col("_there"), "not_found").when(c == "resume", F.when(F.col("_at") == F.col("_ended"), "resumed").otherwise("conflict")).otherwise("shown")
    )
    return begun.join(done, thread, "left").select(*log.columns, verdict.alias("verdict"))
