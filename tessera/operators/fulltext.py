"""English full-text search: stems with positions, structured queries, cover-density rank."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.english import STOP_WORDS, lexeme

#: Weight of an occurrence in plain text.
WEIGHT = 0.1
_WORD = r"[\p{L}\p{N}]+"
_EVENT = "array<struct<last: int, first: int, term: int, stems: int>>"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({_WORD})"), F.lit(1))


def _lexemes(words: pd.Series) -> pd.Series:
    return words.map(lexeme, na_action="ignore")


def postings(df: DataFrame, *, id_col: str, text: str, stems: Sequence[str] | None = None, english: bool = True) -> DataFrame:
    """``id_col, lexeme, positions``: the stems of each text with their word positions from 1; all, or those of ``stems``.

    Stop words are left out but count for positions, which have no bound. A null or empty text has no rows. Distinct words are
    stemmed once and joined; with ``stems``, only those that can have one of them (a stem starts as its word does). Without
    ``english``, every word is kept as it is, in lower case.
    """
    placed = df.select(id_col, F.posexplode(words(F.col(text))).alias("at", "word"))
    if english:
        placed = placed.where(~F.col("word").isin(sorted(STOP_WORDS)))
        if stems is not None:
            placed = placed.where(F.substring("word", 1, 1).isin(sorted({s[0] for s in stems})))
        known = placed.select("word").distinct().withColumn("lexeme", F.pandas_udf(_lexemes, "string")("word")).where("lexeme is not null")
        if stems is not None:
            known = known.where(F.col("lexeme").isin(sorted(stems)))
        useful = placed.join(known, "word")
    else:
        useful = placed.withColumnRenamed("word", "lexeme")
        useful = useful if stems is None else useful.where(F.col("lexeme").isin(sorted(stems)))
    return useful.groupBy(id_col, "lexeme").agg(F.array_sort(F.collect_list(F.col("at") + 1)).alias("positions"))


@dataclass(frozen=True)
class Term:
    """Stems at stated distances from the first; one stem alone, or a phrase. A negated one must not occur."""

    stems: tuple[str, ...]
    offsets: tuple[int, ...] = (0,)
    negated: bool = False


def term(words: str, *, negated: bool = False) -> Term | None:
    """A word, or several as a phrase; stop words vanish but count for the distance, and nothing else is no term."""
    found = [(i, s) for i, s in enumerate(map(lexeme, re.findall(r"[^\W_]+", words.lower()))) if s]
    return Term(tuple(s for _, s in found), tuple(i - found[0][0] for i, _ in found), negated) if found else None


def _rank(events: Column, alternatives: list[tuple[Column, list[int]]], n_terms: int) -> Column:
    """The cover density of ``events``, occurrences of terms by their last position.

    A minimal cover is a shortest stretch in which an alternative (whether it counts, its terms) holds; it counts by
    the words in it that are no terms.
    """

    def step(s: Column, x: Column) -> Column:
        latest = F.transform(s["latest"], lambda at, i: F.when(i == x["term"], s["at"]).otherwise(at))
        ready = [F.when(holds, F.array_min(F.array(*(F.get(latest, i) for i in terms)))).otherwise(F.lit(-1)) for holds, terms in alternatives]
        start = F.array_max(F.array(F.lit(-1), *ready))
        inside = F.slice(events, start + 1, s["at"] - start + 1)
        stretch = x["last"] - F.array_min(F.transform(inside, lambda e: e["first"]))
        stems = F.aggregate(inside, F.lit(0), lambda n, e: n + e["stems"])
        gain = F.when(start > s["begun"], WEIGHT / (1 + F.greatest(stretch - (stems - 1), F.lit(0)))).otherwise(F.lit(0.0))
        return F.struct(latest.alias("latest"), F.greatest(start, s["begun"]).alias("begun"), (s["at"] + 1).alias("at"), (s["rank"] + gain).alias("rank"))

    begin = F.struct(F.array_repeat(F.lit(-1), n_terms).alias("latest"), F.lit(-1).alias("begun"), F.lit(0).alias("at"), F.lit(0.0).alias("rank"))
    return F.aggregate(events, begin, step, lambda s: s["rank"])


def fulltext_scores(df: DataFrame, query: Sequence[Sequence[Term | None]], *, id_col: str, text: str) -> DataFrame:
    """``scores_of`` the texts of ``df``, without an index: every text is read, and the postings of the query's stems are made."""
    stems = sorted({s for terms in query for t in terms if t for s in t.stems})
    if not stems:
        return df.select(id_col, F.lit(0.0).alias("score")).where("false")
    return scores_of(postings(df, id_col=id_col, text=text, stems=stems), query, id_col=id_col, every=df.where(F.col(text).isNotNull()).select(id_col))


def scores_of(found: DataFrame, query: Sequence[Sequence[Term | None]], *, id_col: str, every: DataFrame | None = None) -> DataFrame:
    """``id_col, score`` of the texts in which an alternative of ``query`` holds: all its terms occur, and none of the negated ones.

    ``found(id_col, lexeme, positions)`` holds the postings of the query's stems, gathered by ``id_col``, which names a text. The rank is the cover
    density of the alternatives that hold; negated terms decide the match and take no part in it. A query without terms matches none,
    one of negated terms alone has rank 0 and needs ``every`` id; a null text never matches.
    """
    plan = [kept for terms in query if (kept := [t for t in terms if t])]
    if not plan:
        return found.select(id_col, F.lit(0.0).alias("score")).where("false")
    terms = sorted({(t.stems, t.offsets) for alternative in plan for t in alternative})
    index = {t: i for i, t in enumerate(terms)}
    found = found.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("lexeme", "positions"))).alias("_at"))
    if any(all(t.negated for t in alternative) for alternative in plan):
        found = every.join(found, id_col, "left")
    at = lambda stem: F.coalesce(F.try_element_at("_at", F.lit(stem)), F.array().cast("array<int>"))

    def spans(names: tuple[str, ...], offsets: tuple[int, ...]) -> Column:
        follows = lambda p: reduce(and_, (F.array_contains(at(s), p + o) for s, o in zip(names[1:], offsets[1:], strict=True)), F.lit(True))
        return F.filter(at(names[0]), follows)

    placed = found.select(id_col, *(spans(*t).alias(f"_s{i}") for i, t in enumerate(terms)))
    occurs = [F.size(f"_s{i}") > 0 for i in range(len(terms))]
    number = lambda t: index[t.stems, t.offsets]
    holds = [reduce(and_, (~occurs[number(t)] if t.negated else occurs[number(t)] for t in alternative)) for alternative in plan]
    wanted = [[number(t) for t in alternative if not t.negated] for alternative in plan]
    events = [
        F.when(reduce(or_, (h for h, mine in zip(holds, wanted, strict=True) if i in mine), F.lit(False)), F.transform(
            f"_s{i}", lambda p: F.struct((p + offsets[-1]).alias("last"), p.alias("first"), F.lit(i).alias("term"), F.lit(len(names)).alias("stems"))  # noqa: B023
        )).otherwise(F.array().cast(_EVENT))
        for i, (names, offsets) in enumerate(terms)
    ]
    matched = placed.where(reduce(or_, holds)).select(id_col, *(h.alias(f"_h{i}") for i, h in enumerate(holds)), F.array_sort(F.flatten(F.array(*events))).alias("_events"))
    ranked = [(F.col(f"_h{i}"), mine) for i, mine in enumerate(wanted) if mine]
    return matched.select(id_col, _rank(F.col("_events"), ranked, len(terms)).alias("score"))
