"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import col, free_name, hash_sample, map_arrow, only_columns

_PIECE = 1 << 21  #: letters of the texts whose n-grams a task holds at a time
_BITS = 21  #: of a code point; three letters fit a 64-bit code


@dataclass(frozen=True)
class Profiles:
    """Ranked n-grams of each language."""

    languages: tuple[str, ...]
    ranks: tuple[np.ndarray, ...]  #: for each language, its n-gram codes, most frequent first


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point itself if it is a letter or a mark on one (vowel signs of many scripts), else 0, the gap between words; and whether it is a letter."""
    kinds = [unicodedata.category(chr(p))[0] for p in range(0x110000)]
    return np.fromiter((p if k in "LM" else 0 for p, k in enumerate(kinds)), "int32", 0x110000), np.fromiter((k == "L" for k in kinds), "bool", 0x110000)


def _codes(text: str) -> np.ndarray:
    """Letters and their marks with one gap before each word and after the last; empty if there is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    parts, letters = _letters()
    if not letters[points].any():
        return np.zeros(0, "int32")
    ids = np.concatenate(([0], parts[points], [0])).astype("int32")
    keep = (ids != 0) | np.concatenate(([True], ids[:-1] != 0))
    return ids[keep]


def _grams(ids: np.ndarray) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams that lie in one word or touch one gap at an end.

    Letters stand in 21 bits each from the right, above 0; a gap in front would vanish there, so it has a
    number beyond all code points.
    """
    gap = np.int64(0x1FFFFF)
    wide = np.where(ids == 0, gap, ids).astype("int64")
    one = wide[ids != 0]
    two = wide[:-1] << _BITS | wide[1:]
    three = (wide[:-2] << 2 * _BITS | wide[1:-1] << _BITS | wide[2:])[ids[1:-1] != 0]
    return np.concatenate([one, two, three])


def counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams, sorted, and how often each occurs; a long text is counted in pieces."""
    codes, counts = np.zeros(0, "int64"), np.zeros(0, "int64")
    for at in range(0, max(1, len(ids) - 2), _PIECE):
        piece = ids[at : at + _PIECE + 2]
        found, times = np.unique(_grams(piece), return_counts=True)
        if at + _PIECE < len(ids) - 2:  # the next piece begins with the last two letters again
            again, less = np.unique(_grams(piece[-2:]), return_counts=True)
            times[np.searchsorted(found, again)] -= less
        if len(codes):
            found, back = np.unique(np.concatenate((codes, found)), return_inverse=True)
            times = np.bincount(back, np.concatenate((counts, times))).astype("int64")
        codes, counts = found, times
    some = counts > 0
    return codes[some], counts[some]


def _top(ids: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, ties to the smaller code."""
    codes, counts = counted(ids)
    return codes[np.lexsort((codes, -counts))[:size]]


def learn(labelled: DataFrame, size: int) -> Profiles:
    """Profiles from ``labelled(lang, text)``: each language's ``size`` most frequent n-grams, ties to the smaller code.

    N-grams are counted in tasks and added up by language; only the ranked ones reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                codes, times = counted(_codes(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(codes), pa.string()), pa.array(codes), pa.array(times)], names=["lang", "code", "n"])

    sums = labelled.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    ranked = sums.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size)
    found: dict[str, list[tuple[int, int]]] = {}
    for row in ranked.select("lang", "rank", "code").collect():
        found.setdefault(row["lang"], []).append((row["rank"], row["code"]))
    languages = tuple(sorted(found))
    return Profiles(languages, tuple(np.array([code for _, code in sorted(found[x])], "int64") for x in languages))


class Identifier:
    """Profiles as one table: all their n-grams sorted, and each language's ranks of them (-1 for none)."""

    def __init__(self, profiles: Profiles, size: int) -> None:
        self.profiles, self.size = profiles, size
        self.known = np.unique(np.concatenate([np.zeros(0, "int64"), *profiles.ranks]))
        self.rank = np.full((len(profiles.languages), len(self.known) + 1), -1, "int32")
        for i, codes in enumerate(profiles.ranks):
            self.rank[i, np.searchsorted(self.known, codes)] = np.arange(len(codes))

    def predict(self, text: str | None) -> tuple[str, float]:
        ids = _codes(text) if text else np.zeros(0, "int32")
        if not len(ids) or not self.profiles.languages:
            return "und", 0.0
        top = _top(ids, self.size)
        at = np.searchsorted(self.known, top)
        at[self.known[np.minimum(at, len(self.known) - 1)] != top] = len(self.known)
        known = self.rank[:, at]
        apart = np.where(known < 0, self.size, np.abs(known - np.arange(len(top))))
        distance = apart.sum(axis=1)
        best = int(distance.argmin())
        return self.profiles.languages[best], float(1.0 - distance[best] / (self.size * len(top)))


def identify_languages(
    df: DataFrame,
    *,
    learn_from: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    size: int = 300,
    sample_per_language: int = 300,
    max_languages: int = 1000,
) -> DataFrame:
    """``df`` without ``text`` and ``lang``, plus ``lang_pred string`` and ``score double``.

    A language's profile is the list of the ``size`` most frequent letter n-grams (1 to 3, lower case,
    words apart) of its labelled documents for which ``learn_from`` holds; a document goes to the language
    whose profile is nearest to its own list by out-of-place distance, the sum over its n-grams of how far
    their ranks differ (``size`` where the profile lacks one). ``score`` is 1 for equal lists and 0 where
    none of the n-grams is known. The label is no input of the prediction.

    The classifier is fitted on a bounded sample: about ``sample_per_language`` labelled documents of each
    language, by a hash of their id (never more than twice as many); their n-grams are counted in tasks, and the ``size`` best of a language
    reach the driver. More than ``max_languages`` are an error. Letters are code points, so every script has its own n-grams. A language
    none of whose sampled documents has a letter is not learned. Every text is read whole. A null text, or one without a letter, is ``und`` with score
    0; without any labelled document all are. A narrow pass with no shuffle of texts; repeated rows and
    skew do not matter, and columns named like the new ones are replaced.
    """
    usable = col(lang).isNotNull() & col(text).isNotNull() & F.coalesce(learn_from, F.lit(False))
    labelled = df.where(usable).select(col(lang).alias("lang"), col(doc_id).alias("id"), col(text).alias("text"))
    best = Window.partitionBy("lang").orderBy(F.xxhash64("id"), F.xxhash64("text"))
    drawn = (
        hash_sample(labelled, F.col("lang"), F.col("id"), sample_per_language)
        .withColumn("n", F.row_number().over(best)).where(F.col("n") <= 2 * sample_per_language)
        .select("lang", "text")
    )
    found = labelled.select("lang").distinct().limit(max_languages + 1).count()
    if found > max_languages:
        raise ValueError(f"more than {max_languages} languages; profiles are held by one process")
    profiles = learn(drawn, size)
    raw = free_name(df, "raw")
    rest = only_columns(df, drop=(text, lang, "lang_pred", "score"))
    lean = df.select(*map(col, rest), col(text).alias(raw))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Identifier(profiles, size)
        for batch in batches:
            found = [model.predict(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*rest, "lang_pred", "score"])

    return map_arrow(lean, add, lean.drop(raw).schema.add("lang_pred", "string").add("score", "double"))
