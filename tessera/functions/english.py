"""English stems and stop words: the published Snowball English (Porter2) algorithm."""

from __future__ import annotations

import functools
import re

# The Snowball English stop words and the algorithm's suffixes and exceptions.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
    itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
    has had having do does did doing a an the and but if or because as until while of at by for with about against between
    into through during before after above below to from up down in out on off over under again further then once here there
    when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
    just don should now""".split()
)
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_FOURTH = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), "")

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_VOWEL = re.compile(r"[aeiouy]")


def _suffix(word: str, table) -> str:
    """The longest suffix of ``word`` in ``table``, or an empty one."""
    return max((s for s in table if word.endswith(s)), key=len, default="")


def _swap(word: str, table: dict[str, str], start: int, allowed=lambda stem, suffix: True) -> str:
    """``word`` with its longest suffix replaced, if that lies behind ``start`` and is allowed."""
    found = _suffix(word, table)
    stem = word[: len(word) - len(found)]
    return stem + table[found] if found and len(stem) >= start and allowed(stem, found) else word


def _past(word: str, r1: int) -> str:
    """Without endings of the past and of participles."""
    found = _suffix(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    stem = word[: len(word) - len(found)]
    if found.startswith("eed"):
        return stem + "ee" if len(stem) >= r1 else word
    if not found or not _VOWEL.search(stem):
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", stem):
        return stem[:-1]
    return stem + "e" if len(stem) <= r1 and _SHORT_END.search(stem) else stem


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    return word[:-1] if word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]) else word


@functools.lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word without apostrophes."""
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    word = re.sub(r"(^|(?<=[aeiouy]))y", "Y", word)
    first = re.match(r"gener|commun|arsen", word) or _REGION.search(word)
    r1 = first.end() if first else len(word)
    second = _REGION.search(word, r1)
    r2 = second.end() if second else len(word)
    word = _plural(word)
    if word in _AFTER_PLURAL:
        return word
    word = _past(word, r1)
    if re.search(r".[^aeiouy][yY]$", word):
        word = word[:-1] + "i"
    word = _swap(word, _SECOND, r1, lambda s, x: s.endswith("l") if x == "ogi" else x != "li" or s.endswith(tuple("cdeghkmnrt")))
    word = _swap(word, _THIRD, r1, lambda s, x: x != "ative" or len(s) >= r2)
    word = _swap(word, _FOURTH, r2, lambda s, x: x != "ion" or s.endswith(("s", "t")))
    if word.endswith("e"):
        body = word[:-1]
        if len(body) >= r2 or len(body) >= r1 and not _SHORT_END.search(body):
            word = body
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


def lexeme(word: str) -> str | None:
    """The stem of a word, or none for a stop word."""
    return None if word in STOP_WORDS else stem(word)
