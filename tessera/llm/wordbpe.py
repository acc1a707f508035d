"""Ids of a lower-casing word-end BPE, by way of a bounded memo of white-space words."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

# The split pattern of the tokenizer file, restricted to the characters of _PLAIN.
_PRETOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^\sa-zà-öø-ÿß0-9]+")
#: Texts of these characters alone are in normal form, lower-case one to one, and split as above.
_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
_GAP = re.compile(r"[\x20\x09-\x0D]+")
_WORD_END = "</w>"
# The byte alphabet of the tokenizer file. Printable bytes of Latin-1 stand for themselves, the others follow from U+0100 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_LETTER = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}
#: The spelling of the characters of Latin-1 beyond ASCII.
_BYTES = {c: "".join(_LETTER[b] for b in chr(c).encode()) for c in range(128, 256)}
_LONGEST = 64  #: characters; longer words are not remembered
_GROUP = 1 << 20  #: characters of the texts whose unknown words the library encodes in one call


class WordBpe:
    """``ids(text)`` equals ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    No pre-token and no special token of the tokenizer spans white space, and its normal form does not reach across it,
    so a text's ids are those of its words one after another, and words are looked up. Unknown words of plain characters
    are cut by the tokenizer's pattern, encoded by its model in one call and told apart by their word-end ids; other unknown
    words (also those that hold a special token's string) go to the library each by itself.
    """

    def __init__(self, path: str, memo: int = 250_000) -> None:
        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith(_WORD_END)]] = True
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.marked = all("<" in s for s in self.special)
        #: The model alone, for pre-tokens that are spelt in its alphabet of bytes already.
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.memo: dict[str, bytes] = {}
        self.limit = memo

    def ids(self, text: str) -> np.ndarray:
        return next(self.all_ids([text]))

    def all_ids(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text. Texts are taken in groups, long ones in slices, so little is held beside the ids."""
        group: list[list[str]] = []
        held = 0
        for text in texts:
            if len(text) > _GROUP:
                yield from self._encoded(group)
                parts = [next(self._encoded([self._words(x)])) for x in self._slices(text)]
                group, held = [], 0
                yield np.concatenate(parts)
                continue
            group.append(self._words(text))
            held += len(text)
            if held >= _GROUP:
                yield from self._encoded(group)
                group, held = [], 0
        yield from self._encoded(group)

    @staticmethod
    def _words(text: str) -> list[str]:
        return text.lower().split() if _PLAIN.fullmatch(text) else [x for x in _GAP.split(text) if x]

    @staticmethod
    def _slices(text: str) -> Iterator[str]:
        """Cuts at white space."""
        start = 0
        while start < len(text):
            gap = _GAP.search(text, min(len(text), start + _GROUP))
            end = gap.start() if gap else len(text)
            yield text[start:end]
            start = end

    def _encoded(self, group: list[list[str]]) -> Iterator[np.ndarray]:
        found = [list(map(self.memo.get, words)) for words in group]
        gaps = [[i for i, x in enumerate(row) if x is None] if None in row else [] for row in found]
        new = {words[i] for words, places in zip(group, gaps, strict=True) for i in places}
        learned = self._learn(list(new)) if new else {}
        for words, row, places in zip(group, found, gaps, strict=True):
            for i in places:
                row[i] = learned[words[i]]
            yield np.frombuffer(b"".join(row), "<u4")

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of new words. They are remembered while there is room: frequent words come early, and rare ones may be learned again."""
        memo, special = self.memo, self.special
        plain = [w for w in new if len(w) <= _LONGEST and (w.isascii() or _PLAIN.fullmatch(w)) and w.lower() == w]
        plain = [w for w in plain if "<" not in w or not any(s in w for s in special)] if self.marked else []
        parts = list(map(_PRETOKENS.findall, plain))
        unknown = list(set().union(*parts).difference(memo))
        spelt = [p if p.isascii() else p.translate(_BYTES) for p in unknown]
        ids = np.array(self.model.encode_batch_fast([" ".join(spelt)], add_special_tokens=False)[0].ids, "<u4")
        stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        raw, at = ids.tobytes(), [0, *stops]
        found = {p: raw[a:b] for p, a, b in zip(unknown, at[:-1], stops, strict=True)}
        for word, cut in zip(plain, parts, strict=True):
            if len(cut) > 1:
                found[word] = b"".join([found[p] if p in found else memo[p] for p in cut])
            elif word not in found:
                found[word] = memo[cut[0]]
        others = list(set(new).difference(plain))
        for word, made in zip(others, self.library.encode_batch_fast(others, add_special_tokens=False), strict=True):
            found[word] = np.array(made.ids, "<u4").tobytes()
        if len(memo) + len(found) <= self.limit:
            memo.update((w, x) for w, x in found.items() if len(w) <= _LONGEST)
        elif len(found) > self.limit // 4:  # other texts than before
            memo.clear()
        return found


@cache
def encoder(path: str) -> WordBpe:
    """One encoder a Python worker, so that its memo outlives the tasks."""
    return WordBpe(path)
