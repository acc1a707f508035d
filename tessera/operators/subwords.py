"""Windows over a byte-pair tokenizer's ids, whole texts of any length in bounded pieces."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that are encoded at a time, about.
_PIECE = 200_000
#: A lone space between words begins a token of its word, whatever stands around, so a text may be cut before it.
_CUT = re.compile(r"(?<=[^\s]) (?=[^\s])")


class Windows:
    """Windows of ``size`` ids, each beginning ``overlap`` ids before the end of the one before, of texts encoded piece by piece."""

    def __init__(self, ranks: str, pattern: str, size: int, overlap: int) -> None:
        if not 0 <= overlap < size:
            raise ValueError("the overlap must be shorter than a window")
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.size, self.overlap = size, overlap

    def pieces(self, text: str, piece: int = _PIECE) -> Iterator[str]:
        """The text in pieces that no token crosses."""
        at = 0
        while len(text) - at > piece:
            cut = _CUT.search(text, at + piece)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def of(self, text: str, piece: int = _PIECE) -> Iterator[tuple[int, int, int, int, int, str]]:
        """``chunk_index, token_start, token_end, byte_start, byte_end, content``; a text without tokens has no window."""
        held: list[bytes] = []  # the tokens from ``first`` on
        first = before = index = 0
        for part in self.pieces(text, piece):
            held += self.encoding.decode_tokens_bytes(self.encoding.encode_ordinary(part))
            while len(held) > self.size:
                yield self._window(index, first, before, held[: self.size])
                step = self.size - self.overlap
                before += sum(map(len, held[:step]))
                del held[:step]
                first, index = first + step, index + 1
        if held:
            yield self._window(index, first, before, held)

    @staticmethod
    def _window(index: int, first: int, before: int, tokens: list[bytes]) -> tuple[int, int, int, int, int, str]:
        raw = b"".join(tokens)
        return index, first, first + len(tokens), before, before + len(raw), raw.decode("utf-8", "replace").strip()


def subword_windows(docs: DataFrame, *, doc: str, text: str, ranks: str, pattern: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """``doc, chunk_index, token_start, token_end, byte_start, byte_end, content``: windows over the ids that a byte-pair vocabulary gives a text.

    ``ranks`` is the vocabulary's file, on every worker, ``pattern`` splits texts before merging; strings of special tokens are ordinary text. Windows are counted in whole
    tokens and bytes; their ``content`` is decoded, with a replacement character where a window cuts a character, and stripped. A null or empty text has no
    window. A task holds a text, and the tokens of one piece and one window of it.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(ranks, pattern, size, overlap)
        names = [doc, "chunk_index", "token_start", "token_end", "byte_start", "byte_end", "content"]
        for batch in batches:
            for i in range(batch.num_rows):
                found = list(windows.of(batch.column(1)[i].as_py()))
                if found:
                    columns = list(zip(*found, strict=True))
                    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                    ids = pa.array([batch.column(0)[i].as_py()] * len(found), batch.schema.field(0).type)
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    lean = docs.where(F.col(text) != "").select(doc, text)
    kind = lean.schema[doc].dataType.simpleString()
    return lean.mapInArrow(cut, f"`{doc}` {kind}, chunk_index int, token_start long, token_end long, byte_start long, byte_end long, content string")
