"""Exact token counts of whole texts, with overlap resynchronisation for huge ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import col, free_name, map_arrow, only_columns

_NORMAL = 1  #: type of the model's ordinary pieces


class Counter:
    """Token counts as the library gives them for the whole text, in memory bounded by the chunk size.

    A text of up to ``chunk`` characters is encoded at once. A longer one is encoded in chunks that
    overlap by ``overlap`` characters, with offsets. Two neighbours are spliced at a boundary inside
    their overlap at which both have a token boundary and which is proven stable: the pair of characters
    around it occurs side by side in no piece of the vocabulary. Merges only ever make pieces of the
    vocabulary, so none crosses such a pair, in any context, and the merges on its two sides do not
    depend on each other. Where an overlap has no such boundary it is doubled, and again, up to the
    whole text if need be, so the count is always the library's.
    """

    def __init__(self, path: str, chunk: int = 16_384, overlap: int = 64) -> None:
        if not 0 < overlap < chunk:
            raise ValueError("the overlap must be shorter than a chunk")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        model = self.library
        pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
        self.joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}

    def stable(self, text: str, at: int) -> bool:
        return text[at - 1 : at + 1].replace(" ", "▁") not in self.joined

    def counts(self, texts: list[str]) -> list[int]:
        short = [i for i, t in enumerate(texts) if len(t) <= self.chunk]
        out = [0] * len(texts)
        for i, ids in zip(short, self.library.encode([texts[i] for i in short], num_threads=1), strict=True):
            out[i] = len(ids)
        for i in set(range(len(texts))) - set(short):
            out[i] = self.long_count(texts[i])
        return out

    def boundaries(self, text: str) -> np.ndarray:
        """Character offsets at which the tokens of ``text`` begin, one for each token."""
        found = self.library.encode(text, return_type="proto").pieces
        begins = np.fromiter((p.begin for p in found), "int64", len(found))
        raw = np.frombuffer(text.encode(), "uint8")
        return np.cumsum((raw & 0xC0) != 0x80)[np.minimum(begins, len(raw) - 1)] - 1

    def long_count(self, text: str) -> int:
        total, splice, start, end = 0, 0, 0, self.chunk
        while True:
            here = self.boundaries(text[start:end]) + start
            if end >= len(text):
                return total + int((here >= splice).sum())
            overlap, cut = self.overlap, None
            while cut is None:
                nxt = max(end - overlap, splice + 1)
                there = self.boundaries(text[nxt : nxt + self.chunk]) + nxt
                common = np.intersect1d(here, there)
                common = common[(common > nxt) & (common > splice) & (common < end)]
                cut = next((int(c) for c in common if self.stable(text, int(c))), None)
                if cut is None:
                    if nxt == splice + 1 or overlap >= self.chunk:
                        break
                    overlap *= 2
            if cut is None:  # no stable boundary in the whole chunk: let it reach further
                end = min(len(text), end + (end - start))
                continue
            total += int(((here >= splice) & (here < cut)).sum())
            splice, start, end = cut, nxt, min(len(text), nxt + self.chunk)


def token_counts(df: DataFrame, *, model: str, text: str = "text", out: str = "n_tokens", chunk: int = 16_384, overlap: int = 64) -> DataFrame:
    """``df`` with its text column replaced by ``out`` (long), the number of tokens of the whole text.

    No begin, end or other special tokens are added; a null text counts as empty and has 0. Counting is
    a narrow pass: no shuffle, so ties, repeated rows and skewed columns do not matter. Other columns are
    kept as they are (``out`` replaces one of that name); an empty table gives an empty result.
    """
    raw = free_name(df, "raw")
    rest = only_columns(df, drop=(text, out))
    lean = df.select(*(col(c) for c in rest), F.coalesce(col(text), F.lit("")).alias(raw))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model, chunk, overlap)
        for batch in batches:
            found = counter.counts(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], names=[*rest, out])

    return map_arrow(lean, add, lean.drop(raw).schema.add(out, "long"))
