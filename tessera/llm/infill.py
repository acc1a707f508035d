"""Fill-in-middle transformation: texts cut at exact token ranks by an indexable skip list over tokens and code points."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import col, free_name, map_arrow, only_columns

#: The marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Code points of output that a task gathers before it hands them on.
_BATCH = 4_000_000


def unit_ends(text: str) -> np.ndarray:
    """The code point offsets at which the units of ``text`` end.

    A unit is a word (no white space of 09 to 0D and 20) with the white space before it; white space at the end is a unit of its own.
    """
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    word = (points != 32) & ((points < 9) | (points > 13))
    if not len(word):
        return np.zeros(0, "int64")
    ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    return np.append(ends, len(word))


class Towers:
    """Heights of a skip list's towers: one in four reaches the next lane, as a hash of the rank decides. All lists share them."""

    def __init__(self, seed: int = 42) -> None:
        self.seed, self.size, self.lanes = np.uint64(seed), 0, []

    def lane(self, level: int, n: int) -> np.ndarray:
        """Ranks under ``n`` whose towers reach the express lane ``level``, from 1 on."""
        if n > self.size:
            self._grow(max(n, 2 * self.size, 1024))
        return self.lanes[level - 1][: np.searchsorted(self.lanes[level - 1], n)] if level <= len(self.lanes) else np.zeros(0, "int64")

    def _grow(self, size: int) -> None:
        x = np.arange(size, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15) + self.seed
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        self.size, self.lanes, ranks = size, [], np.arange(size)
        while len(ranks) > 4:
            ranks = ranks[x[ranks] & np.uint64(3) == 0]
            x >>= np.uint64(2)
            self.lanes.append(ranks)


class SkipList:
    """A text's units under express lanes whose links carry how many units and how many code points they pass.

    The links of lane 0 pass one unit. A link of a higher lane leads from one tower to the next and passes what the links below it pass
    together. The head is a tower of every lane.
    """

    def __init__(self, widths: np.ndarray, towers: Towers) -> None:
        self.n = len(widths)
        lanes = [(np.ones(self.n, "int64"), widths, np.arange(self.n))]  # units, code points, where a link starts in the lane below
        ranks, level = np.arange(self.n), 1
        while len(ranks) > 4:
            reached = towers.lane(level, self.n)
            reached = reached if len(reached) and not reached[0] else np.append(0, reached)
            if len(reached) == len(ranks):
                break
            down = np.searchsorted(ranks, reached)
            units, points = (np.add.reduceat(x, down) for x in lanes[-1][:2])
            lanes.append((units, points, down))
            ranks, level = reached, level + 1
        self.lanes = lanes[::-1]

    def offset(self, rank: int) -> int:
        """Code points before the unit of that rank, or of the whole text at rank n: links are followed while they do not pass the rank."""
        passed = offset = at = 0
        for level, (units, points, down) in enumerate(self.lanes):
            while at < len(units) and passed + units[at] <= rank:
                passed += int(units[at])
                offset += int(points[at])
                at += 1
            if passed == rank:
                return offset
            if level + 1 < len(self.lanes):
                at = int(down[at])
        raise IndexError(f"no rank {rank} among {self.n} units")


def cut(text: str, draws: tuple[int, int, int, int], towers: Towers, rate: int, spm: int) -> tuple:
    """``n, form, prefix_chars, middle_chars, output`` of one text under four draws."""
    ends = unit_ends(text)
    n = len(ends)
    if not text or draws[2] % 100 >= rate or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    units = SkipList(np.diff(ends, prepend=0), towers)
    low, high = (units.offset(r) for r in sorted((draws[0] % (n + 1), draws[1] % (n + 1))))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    p, s, m = MARKS
    if draws[3] % 100 < spm:
        return n, "spm", low, high - low, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", low, high - low, f"{p}{prefix}{s}{suffix}{m}{middle}"


def draws_of(key: str, seed: int) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def fill_in_middle(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """``df`` with its text transformed: ``text`` is the output, and ``n, form, prefix_chars, middle_chars`` say how it was made.

    ``rate`` percent of the documents (by SHA-256 of seed and id) are cut at two unit ranks drawn evenly from 0 to n, into prefix,
    middle and suffix; of those, ``spm`` percent put the suffix first. The rest, empty texts and texts that hold a mark stay plain, with
    null lengths. A null text is empty. A null id draws as an empty one. Each row is transformed by itself, in one narrow pass: ties and
    repeated rows give equal outputs, an empty table gives no rows, other columns stay (those named as the four new ones are replaced).
    A text is held whole by its task, with about 30 bytes a code point.
    """
    made = ("n", "form", "prefix_chars", "middle_chars")
    rest = only_columns(df, drop=(text, *made))
    kept = df.select(*(col(c) for c in rest))
    lean = df.select(*(col(c) for c in rest), col(doc_id).cast("string").alias(free_name(df, "id")), F.coalesce(col(text), F.lit("")).alias(free_name(df, "text")))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        towers = Towers(seed)
        for batch in batches:
            start, size, rows = 0, 0, []
            ids, texts = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            for i in range(batch.num_rows):
                rows.append(cut(texts[i].as_py(), draws_of(ids[i].as_py() or "", seed), towers, rate, spm))
                size += len(rows[-1][4])
                if size >= _BATCH or i + 1 == batch.num_rows:
                    others = batch.slice(start, len(rows)).columns[:-2]
                    n, form, prefix, middle, output = zip(*rows, strict=True)
                    columns = [pa.array(output, pa.string()), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())]
                    yield pa.RecordBatch.from_arrays([*others, *columns], names=[*rest, text, *made])
                    start, size, rows = i + 1, 0, []

    schema = kept.schema.add(text, "string").add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long")
    return map_arrow(lean, add, schema)


def restored(output: Column, form: Column) -> Column:
    """The exact text behind an output, from the output and its form alone; plain texts may hold marks."""
    parts = F.split(output, "|".join(MARKS))
    first, second, third = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, third, second)).when(form == "spm", F.concat(second, third, first)).otherwise(output)
