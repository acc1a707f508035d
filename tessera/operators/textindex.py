"""A stored inverted index: postings in buckets by term and blocks of documents, and searches that read only what can matter."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.english import lexeme
from tessera.operators import fulltext
from tessera.operators.fulltext import WEIGHT, Term

#: Bytes of text that are dealt together, and words that a task turns to postings at a time.
PIECE, STEP = 4_000_000, 1_000_000


def _bucket(lexeme: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(lexeme), F.lit(buckets)).cast("int")


def _kind(of_id: str) -> str:
    return f"lexeme string, block bigint, n_docs int, most int, entries array<struct<id: {of_id}, positions: array<int>>>"


def _posted(english: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function that makes rows ``id, block, words``, sorted by block, to one row for each term and block; a task holds a batch and a block."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _then_none(batches):
            table = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if table is None or not table.num_rows:
                continue
            block = table["block"].to_numpy()
            ends = np.append(np.flatnonzero(block[1:] != block[:-1]) + 1, table.num_rows)
            if batch is not None:  # the last block may go on
                rest, ends = table.slice(int(ends[-2]) if len(ends) > 1 else 0), ends[:-1]
            words = np.cumsum(pc.list_value_length(table["words"]).to_numpy())
            begin = done = 0
            for end, more in zip(ends, [*ends, None][1:], strict=True):
                if more is None or words[more - 1] - done > STEP:  # whole blocks of about so many words at a time
                    found = _terms(table.slice(begin, int(end) - begin), english)
                    if found is not None:
                        yield found
                    begin, done = int(end), words[end - 1]

    return post


def _terms(rows: pa.Table, english: bool) -> pa.RecordBatch | None:
    """Rows ``id, block, words`` of whole blocks as a row for each term and block; each distinct word is stemmed once."""
    ids, blocks, words = (rows.sort_by([("block", "ascending"), ("id", "ascending")])[c].combine_chunks() for c in ("id", "block", "words"))
    known = words.flatten().dictionary_encode()
    stems = (pa.array([lexeme(w) for w in known.dictionary.to_pylist()], "string") if english else known.dictionary).dictionary_encode()
    code = stems.indices.fill_null(-1).to_numpy()[known.indices.to_numpy()]
    at = np.flatnonzero(code >= 0)
    if not len(at):
        return None
    lengths = pc.list_value_length(words).to_numpy()
    row = np.repeat(np.arange(len(lengths)), lengths)[at]
    number = np.cumsum(np.append(0, np.diff(blocks.to_numpy()) != 0))[row]
    key = number * len(stems.dictionary) + code[at]
    order = np.argsort(key, kind="stable")  # rows and places stay in order within a term and block
    at, row, key = at[order], row[order], key[order]
    positions = (at - (np.cumsum(lengths) - lengths)[row] + 1).astype("int32")
    entry = np.append(0, np.flatnonzero((np.diff(key) != 0) | (np.diff(row) != 0)) + 1)
    first = np.append(0, np.flatnonzero(np.diff(key[entry])) + 1)  # entries that begin a term and block
    held = pa.ListArray.from_arrays(pa.array(np.append(entry, len(at)).astype("int32")), pa.array(positions))
    entries = pa.StructArray.from_arrays([ids.take(pa.array(row[entry])), held], ["id", "positions"])
    most = np.maximum.reduceat(np.diff(np.append(entry, len(at))), first).astype("int32")
    begins = entry[first]
    columns = [
        stems.dictionary.take(pa.array(code[at[begins]])), blocks.take(pa.array(row[begins])), pa.array(np.diff(np.append(first, len(entry))).astype("int32")), pa.array(most),
        pa.ListArray.from_arrays(pa.array(np.append(first, len(entry)).astype("int32")), entries),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["lexeme", "block", "n_docs", "most", "entries"])


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _blocks(texts: DataFrame, size: int) -> DataFrame:
    """``texts(id, text)`` with ``n_bytes`` and ``block``: documents in order of their length, ``size`` of them at most a block.

    They are dealt once, as ranges of lengths of about ``PIECE`` bytes each; lengths that are more frequent are spread by id. Numbers follow
    from the table alone, so that two runs agree. A block ends at ``PIECE`` bytes, too.
    """
    bits = "length(bin(n_bytes))"
    sized = texts.withColumn("n_bytes", F.octet_length("text")).withColumn("kind", F.expr(f"64 * {bits} + shiftright(shiftleft(cast(n_bytes as long), 6), {bits} - 1) - 64"))
    part, held, ranges = 0, 0, []
    for kind, n in sorted(sized.groupBy("kind").agg(F.sum("n_bytes")).collect()):  # 64 kinds for each power of two
        if held and held + n > PIECE:
            part, held = part + 1, 0
        pieces = -(-n // PIECE) or 1
        ranges.append((kind, part, pieces))
        part, held = (part, held + n) if pieces == 1 else (part + pieces, 0)
    dealt = sized.join(F.broadcast(texts.sparkSession.createDataFrame(ranges, "kind long, first long, pieces long")), "kind")
    dealt = dealt.select("id", "text", "n_bytes", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("pieces"))).alias("part"))
    ordered = Window.partitionBy("part").orderBy("n_bytes", "id")
    before = F.sum("n_bytes").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_bytes")
    number = F.floor((F.row_number().over(ordered) - 1) / size) + F.floor(before / PIECE)
    return dealt.select("id", "text", "n_bytes", (F.col("part") * (1 << 32) + number).alias("block"))


def build(df: DataFrame, folder: str, *, id_col: str, text: str, english: bool = True, buckets: int = 64, block: int = 128) -> None:
    """Write the index of ``df``'s texts to ``folder``: its terms are English stems, or whole lower-case words.

    Documents are put in order of their length, and each ``block`` of them is one block: documents of like length are alike in
    what a term can give them, which keeps a block's maximum close to its members. ``documents`` has ``id, n_bytes, block``; ``postings``,
    partitioned by a hash of the term, has a row for each term and block: ``lexeme, block, n_docs, most`` (occurrences in a document,
    at most) and ``entries`` (id and positions), which bounds every row, however frequent the term. A document of no words has no postings.
    Only the texts are exchanged, once: a block's documents are in one task, which makes all its rows, so no word ever moves.
    """
    spark = df.sparkSession
    texts = df.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    numbered = _blocks(texts, block)
    numbered.select("id", "n_bytes", "block").write.option("compression", "zstd").parquet(f"{folder}/documents")
    words = numbered.select("id", "block", fulltext.words(F.col("text")).alias("words"))
    rows = words.mapInArrow(_posted(english), _kind(texts.schema["id"].dataType.simpleString())).withColumn("bucket", _bucket(F.col("lexeme"), buckets))
    rows.sortWithinPartitions("bucket", "lexeme", "block").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{folder}/postings")
    spark.createDataFrame([(buckets, block, english)], "buckets int, block int, english boolean").coalesce(1).write.json(f"{folder}/about")


@dataclass(frozen=True)
class Found:
    """A search's rows ``id, score``, and of the blocks that can hold a match (``block, bound``) those that were read."""

    rows: DataFrame
    blocks: DataFrame | None = None
    read: DataFrame | None = None


class TextIndex:
    """An index that ``build`` has written, opened for searches."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        about = spark.read.schema("buckets int, block int, english boolean").json(f"{folder}/about").first()
        self.buckets, self.english = about["buckets"], about["english"]

    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/documents")

    def postings(self, stems: Sequence[str] | None = None) -> DataFrame:
        """All postings, or those of ``stems``, of which only the buckets are listed and read."""
        id_type = self.documents().schema["id"].dataType.simpleString()
        rows = self.spark.read.schema(f"{_kind(id_type)}, bucket int").parquet(f"{self.folder}/postings")
        if stems is None:
            return rows
        # The hash of ``_bucket``, taken here so that the filter is a list of partitions.
        hashes = (xxhash.xxh64_intdigest(s.encode(), 42) for s in stems)
        named = sorted({(h - (1 << 64) if h >> 63 else h) % self.buckets for h in hashes})
        return rows.where(F.col("bucket").isin(named) & F.col("lexeme").isin(sorted(stems)))

    def _entries(self, rows: DataFrame, allowed: DataFrame | None) -> DataFrame:
        """``id, lexeme, positions`` of posting rows, of the documents that are allowed."""
        flat = rows.select("lexeme", F.explode("entries").alias("e")).select("e.id", "lexeme", "e.positions")
        return flat if allowed is None else flat.join(allowed, "id", "left_semi")

    def search(self, query: Sequence[Sequence[Term | None]], *, limit: int, allowed: DataFrame | None = None, count: bool = False, first: int = 8) -> Found:
        """The ``limit`` best documents in which an alternative of ``query`` holds, ties by id; by cover density, or if ``count`` by occurrences.

        ``allowed(id)`` restricts the documents before they are ranked. From the blocks' maxima alone follows a bound on what any of their documents
        can score. The ``first`` blocks of highest bound are scored, which gives a score that a document must reach; then only blocks
        whose bound reaches it are read, so the result is that of reading all. Negated terms give no bound, and an alternative of nothing else
        matches documents without postings, so such a query reads all documents' ids.
        """
        plan = [kept for terms in query if (kept := [t for t in terms if t])]
        if not plan:
            return Found(self.documents().select("id", F.lit(0.0).alias("score")).where("false"))
        stems = sorted({s for terms in plan for t in terms for s in t.stems})
        rows = self.postings(stems)
        score = (lambda found: _occurrences(found, plan)) if count else (lambda found: fulltext.scores_of(found, query, id_col="id"))
        if any(all(t.negated for t in terms) for terms in plan):
            every = self.documents().select("id")
            every = every if allowed is None else every.join(allowed, "id", "left_semi")
            held = self._entries(rows, allowed)
            return Found(fulltext.scores_of(held, query, id_col="id", every=every).orderBy(F.desc("score"), "id").limit(limit))
        bounds = rows.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("lexeme", "most"))).alias("most"))
        bounds = bounds.select("block", _bound(plan, 1.0 if count else WEIGHT).alias("bound")).where("bound > 0")
        top = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(first).collect()]
        begun = score(self._entries(rows.where(F.col("block").isin(top)), allowed)).orderBy(F.desc("score"), "id").limit(limit)
        bar = [r["score"] for r in begun.select("score").collect()]  # ``limit`` numbers at most
        if len(top) < first:
            return Found(begun, bounds, bounds)
        read = bounds if len(bar) < limit else bounds.where((F.col("bound") >= min(bar)) | F.col("block").isin(top))
        kept = rows if len(bar) < limit else rows.join(read.select("block"), "block", "left_semi")
        return Found(score(self._entries(kept, allowed)).orderBy(F.desc("score"), "id").limit(limit), bounds, read)


def _bound(plan: list[list[Term]], weight: float) -> Column:
    """What a document can score at most, by ``most``, a map of terms to occurrences; 0 where no alternative can hold.

    Each occurrence of a term gives at most one cover, and each cover at most the weight.
    """
    at = lambda s: F.coalesce(F.try_element_at("most", F.lit(s)), F.lit(0))
    of = {(t.stems, t.offsets): F.array_min(F.array(*map(at, t.stems))) for terms in plan for t in terms if not t.negated}
    holds = reduce(or_, (reduce(and_, (of[t.stems, t.offsets] > 0 for t in terms if not t.negated)) for terms in plan))
    # A little more, as sums of doubles may round up.
    return F.when(holds, (1 + 1e-9) * weight * reduce(lambda a, b: a + b, of.values())).otherwise(0.0)


def _occurrences(found: DataFrame, plan: list[list[Term]]) -> DataFrame:
    """``id, score`` of documents that hold all stems of the one alternative, by the number of their occurrences."""
    (terms,) = plan
    stems = {s for t in terms for s in t.stems}
    summed = found.groupBy("id").agg(F.count(F.lit(1)).alias("held"), F.sum(F.size("positions")).cast("double").alias("score"))
    return summed.where(F.col("held") == len(stems)).select("id", "score")


def ranked(found: Found, id_col: str) -> DataFrame:
    """``id_col, score, rank`` of a search; ``limit`` rows at most are in one place."""
    return found.rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).withColumnRenamed("id", id_col)
