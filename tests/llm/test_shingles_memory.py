"""What a task of the near-duplicates stage holds while it reads a batch of documents."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tessera.llm.shingles import _prefixes, overlap, shingle_set


class Reader:
    """In place of a table: gives the function that reads its batches."""

    def mapInArrow(self, function, schema):  # noqa: N802
        return function


def test_sets_of_a_batch_are_not_held_together():
    rng = np.random.default_rng(33)
    texts = [" ".join(f"w{v}" for v in rng.integers(0, 10**6, 1500)) for _ in range(1000)] + ["", None]
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array([t and t.encode() for t in texts], pa.binary())], names=["doc_id", "uid", "raw"])
    read = _prefixes(Reader(), 5, 0.8, [])
    tracemalloc.start()
    most, at = 0, 0
    for out in read(iter([batch])):
        most = max(most, tracemalloc.get_traced_memory()[1])
        for doc, n, prefix in zip(out["doc_id"], out["n"], out["prefix"], strict=True):
            found = shingle_set((texts[at] or "").encode())
            assert doc.as_py() == at and n.as_py() == len(found)
            assert (np.array(prefix.as_py(), "int64").view("uint64") == found[: len(found) - overlap(len(found), 0.8) + 1]).all()
            at += 1
    tracemalloc.stop()
    assert at == len(texts)
    # The whole sets of the batch are 12 MB.
    assert most < 6_000_000
