"""A deterministic embedding of texts by hashed words, for tests and for runs without a provider."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """Unit vectors of ``dims`` floats: each word adds a sign at a place, both from its hash.

    The hashes are taken by Spark; a null or blank text has no vector (null).
    """
    hashes = F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))

    def add(column: pd.Series) -> pd.Series:
        out = []
        for found in column:
            h = np.asarray([] if found is None else found, "int64")
            vector = np.bincount((h >> 1) % dims, np.where(h & 1, 1.0, -1.0), dims)
            norm = float(np.sqrt(vector @ vector))
            out.append((vector / norm).astype("float32").tolist() if norm else None)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(add, "array<float>")(hashes)
