"""Folders that driver and executors share, and tables that are kept there from one query to the next."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where the session has none and driver and executors are one process."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tessera-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there, so that later steps neither repeat it nor hang on an executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def state_of(spark: SparkSession, path: str) -> str:
    """A digest of a stored table's files by name, length and time of change; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    row = files.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("x")).first()
    return hashlib.sha256(f"{path}|{row['n']}|{row['x']}".encode()).hexdigest()[:16]


def kept(spark: SparkSession, name: str, source: str, build: Callable[[str], None]) -> str:
    """The folder of what ``build(folder)`` has made of the table at ``source``: built once for each state of its files.

    A build goes to a folder of its own, which is named to later calls only when it is whole; one that fails, or that
    another has overtaken, is never read.
    """
    base = f"{shared_folder(spark)}/kept/{name}-{state_of(spark, source)}"
    try:
        return spark.read.schema("folder string").json(f"{base}/current").first()["folder"]
    except AnalysisException:
        folder = f"{base}/{uuid.uuid4().hex}"
        build(folder)
        try:
            spark.createDataFrame([(folder,)], "folder string").coalesce(1).write.json(f"{base}/current")
        except AnalysisException:  # another session was first
            return spark.read.schema("folder string").json(f"{base}/current").first()["folder"]
        return folder


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = 32_000_000) -> DataFrame:
    """``df``, which should be stored, with a broadcast hint if so many rows of that size stay within ``limit`` bytes."""
    return F.broadcast(df) if df.limit(limit // row_bytes + 1).count() * row_bytes <= limit else df
