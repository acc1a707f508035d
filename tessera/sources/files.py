"""Files of documents: written from tasks, and read as bytes by a stream that takes each of them once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: bytes of a filing, at most.
MAX_BYTES = 25 * 1024 * 1024
SCHEMA = "path string, length long, changed timestamp, status string, content_hash string"


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_documents(texts: DataFrame, folder: str, *, name: str, body: str, suffix: str = ".json") -> int:
    """Write each text as the file of its ``name`` in ``folder``, from the tasks that hold it; a task that runs again writes the same. Their number is returned."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_output_stream(f"{base}/{own}{suffix}") as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    return texts.select(F.col(name).cast("string"), body).mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0


@dataclass(frozen=True)
class Ingested:
    """What a run found: files that no run had seen, and files that one had."""

    new: int
    skipped: int


def ingest_bytes(spark: SparkSession, folder: str, out: str, limit: int = MAX_BYTES) -> Ingested:
    """Hash the bytes of the files of ``folder`` that no earlier run with ``out`` has seen; ``out/files`` has a row for each: ``path, length, changed, status, content_hash``.

    A stream that ends when it has read what is there keeps the names of what it has read, so a second run reads nothing. A file of more than
    ``limit`` bytes is ``too_large`` and never read; one of no bytes is no document and has no row.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    status = F.when(F.col("length") > limit, "too_large").otherwise("ok")
    large = files.where(F.col("length") > limit).select("path", "length", F.col("modificationTime").alias("changed"), status.alias("status"), F.lit(None).cast("string").alias("content_hash"))
    small = files.where(F.col("length") <= limit).select("path", "length", F.col("modificationTime").alias("changed"), status.alias("status"), F.sha2("content", 256).alias("content_hash"))
    before = _known(spark, out)
    for name, rows in (("small", small), ("large", large)):
        stream = rows.writeStream.format("parquet").option("path", f"{out}/files/{name}").option("checkpointLocation", f"{out}/progress/{name}")
        stream.trigger(availableNow=True).start().awaitTermination()
    new = _known(spark, out) - before
    there = spark.read.format("binaryFile").load(folder).select("path").count()
    return Ingested(new, there - new)


def _known(spark: SparkSession, out: str) -> int:
    try:
        return ingested_files(spark, out).count()
    except AnalysisException:  # no run has been
        return 0


def ingested_files(spark: SparkSession, out: str) -> DataFrame:
    """All rows of the runs so far."""
    return spark.read.schema(SCHEMA).parquet(f"{out}/files/small").unionByName(spark.read.schema(SCHEMA).parquet(f"{out}/files/large"))
