"""Helpers that several operators share."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What separates words in the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder of ``spark.checkpoint.dir``.

    A folder of our own is set only where the session names none, as in local tests. Meant for
    narrow rows (keys, sizes, hashes); the files go when Spark cleans the checkpoint.
    """
    spark = df.sparkSession
    shared_folder(spark)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files and checkpoints that nothing refers to any more: its cleaner acts when the driver's heap is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; a local one only where master and executors are one process."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def broadcast_if_small(df: DataFrame, row_bytes: Column, limit: int = 32_000_000) -> DataFrame:
    """``df`` with a broadcast hint if its measured size is within ``limit`` bytes; else joins exchange it.

    ``df`` is read to measure it, so it should be materialised.
    """
    size = df.agg(F.coalesce(F.sum(F.coalesce(row_bytes, F.lit(0)) + 64), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= limit else df


def hash_sample(df: DataFrame, group: Column, key: Column, size: int) -> DataFrame:
    """Rows of ``df`` sampled by a hash of ``key``: all of a group, or about ``size`` where it has more.

    Only counts are gathered (one row for each group and task); a row is drawn if its hash, as a fraction of
    the hash range, is below ``size`` over its group's count. Rows with a null group are left out.
    """
    name, share = free_name(df, "group"), free_name(df, "share")
    keyed = df.withColumn(name, group).where(F.col(name).isNotNull())
    counts = materialise(keyed.groupBy(F.col(name).alias("g")).agg((F.lit(float(size)) / F.count(F.lit(1))).alias(share)))
    counts = broadcast_if_small(counts, F.octet_length(F.col("g").cast("string")))
    point = F.shiftrightunsigned(F.xxhash64(key), 11) / float(1 << 53)
    return keyed.join(counts, keyed[name] == counts["g"]).where(point < F.col(share)).select(*df.columns)


def col(name: str) -> Column:
    """A column by its whole name, whatever characters that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def words(text: Column) -> Column:
    """The words of a text as an array; a null or blank text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def map_arrow(df: DataFrame, function: Callable, schema: StructType) -> DataFrame:
    """``df.mapInArrow``, for input columns of any names: the function sees them by place."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(function, schema)


def only_columns(df: DataFrame, drop: tuple[str, ...]) -> list[str]:
    """The columns of ``df`` without those of the given names, in any case."""
    gone = {name.lower() for name in drop}
    return [c for c in df.columns if c.lower() not in gone]


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, so that callers' own columns never clash with ours."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name
