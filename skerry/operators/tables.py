"""Small helpers on DataFrames shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    What several branches of a plan read is computed once, the plans stay
    small, a lost executor doesn't bring back the work before, and Spark
    knows the table's exact size: it broadcasts the table by itself if that is
    below its threshold, and shuffles it otherwise. The folder is
    ``spark.checkpoint.dir``; only on a single machine a local one is used
    where that is unset.
    Streams are returned as they are.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _OWN.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='skerry-')}")
    path = f"{base.rstrip('/')}/skerry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its files give fewer partitions than there are
    cores (a small table in one row group); tables of many splits stay as they are."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bound_batches(spark: SparkSession, rows: int = 1024, size: int = 32 << 20) -> None:
    """Arrow batches of at most ``rows`` rows and ``size`` bytes, for rows that
    hold whole texts. A plan reads the settings when it is run, so they stay
    set for the session; smaller ones are left as they are."""
    for name, bound in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", rows),
        ("spark.sql.execution.arrow.maxBytesPerBatch", size),
    ):
        now = spark.conf.get(name).rstrip("b")  # "256MB" and the like are set anew
        if not (now.isdigit() and 0 < int(now) <= bound):
            spark.conf.set(name, str(bound))


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank", top: int | None = None) -> DataFrame:
    """Rank from 1 inside the groups ``by``; with ``top`` only the first ones,
    which Spark limits per task before it shuffles."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if top is None else out.where(F.col(name) <= top)


def by_score(*ties: str) -> list[Column]:
    return [F.desc("score"), *(F.col(t) for t in ties)]
