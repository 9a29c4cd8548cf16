"""Reading the input tables and keeping intermediate results."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data folder; columns and filters are pushed into the scan by Catalyst."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where that is unset, a local folder serves a session on one
    machine, as in tests; on a cluster it is an error."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="corrobora-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Writes a result as a table in the shared folder and reads it from there, so that lost executors cost nothing. (A
    checkpoint would compute its last stage twice.)"""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """As cut(), with counts of its rows, taken while they are written."""
    seen = Observation()
    out = cut(df.observe(seen, *[F.count_if(c).alias(n) for n, c in counts.items()]))
    return out, seen.get


def release(spark: SparkSession) -> None:
    """Lets the driver forget finished rounds: their plans and compiled classes are collected, their shuffles and broadcasts removed."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut_by(df: DataFrame, *columns: str) -> DataFrame:
    """As cut(), dealt by the columns and sorted by them, in a way that later groupings and windows over them see.

    (A plan that ran adaptively doesn't tell its partitioning after a checkpoint, so this one runs without.)
    """
    spark = df.sparkSession
    shared_dir(spark)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *columns).sortWithinPartitions(*columns).checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
