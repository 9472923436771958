"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset and Spark is local (tests) a folder of our own, one for each application."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        folder = _own.get(app) or _own.setdefault(app, tempfile.mkdtemp(prefix="tessera-"))
    return folder.rstrip("/")


def written(df: DataFrame, name: str, compact: bool = False, partition_by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: a lost executor costs no recomputation.

    compact: many tasks give few rows each, so they are rebalanced into few files first.
    partition_by: a column of few values, so that filters on it open only its files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = (df.hint("rebalance") if compact else df).write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as make it none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts can be long: 10000 of them (Spark's default) would be too much for one Arrow batch."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting, "10000") == "10000":
        spark.conf.set(setting, "1000")


def doc_text(df: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text as string, with no other column but `more`: clashing names can't arise."""
    small_batches(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
