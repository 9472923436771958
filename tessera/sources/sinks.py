"""Writers: tables, summaries, resumable appends and small JSON files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Parquet with zstd; a `view` partition column stands for view-wise directories."""
    df.write.mode(mode).option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def write_summary(df: DataFrame, path: str) -> None:
    """One CSV file with a header: summaries have a row a condition."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, in whatever store it names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append_missing(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys the table at path lacks: run again after a failure, it adds what is left."""
    if exists(df.sparkSession, path):
        df = df.join(df.sparkSession.read.parquet(path).select(*keys), keys, "left_anti")
    df.write.mode("append").parquet(path)


def reuse_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at path, built first if it is missing."""
    if not exists(spark, path):
        build().write.parquet(path)
    return spark.read.parquet(path)


def write_json(values: dict, path: str | Path) -> None:
    """A resolved configuration or a manifest (a driver-side file)."""
    Path(path).write_text(json.dumps(values, indent=2, sort_keys=True, default=str))


def latest_state(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest readable version `v=<n>` of a state table; an unreadable one counts as absent."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    store = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(base):
        return None
    names = [s.getPath().getName() for s in store.listStatus(base)]
    for name in sorted((n for n in names if n.startswith("v=")), key=lambda n: -int(n[2:])):
        if store.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/_SUCCESS")):
            return spark.read.parquet(f"{root}/{name}")
    return None
