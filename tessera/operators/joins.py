"""Semi, anti, cross and paired joins of the evaluation and of incremental builds."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_DIMENSION = 10_000


def small(df: DataFrame) -> DataFrame:
    """A dimension of known size is broadcast; a larger one is left to the planner."""
    return F.broadcast(df) if df.limit(SMALL_DIMENSION + 1).count() <= SMALL_DIMENSION else df


def keep_available(items: DataFrame, available: DataFrame, keys: list[str]) -> DataFrame:
    """Items that exist in a listing: a semi join instead of one lookup a row."""
    return items.join(available.select(*keys), keys, "left_semi")


def not_yet_built(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items whose output is missing."""
    return items.join(done.select(*keys), keys, "left_anti")


def built_everywhere(outputs: list[DataFrame], keys: list[str]) -> DataFrame:
    """Keys that all outputs have."""
    return reduce(lambda a, b: a.intersect(b), [o.select(*keys) for o in outputs])


def paired(rows: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beside their reference row (left join: a missing reference stays null)."""
    return rows.join(reference, keys, "left")


def strict_lookup(rows: DataFrame, reference: DataFrame, keys: list[str], value: str) -> DataFrame:
    """As `paired`, but a row without a reference fails the query."""
    joined = rows.join(reference.withColumn("_found", F.lit(True)), keys, "left")
    return joined.withColumn(value, F.when(F.col("_found"), F.col(value)).otherwise(F.raise_error(F.lit("no reference row")))).drop("_found")


def with_cached(rows: DataFrame, cache: DataFrame, keys: list[str], value: str, fallback) -> DataFrame:
    """The cached value where there is one, else what `fallback` (a column) computes."""
    cached = cache.select(*keys, F.col(value).alias("_cached"))
    return rows.join(cached, keys, "left").withColumn(value, F.coalesce("_cached", fallback)).drop("_cached")


def from_caches(items: DataFrame, caches: list[DataFrame], key: str, cached: Callable, compute: Callable) -> DataFrame:
    """Results of items that all caches have by cached(items), of the others by compute(items); a column `source` says which.

    Both ways get only their own items, so that the costly one never runs for
    what the caches hold.  A cache is a table with the key column; entries of
    some caches only don't count.
    """
    held = built_everywhere(caches, [key]).distinct()
    hits, misses = items.join(held, key, "left_semi"), items.join(held, key, "left_anti")
    return cached(hits).withColumn("source", F.lit("cache")).unionByName(compute(misses).withColumn("source", F.lit("online")))


def required(rows: DataFrame, cache: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The cached value of every row; a missing one fails the query."""
    cached = cache.select(*keys, F.col(value).alias("_cached"))
    return rows.join(cached, keys, "left").withColumn(value, F.coalesce("_cached", F.raise_error(F.lit(f"{value} was not built")))).drop("_cached")


def evaluation_items(items: DataFrame, conditions: DataFrame) -> DataFrame:
    """Every item under every fixed condition; conditions is a small dimension."""
    return items.crossJoin(small(conditions))


def present_items(presence: DataFrame, keys: list[str], categories: list[str]) -> DataFrame:
    """A row for each item and category it shows: the wide manifest turned long."""
    return presence.unpivot(keys, categories, "category", "present").filter("present").drop("present")


def leaks(train: DataFrame, valid: DataFrame, keys: list[str]) -> DataFrame:
    """For each key: how many of its values both sides have."""
    counts = [train.select(k).intersect(valid.select(k)).agg(F.count(F.lit(1)).alias("shared")).select(F.lit(k).alias("what"), "shared") for k in keys]
    return reduce(DataFrame.unionByName, counts)


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values of more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
