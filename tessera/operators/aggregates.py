"""Aggregations: prevalence, population statistics, densities, conditional and zero-filled statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .selection import medians


def normalised(values: Column) -> Column:
    """An array divided by its sum; sums under 1e-12 divide by 1."""
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    divisor = F.when(total < 1e-12, F.lit(1.0)).otherwise(total)
    return F.transform(values, lambda x: x / divisor)


def class_prevalence(df: DataFrame, values: str) -> DataFrame:
    """class, prevalence: the share of rows whose value of the class is positive."""
    return df.select(F.posexplode(values).alias("class", "v")).groupBy("class").agg(F.avg((F.col("v") > 0).cast("double")).alias("prevalence"))


def class_weights(prevalence: DataFrame) -> DataFrame:
    """class, weight: inverse frequencies (at least 1e-6), scaled to mean 1; one row a class."""
    w = prevalence.withColumn("w", 1 / F.greatest(F.col("prevalence"), F.lit(1e-6)))
    return w.select("class", (F.col("w") / F.avg("w").over(W.partitionBy())).alias("weight"))


def population_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def weighted_population(stats: DataFrame, by_size: bool) -> DataFrame:
    """M and S: means of the specimens' means and deviations, each specimen alike or by its pixels."""
    w = F.col("n") if by_size else F.lit(1)
    return stats.agg((F.sum(w * F.col("mean")) / F.sum(w)).alias("M"), (F.sum(w * F.col("std")) / F.sum(w)).alias("S"))


def bin_of(value: Column, bins: int, top: float) -> Column:
    """Half-even rounding to one of `bins` steps up to `top`."""
    return F.greatest(F.least(F.rint(value / F.lit(top / (bins - 1))), F.lit(float(bins - 1))), F.lit(0.0)).cast("int")


def histograms(df: DataFrame, key: str, value: str, bins: int, top: float) -> DataFrame:
    return df.groupBy(key, bin_of(F.col(value), bins, top).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def target_density(hist: DataFrame, key: str) -> DataFrame:
    """bin, density: mean of the specimens' densities, summing to 1.  Specimens count alike."""
    sizes = hist.groupBy(key).agg(F.sum("n").alias("size"))
    summed = hist.join(sizes.hint("shuffle_hash"), key).groupBy("bin").agg(F.sum(F.col("n") / F.col("size")).alias("d"))
    return summed.select("bin", (F.col("d") / F.sum("d").over(W.partitionBy())).alias("density"))


def density_moments(density: DataFrame, bins: int, top: float) -> DataFrame:
    """mean, std of the density, and what stands in its end bins."""
    v = F.col("bin") * F.lit(top / (bins - 1))
    m = density.agg(F.sum(v * F.col("density")).alias("mean"), F.sum(v * v * F.col("density")).alias("square"), F.sum(F.when(F.col("bin") == 0, F.col("density")).otherwise(0.0)).alias("atom_low"), F.sum(F.when(F.col("bin") == bins - 1, F.col("density")).otherwise(0.0)).alias("atom_high"))
    return m.select("mean", F.sqrt(F.col("square") - F.col("mean") * F.col("mean")).alias("std"), "atom_low", "atom_high")


def conditional_stats(df: DataFrame, key: str, value: str, condition: Column, threshold: float) -> DataFrame:
    """Mean, exact median and share over a threshold among rows that meet the condition; null if none does."""
    v = F.when(condition, F.col(value))
    sums = df.groupBy(key).agg(F.count(v).alias("n_met"), F.avg(v).alias("mean_met"), F.avg((v > threshold).cast("double")).alias("share_over"), F.avg(condition.cast("double")).alias("share_met"))
    middle = medians(df.filter(condition).select(key, value), key, value).withColumnRenamed("median", "median_met")
    return sums.join(middle, key, "left")


def population_pixels(stats: DataFrame, key: str, size: str) -> DataFrame:
    """n_specimens, min_pixels, median_pixels, max_pixels, distinct_pixels of per-specimen counts; the median is selected, not sorted."""
    whole = stats.agg(F.count_distinct(key).alias("n_specimens"), F.count_distinct(size).alias("distinct_pixels"), F.min(size).alias("min_pixels"), F.max(size).alias("max_pixels"))
    middle = medians(stats.select(F.lit(0).alias("_all"), size), "_all", size).select(F.col("median").alias("median_pixels"))
    return whole.join(middle, how="cross")  # one row each


def vector_sum(rows: DataFrame, vector: str, weight: str, size: int) -> DataFrame:
    """place, total: the weighted sum of array rows of `size`; a task adds its own rows, and only its sums are shuffled."""

    def add(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                flat = pc.list_flatten(batch.column(0)).to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
                total += batch.column(1).to_numpy(zero_copy_only=False) @ flat
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["place", "part"])

    held = rows.filter(F.col(vector).isNotNull() & F.col(weight).isNotNull()).select(F.col(vector).cast("array<double>"), F.col(weight).cast("double"))
    return held.mapInArrow(add, "place int, part double").groupBy("place").agg(F.sum("part").alias("total"))


def weighted_density(counts: DataFrame, key: str, bins: int, by_size: bool) -> DataFrame:
    """bin, density of histograms (key, bin, n): each specimen alike, or by its pixels; sums to 1."""
    sized = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.sum("n").cast("double").alias("size"))
    share = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0)) / F.col("size"))
    total = vector_sum(sized.select(share.alias("share"), (F.col("size") if by_size else F.lit(1.0)).alias("weight")), "share", "weight", bins)
    return total.filter("total > 0").select(F.col("place").alias("bin"), (F.col("total") / F.sum("total").over(W.partitionBy())).alias("density"))  # one row a bin


def zero_filled(df: DataFrame, key: str, category: str, categories: DataFrame) -> DataFrame:
    """key, category, n, share for every category of a small dimension, also those without rows."""
    counts = df.groupBy(key, category).agg(F.count(F.lit(1)).alias("n"))
    grid = df.select(key).distinct().crossJoin(F.broadcast(categories))
    filled = grid.join(counts, [key, category], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(key)))


def bench_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """mean, median, sample deviation (0 of a single row), min and max."""
    return df.groupBy(key).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def mean_of_means(df: DataFrame, keys: list[str], batch: str, value: str) -> DataFrame:
    """The mean of batch means: a short last batch counts as much as a full one."""
    return df.groupBy(*keys, batch).agg(F.avg(value).alias("m")).groupBy(*keys).agg(F.avg("m").alias("mean_of_means"), F.count(F.lit(1)).alias("batches"))


def bounding_box(df: DataFrame, key: str, y: str, x: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(y).alias("y0"), F.max(y).alias("y1"), F.min(x).alias("x0"), F.max(x).alias("x1"))


def radial_profile(df: DataFrame, key: str, radius: str, magnitude: str) -> DataFrame:
    return df.groupBy(key, radius).agg(F.avg(magnitude).alias("profile"))


def loglog_slope(profile: DataFrame, key: str, radius: str, low: float, high: float) -> DataFrame:
    """Negated least-squares slope of log profile by log radius within the band; NaN without energy in it."""
    inside = (F.col(radius) >= low) & (F.col(radius) <= high) & (F.col("profile") > 0)
    y, x = F.when(inside, F.ln("profile")), F.when(inside, F.ln(radius))
    return profile.groupBy(key).agg(F.coalesce(-F.regr_slope(y, x), F.lit(float("nan"))).alias("alpha"))
