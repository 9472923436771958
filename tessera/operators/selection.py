"""Exact order statistics by refined histograms: values at wanted ranks, medians, matching by rank.

A key's values are counted in bars between its smallest and largest one.  A
wanted rank falls into one bar, whose own smallest and largest value span the
bars of the next step, until a bar holds few rows, one value, or ends at the rank.
Only rows of such bars are looked at again, so nothing sorts more than LEAF rows of a key.

Tables of ranks and bars are small files of many rows, so joins with them are
hinted: by its file's size each would be broadcast whole through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.streaming.events import folder

BARS, LEAF = 1024, 4096  # bars of a histogram; rows of a bar that are numbered in their order
_RANK, _BAR = 0, 1


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bar(x: Column, low: Column, high: Column) -> Column:
    """Which of BARS equal parts of low..high holds x; low and high differ in any case get different ones."""
    part = F.floor((x - low).cast("double") / (high - low).cast("double") * BARS)
    return F.when(low == high, F.lit(0)).otherwise(F.least(F.greatest(part, F.lit(0)), F.lit(BARS - 1))).cast("int")


def barred(values: DataFrame, key: str, value: str) -> DataFrame:
    """values with _bar, the bar of the row's value among those of its key; a table."""
    ends = values.groupBy(F.col(key).alias("_k")).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    met = values.join(ends, F.col(key).eqNullSafe(F.col("_k")))
    return stored(met.select(*values.columns, _bar(F.col(value), F.col("_low"), F.col("_high")).alias("_bar")), "barred")


def _heights(rows: DataFrame, by: list[str], bar: str, at: Column) -> DataFrame:
    """by, bar, n, low, high, before: rows of each bar, its ends, and rows of the bars below."""
    counted = rows.groupBy(*by, bar).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("low"), F.max(at).alias("high"))
    below = W.partitionBy(*by).orderBy(bar).rowsBetween(W.unboundedPreceding, -1)  # BARS rows at most
    return counted.withColumn("before", F.coalesce(F.sum("n").over(below), F.lit(0)))


def _placed(ranks: DataFrame, heights: DataFrame, by: list[str], bar: str) -> DataFrame:
    """ranks (by, rank, ...) with the bar that each falls into, its n, low, high and before.

    Ranks and bars are laid in one order, so that a rank finds the next bar's
    end without meeting all bars of its key.
    """
    held = F.struct(F.col(bar).alias("bar"), "n", "low", "high", "before")
    ends = heights.select(*by, (F.col("before") + F.col("n")).alias("_at"), F.lit(_BAR).alias("_kind"), held.alias("_held"))
    asked = ranks.select(*by, F.col("rank").cast("long").alias("_at"), F.lit(_RANK).alias("_kind"), F.struct(*ranks.columns).alias("_asked"))
    next_bar = F.last("_held", ignorenulls=True).over(W.partitionBy(*by).orderBy(F.desc("_at"), F.desc("_kind")).rowsBetween(W.unboundedPreceding, 0))
    laid = asked.unionByName(ends, allowMissingColumns=True).withColumn("_next", next_bar)
    return laid.filter((F.col("_kind") == _RANK) & F.col("_next").isNotNull()).select("_asked.*", "_next.*")


def at_ranks(rows: DataFrame, key: str, value: str, tie: str, wanted: DataFrame) -> DataFrame:
    """key, rank, bound (value, tie): what stands at the wanted ranks (key, rank from 1) of each key by value, then tie.

    rows come from `barred`; tie is an integer.  Ranks beyond a key's rows have no row.
    """
    at = F.struct(F.col(value).alias("value"), F.col(tie).cast("long").alias("tie"))
    spots = _placed(wanted.select(key, "rank").distinct(), _heights(rows, [key], "_bar", at), [key], "_bar")
    spots = stored(spots.select(key, "rank", F.col("bar").alias("first_bar"), F.col("low").alias("cell"), "n", "low", "high", (F.col("rank") - F.col("before")).alias("inside")), "spots")
    found = None
    while True:
        closed = (F.col("inside") == F.col("n")) | (F.col("low") == F.col("high"))
        done = spots.filter(closed).select(key, "rank", F.col("high").alias("bound"))
        found = done if found is None else found.unionByName(done)
        left, few = spots.filter(~closed), F.col("n") <= LEAF

        def inside(spots):
            """Rows of the spots' bars, with the bar's first bar and ends."""
            cells = spots.select(F.col(key).alias("_k"), F.col("first_bar").alias("_first"), F.col("low").alias("_low"), F.col("high").alias("_high")).distinct()
            return rows.join(cells.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_bar") == F.col("_first")) & (at >= F.col("_low")) & (at <= F.col("_high")))

        number = F.row_number().over(W.partitionBy(key, "_first", "_low").orderBy(value, tie))  # LEAF rows at most
        numbered = inside(left.filter(few)).select(F.col(key).alias("_k"), "_first", "_low", at.alias("bound"), number.alias("_number"))
        same = F.col(key).eqNullSafe(F.col("_k")) & (F.col("first_bar") == F.col("_first")) & (F.col("low") == F.col("_low")) & (F.col("inside") == F.col("_number"))
        found = found.unionByName(left.filter(few).hint("shuffle_hash").join(numbered, same).select(key, "rank", "bound"))
        left = left.filter(~few)
        if not left.limit(1).count():
            return found
        met = inside(left)
        by_value = F.col("_low.value") < F.col("_high.value")
        finer = F.when(by_value, _bar(F.col(value), F.col("_low.value"), F.col("_high.value"))).otherwise(_bar(F.col(tie).cast("long"), F.col("_low.tie"), F.col("_high.tie")))
        heights = _heights(met.select(key, F.col("_first").alias("first_bar"), F.col("_low").alias("cell"), value, tie, finer.alias("_finer")), [key, "first_bar", "cell"], "_finer", at)
        asked = left.select(key, "first_bar", F.col("low").alias("cell"), F.col("inside").alias("rank"), F.col("rank").alias("whole"))
        next_spots = _placed(asked, heights, [key, "first_bar", "cell"], "_finer")
        spots = stored(next_spots.select(key, F.col("whole").alias("rank"), "first_bar", "cell", "n", "low", "high", (F.col("rank") - F.col("before")).alias("inside")), "spots")


def medians(values: DataFrame, key: str, value: str) -> DataFrame:
    """key, median: exact, the mean of the two middle values where they are two; nulls don't count."""
    rows = barred(values.filter(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias(value), F.lit(0).alias("_tie")), key, value)
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    middle = n.select(key, F.explode(F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1)).alias("rank"))
    return at_ranks(rows, key, value, "_tie", middle).groupBy(key).agg(F.avg("bound.value").alias("median"))


def matched_bins(values: DataFrame, counts: DataFrame, key: str, value: str, tie: str) -> DataFrame:
    """values with bin: bins hold exactly the counts (key, bin, n), in order of value, then tie (an integer).

    Keys of up to LEAF rows are numbered in order, and a row's number is looked
    up in the list of the key's bins; larger keys go by bars (`_binned_by_bars`).
    Values must not be null or NaN; rows without a key have no bins and are left out.
    """
    values = values.filter(F.col(key).isNotNull())
    of_key = W.partitionBy(key)
    ends = counts.filter((F.col("n") > 0) & F.col(key).isNotNull()).select(key, "bin", "n", F.sum("n").over(of_key.orderBy("bin")).alias("rank"), F.sum("n").over(of_key).alias("_total"))  # one row a bin
    ends = stored(ends, "ends")
    many = ends.filter(F.col("_total") > LEAF)
    large = many.select(F.col(key).alias("_k")).distinct()  # under a row in LEAF
    any_large = bool(many.limit(1).count())
    small = values.join(large, F.col(key) == F.col("_k"), "left_anti") if any_large else values
    repeated = F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda x: F.array_repeat(x["bin"], x["n"].cast("int")))
    lists = ends.filter(F.col("_total") <= LEAF).groupBy(F.col(key).alias("_k")).agg(F.flatten(repeated).alias("_bins"))
    numbered = small.withColumn("_number", F.row_number().over(of_key.orderBy(value, tie)))  # LEAF rows at most
    met = numbered.join(lists.hint("merge"), F.col(key) == F.col("_k")).select(*values.columns, F.get("_bins", F.col("_number") - 1).alias("bin"))
    if not any_large:
        return met
    return met.unionByName(_binned_by_bars(values.join(large, F.col(key) == F.col("_k"), "left_semi"), many.select(key, "bin", "rank"), key, value, tie))


def _binned_by_bars(values: DataFrame, ends: DataFrame, key: str, value: str, tie: str) -> DataFrame:
    """`matched_bins` for large keys; ends: key, bin and the rank of its last row, a table.

    The last row of each bin is found by rank.  A bar of values that no bin
    ends in gives its rows their bin by a lookup; the rows of other bars are
    compared with the ends inside.
    """
    rows = barred(values, key, value)
    at = F.struct(F.col(value).alias("value"), F.col(tie).cast("long").alias("tie"))
    bounds = ends.hint("shuffle_hash").join(at_ranks(rows, key, value, tie, ends), [key, "rank"]).select(key, "bin", "rank", "bound")
    bars = _heights(rows, [key], "_bar", at)
    # Bars and ends in one order: an end lies in the next bar, a bar's last rows belong to the next end.
    laid = bars.select(key, (F.col("before") + F.col("n")).alias("_at"), F.lit(_BAR).alias("_kind"), F.col("_bar").alias("bar"))
    laid = bounds.select(key, F.col("rank").alias("_at"), F.lit(_RANK).alias("_kind"), "bin", "bound").unionByName(laid, allowMissingColumns=True)
    on = W.partitionBy(key).orderBy(F.desc("_at"), F.desc("_kind")).rowsBetween(W.unboundedPreceding, 0)
    laid = laid.withColumn("bar", F.last("bar", ignorenulls=True).over(on)).withColumn("after", F.last("bin", ignorenulls=True).over(on))
    inner = F.array_sort(F.collect_list(F.when(F.col("_kind") == _RANK, F.struct("bound", "bin"))))
    of_bar = laid.groupBy(F.col(key).alias("_k"), F.col("bar").alias("_b")).agg(inner.alias("_inner"), F.max(F.when(F.col("_kind") == _BAR, F.col("after"))).alias("_after"))
    met = rows.join(of_bar.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_bar") == F.col("_b")))
    own = F.get(F.filter("_inner", lambda x: x["bound"] >= at), F.lit(0))["bin"]
    return met.select(*values.columns, F.when(F.size("_inner") == 0, F.col("_after")).otherwise(F.coalesce(own, "_after")).alias("bin"))
