"""Ordered operators: trailing means, recursive averages by scan, early stopping, apportionment, top-k."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .selection import stored


def trailing_mean(df: DataFrame, key: str, order: str, value: str, n: int) -> DataFrame:
    w = W.partitionBy(key).orderBy(order).rowsBetween(-(n - 1), 0)
    return df.withColumn("trailing", F.avg(value).over(w))


def moving_average(df: DataFrame, key: str, order: str, value: str, decay: float, blocks: int | None = None) -> DataFrame:
    """key, order, value, ema, place with ema = decay * before + (1 - decay) * value, first = value; place counts from 1.

    An associative scan: a step is an affine map of what came before, and so is
    a block of steps.  Rows are dealt by ranges of (key, order) into blocks; a
    block folds its own steps as if 0 came before, the blocks' maps are folded
    in order (one row a block and key), and what came before a block enters
    its rows as decay ** steps * before.  No task holds a whole series.

    A null value leaves the average as it is (null before the first value).
    """
    blocks = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(key, order, F.col(value).cast("double").alias(value)).repartitionByRange(blocks, key, order).sortWithinPartitions(key, order, value)
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
    base = f"{key} {kinds[key]}, {order} {kinds[order]}, {value} double"

    def fold(batches):
        block, now, local, steps, place = TaskContext.get().partitionId(), object(), 0.0, 0, 0
        for batch in batches:
            out = []
            for k, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != now:
                    now, local, steps, place = k, 0.0, 0, 0
                place += 1
                if x is not None:
                    local, steps = decay * local + (1 - decay) * x, steps + 1
                out.append((block, local, steps, place))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            new = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "_block", "_local", "_steps", "_place"])

    rows = stored(dealt.mapInArrow(fold, f"{base}, _block int, _local double, _steps long, _place long"), "scan")
    last = rows.groupBy(F.col(key).alias("_k"), "_block").agg(F.max_by("_local", "_place").alias("_local"), F.max("_steps").alias("_steps"), F.max("_place").alias("_rows"), F.min_by(value, F.when(F.col(value).isNotNull(), F.col("_place"))).alias("_first"))

    def across(batches):
        now, before, offset = object(), None, 0
        for batch in batches:
            out = []
            for k, _, local, steps, n, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != now:
                    now, before, offset = k, None, 0
                known = before is not None
                before = before if known else first  # the first value stands for what came before it
                out.append((before, known, offset))
                before = None if before is None else local + decay**steps * before
                offset += n
            columns = list(zip(*out, strict=True)) if out else [[]] * 3
            new = [pa.array(c, t) for c, t in zip(columns, (pa.float64(), pa.bool_(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], names=["_k", "_b", "_before", "_known", "_offset"])

    maps = last.repartition("_k").sortWithinPartitions("_k", "_block").mapInArrow(across, f"_k {kinds[key]}, _b int, _before double, _known boolean, _offset long")
    met = rows.join(maps, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b")))
    ema = F.when((F.col("_steps") > 0) | F.col("_known"), F.col("_local") + F.pow(F.lit(decay), F.col("_steps")) * F.col("_before"))
    return met.select(key, order, value, ema.alias("ema"), (F.col("_place") + F.col("_offset")).alias("place"))


def balanced_weights(averages: DataFrame, key: str, order: str, terms: tuple[str, str], lag: int, temperature: float, band: tuple[float, float]) -> DataFrame:
    """order, weight_a, weight_b: two-term softmax of the lagged ratios, within the band; 0.5 until the lag is filled.

    averages come from `moving_average`: the value `lag` places before is found by a join on places.
    """
    earlier = averages.select(F.col(key).alias("_k"), (F.col("place") + lag).alias("_p"), F.col("ema").alias("_ema"))
    ratios = averages.join(earlier, (F.col(key) == F.col("_k")) & (F.col("place") == F.col("_p")), "left").withColumn("ratio", F.col("ema") / F.col("_ema"))
    wide = ratios.groupBy(order).agg(*(F.max(F.when(F.col(key) == t, F.col("ratio"))).alias(n) for t, n in zip(terms, "ab", strict=True)), F.count(F.lit(1)).alias("terms"))
    soft = 1 / (1 + F.exp(-(F.col("a") - F.col("b")) / temperature))
    a = F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(0.5)).otherwise(F.least(F.greatest(soft, F.lit(band[0])), F.lit(band[1])))
    return wide.select(order, a.alias("weight_a"), (1 - a).alias("weight_b"))


def early_stop(df: DataFrame, key: str, order: str, value: str, patience: int) -> DataFrame:
    """Rows up to the stop, with is_best (strictly below all before) and stale (rows since the best)."""
    w = W.partitionBy(key).orderBy(order)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    best = df.withColumn("is_best", F.coalesce(F.col(value) < F.min(value).over(before), F.lit(True)))
    placed = best.withColumn("n", F.row_number().over(w))
    stale = placed.withColumn("stale", F.col("n") - F.max(F.when(F.col("is_best"), F.col("n"))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    stopped = stale.withColumn("stops", F.coalesce(F.max((F.col("stale") >= patience).cast("int")).over(before), F.lit(0)))
    return stopped.filter("stops = 0").drop("stops", "n")


def apportion(density: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """key, bin, n: whole counts that sum to each total, by largest remainder (ties to the lower bin)."""
    exact = totals.crossJoin(F.broadcast(density)).withColumn("exact", F.col("density") * F.col("total")).withColumn("base", F.floor("exact"))
    w = W.partitionBy(key)
    ranked = exact.withColumn("short", F.col("total") - F.sum("base").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), "bin")))
    return ranked.select(key, "bin", (F.col("base") + F.when(F.col("place") <= F.col("short"), 1).otherwise(0)).alias("n"))


def permute_blocks(pixels: DataFrame, keys: list[str], crop: int, side: int, drawn: Callable[[Column], Column]) -> DataFrame:
    """pixels (keys, y, x) of full crops with the blocks of side x side in the order of drawn(block); other crops stay.

    Blocks keep their inside; the multiset of pixels of a crop stays.
    """
    across = crop // side
    full = pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == crop * crop).drop("_n")
    blocks = full.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(across * across - 1)))).withColumn("_h", drawn(F.col("_b")))
    placed = blocks.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy("_h", "_b")) - 1).drop("_h")
    own = (F.floor(F.col("y") / side) * across + F.floor(F.col("x") / side)).cast("int")
    moved = pixels.withColumn("_b", own).join(placed, [*keys, "_b"], "left")
    to = lambda c, block: F.coalesce(block * side + F.col(c) % side, F.col(c))
    return moved.withColumns({"y": to("y", F.floor(F.col("_place") / across)), "x": to("x", F.col("_place") % across)}).drop("_b", "_place")


def one_per_cell(candidates: DataFrame, key: str, cell: str, seed: Column, n: int) -> DataFrame:
    """Up to n positions a key: one candidate of each grid cell, cells and candidates in order of keyed draws."""
    drawn = candidates.withColumn("_h", seed)
    first = drawn.withColumn("_r", F.row_number().over(W.partitionBy(key, cell).orderBy("_h", "cand"))).filter("_r = 1")
    return first.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("_h", cell))).filter(F.col("place") <= n).drop("_h", "_r")


def top2_margin(values: Column) -> Column:
    ordered = F.sort_array(values, asc=False)
    return F.element_at(ordered, 1) - F.element_at(ordered, 2)


def argmax(values: Column) -> Column:
    """Place of the largest value, from 0; the first of equals."""
    return F.array_position(values, F.array_max(values)) - 1
