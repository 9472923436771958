"""The bag model as joins and aggregates: gated attention over crops, two heads, predictions by item.

A vector is an array column; weights are a relation (i, j, w).  A product is a
join on i and a sum by j, so it needs no Python and partial sums are added
before any shuffle.  Biases are weights of a last component that is always 1.
"""

from __future__ import annotations

import math
from itertools import accumulate, zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 64  # outputs of a product that one row holds
WEIGHTS_TO_BROADCAST = 1_000_000
TERMS, FAR = 79, 5.0  # of the series of erf, and where it is 1 to all digits


def components(rows: DataFrame, keys: list[str], vector: str, bias: bool = True) -> DataFrame:
    """keys, i, x of an array column; bias: continued by a component 1.  Null vectors give no row."""
    return rows.select(*keys, F.posexplode(F.concat(vector, F.array(F.lit(1.0))) if bias else F.col(vector)).alias("i", "x"))


def product(rows: DataFrame, keys: list[str], weights: DataFrame) -> DataFrame:
    """keys, y (an array over j): the product of vectors (keys, i, x) with weights (i, j, w); absent weights are 0.

    Outputs beyond TILE are summed in tiles.  Weights are broadcast only where
    they are few (WEIGHTS_TO_BROADCAST).
    """
    size, width = weights.agg(F.count(F.lit(1)), F.coalesce(F.max("j"), F.lit(-1)) + 1).first()
    across = int(min(max(width, 1), TILE))
    packed = weights.groupBy("i", F.floor(F.col("j") / TILE).alias("tile")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("j") % TILE).cast("int").alias("k"), F.col("w").cast("double").alias("v")))).alias("m"))
    wide = packed.select(F.col("i").cast("int").alias("i"), "tile", F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("ws"))
    met = rows.join(F.broadcast(wide) if size <= WEIGHTS_TO_BROADCAST else wide, "i")
    sums = met.groupBy(*keys, "tile").agg(*(F.expr(f"sum(x * get(ws, {k})) AS s{k}") for k in range(across)))
    tiles = sums.select(*keys, "tile", F.expr(f"array({', '.join(f's{k}' for k in range(across))}) AS y"))
    if width <= TILE:
        return tiles.drop("tile")
    ordered = F.array_sort(F.collect_list(F.struct("tile", "y")))
    return tiles.groupBy(*keys).agg(F.slice(F.flatten(F.transform(ordered, lambda t: t["y"])), 1, int(width)).alias("y"))


def with_gelu(rows: DataFrame, value: str) -> DataFrame:
    """rows with value -> value * Phi(value); the error function by Kummer's series, whose terms are all positive."""
    steps = [f"greatest(least({value} / sqrt(2D), {FAR!r}D), -{FAR!r}D) AS _z", "2 * _z * _z AS _q0"]  # each may use those before it
    series = [f"{x!r}D" for x in accumulate(range(1, TERMS + 1), lambda c, n: c / (2 * n + 1), initial=1.0)]
    for k in range(TERMS.bit_length()):  # neighbours are joined by ever higher powers, so the expression stays flat
        series = [f"({low} + {high} * _q{k})" for low, high in zip_longest(series[::2], series[1::2], fillvalue="0D")]
        steps.append(f"_q{k} * _q{k} AS _q{k + 1}")
    erf = f"2 / sqrt(pi()) * _z * exp(-_z * _z) * {series[0]}"
    names = [step.split(" AS ")[1] for step in steps]
    return rows.selectExpr("*", *steps).withColumn(value, F.expr(f"0.5D * {value} * (1 + {erf})")).drop(*names)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def softmax(values: Column) -> Column:
    """Shares of an array of logits."""
    shifted = F.transform(values, lambda v: F.exp(v - F.array_max(values)))
    return F.transform(shifted, lambda v: v / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def attention_pool(crops: DataFrame, keys: list[str], crop: str, features: str, size: int, gate: DataFrame, out: list[float]) -> DataFrame:
    """keys, pooled: the attention-weighted sum of each bag's feature vectors (arrays of `size`).

    gate holds the weights of both branches: outputs 0..h-1 go through tanh,
    h..2h-1 through a sigmoid; out are the h weights of a crop's score.  Scores
    are bounded by the sum of |out|, so exp needs no shift.
    """
    h = len(out)
    gated = product(components(crops, [*keys, crop], features), [*keys, crop], gate)
    score = " + ".join(f"{float(w)!r}D * tanh(get(y, {k})) / (1 + exp(-get(y, {h + k})))" for k, w in enumerate(out))
    weighted = crops.join(gated.select(*keys, crop, F.expr(f"exp({score}) AS _w")), [*keys, crop])
    sums = weighted.groupBy(*keys).agg(F.sum("_w").alias("_t"), *(F.expr(f"sum(_w * get({features}, {i})) AS _s{i}") for i in range(size)))
    return sums.select(*keys, F.expr(f"array({', '.join(f'_s{i} / _t' for i in range(size))}) AS pooled"))


def predict(pooled: DataFrame, keys: list[str], hidden: DataFrame, last: DataFrame, classes: int) -> DataFrame:
    """keys, cls_logit, reg_logit, cls_prob, reg_prob (arrays over the classes) of pooled vectors.

    Two heads of two layers with a GELU between; both heads stand in one pair
    of weight relations: outputs 0..classes-1 of `last` are the presence
    logits (sigmoid), the next as many the share logits (softmax).
    """
    inner = product(components(pooled, keys, "pooled"), keys, hidden).withColumn("_n", F.size("y"))
    active = with_gelu(components(inner, [*keys, "_n"], "y").withColumn("_g", F.col("x")), "_g")
    active = active.select(*keys, "i", F.when(F.col("i") < F.col("_n"), F.col("_g")).otherwise(F.col("x")).alias("x"))  # the bias stays 1
    logits = product(active, keys, last).select(*keys, F.slice("y", 1, classes).alias("cls_logit"), F.slice("y", classes + 1, classes).alias("reg_logit"))
    return logits.select("*", F.transform("cls_logit", sigmoid).alias("cls_prob"), softmax(F.col("reg_logit")).alias("reg_prob"))


def by_class(predictions: DataFrame, keys: list[str], digits: int = 9) -> DataFrame:
    """keys, class, t, p, r, x, s: one row for each class of predictions with habitat, probabilities and logits as arrays.

    Probabilities are rounded, so that what differs in the last bits ties.
    """
    zipped = F.arrays_zip(F.col("habitat").alias("t"), F.col("cls_prob").alias("p"), F.col("reg_prob").alias("r"), F.col("cls_logit").alias("x"), F.col("reg_logit").alias("s"))
    long = predictions.select(*keys, F.posexplode(zipped).alias("class", "_v"))
    return long.select(*keys, "class", "_v.t", F.round("_v.p", digits).alias("p"), F.round("_v.r", digits).alias("r"), "_v.x", "_v.s")
