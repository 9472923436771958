"""Bags of crops: gated attention pooling, the combined loss, and bag building as batched kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import kernels


def dot(values: Column, weights: list[float]) -> Column:
    """Inner product of an array column with fixed weights, inside generated code."""
    total = F.lit(0.0)
    for i, w in enumerate(weights):
        total = total + F.element_at(values, i + 1) * F.lit(float(w))
    return total


def attention_score(values: Column, v: list[list[float]], u: list[list[float]], w: list[float]) -> Column:
    total = F.lit(0.0)
    for row_v, row_u, weight in zip(v, u, w, strict=True):
        total = total + F.lit(float(weight)) * F.tanh(dot(values, row_v)) / (1 + F.exp(-dot(values, row_u)))
    return total


def gated_pool(crops: DataFrame, bag: str, features: str, size: int, v, u, w) -> DataFrame:
    """bag, dim, value: softmax-weighted sum of the bag's features; two aggregations, no bag is gathered.

    Scores are bounded by the sum of |w| (tanh and sigmoid are), so exp needs no shift.
    """
    weighted = crops.withColumn("_w", F.exp(attention_score(F.col(features), v, u, w)))
    sums = weighted.groupBy(bag).agg(F.sum("_w").alias("_t"), *(F.sum(F.col("_w") * F.element_at(features, i + 1)).alias(f"_s{i}") for i in range(size)))
    return sums.select(bag, F.posexplode(F.array(*(F.col(f"_s{i}") / F.col("_t") for i in range(size)))).alias("dim", "value"))


def combined_loss(rows: DataFrame, keys: list[str], item: str, logit: str, support: str, share_logit: str, truth: str, class_weight: Column, kl_weight: float = 0.5) -> DataFrame:
    """keys, kl, bce, loss of long predictions (a row for each item and class)."""
    x, y = F.col(logit), F.col(support)
    bce = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    weighted = rows.withColumn("_bce", bce * class_weight)
    norm = F.ln(F.sum(F.exp(share_logit)))
    t = F.col(truth)
    items = weighted.groupBy(*keys, item).agg((F.sum(t * (F.ln(F.greatest(t, F.lit(1e-12))) - F.col(share_logit))) + norm * F.sum(t)).alias("_kl"), F.avg("_bce").alias("_b"))
    out = items.groupBy(*keys).agg(F.avg("_kl").alias("kl"), F.avg("_b").alias("bce"))
    return out.withColumn("loss", kl_weight * F.col("kl") + (1 - kl_weight) * F.col("bce"))


def head_scores(rows: DataFrame, item: str, features: str, weights: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """item, scores: a two-layer head over feature arrays, by Arrow batches."""

    def run(batches):
        for batch in batches:
            x = np.stack(batch[features].to_list()) if len(batch) else np.zeros((0, weights[0].shape[1]))
            yield pd.DataFrame({item: batch[item], "scores": list(kernels.two_layer_head(x, *weights))})

    kind = dict(rows.dtypes)[item]
    return rows.select(item, features).mapInPandas(run, f"{item} {kind}, scores array<double>")


def build_bags(items: DataFrame, crops: int, side: int) -> DataFrame:
    """stem, condition_name, crop, y, x, data for items (stem, condition_name, code, height, width, data, ...).

    One input row is one image; kernels work row by row within a batch, and
    every filter or projection belongs before this call.
    """

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                canvas = np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, 3)
                codes = set(filter(None, r.code.split("+")))
                bag, at = kernels.build_bag(canvas, codes, crops, side, str(r.stem), (r.theta, r.length), r.side, r.alpha)
                out += [(r.stem, r.condition_name, i, y, x, bag[i].tobytes()) for i, (y, x) in enumerate(at)]
            yield pd.DataFrame(out, columns=["stem", "condition_name", "crop", "y", "x", "data"])

    return items.mapInPandas(run, "stem long, condition_name string, crop int, y int, x int, data binary")
