"""Rank metrics, divergences, paired errors, cluster bootstrap, and combination over folds.

Predictions are long: one row for each item and class.  Scores are grouped
before any ordering, and running totals go over score buckets first, so no
task orders all rows of a class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 256
ROWS_AT_ONCE = 2048  # cells of a bucket that meet all replicates together


def _bucket(score: str, buckets: int = BUCKETS) -> Column:
    return F.floor(F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0)) * buckets)


def running_totals(df: DataFrame, keys: list[str], score: str, values: list[str], descending: bool = False) -> DataFrame:
    """df (one row a key and score) with before_<v>: the sum of v over rows of the key that come before by score.

    Totals of score buckets are small and cumulated first; within a bucket the
    order is local.  Scores outside 0..1 share the outer buckets.
    """
    spaced = df.withColumn("_b", _bucket(score))
    way = F.desc if descending else F.asc
    totals = spaced.groupBy(*keys, "_b").agg(*(F.sum(v).alias(f"_t_{v}") for v in values))
    across = W.partitionBy(*keys).orderBy(way("_b")).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_b", *(F.coalesce(F.sum(f"_t_{v}").over(across), F.lit(0)).alias(f"_o_{v}") for v in values))
    inside = W.partitionBy(*keys, "_b").orderBy(way(score)).rowsBetween(W.unboundedPreceding, -1)
    joined = spaced.join(offsets, [*keys, "_b"])
    return joined.select(*df.columns, *((F.col(f"_o_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(f"before_{v}") for v in values))


def class_auc(df: DataFrame, keys: list[str], score: str, positive: str = "positive", negative: str = "negative") -> DataFrame:
    """keys, auc: area under the ROC curve with mid-ranks for ties; positive and negative are weights of a row.

    Keys with one outcome only have no row.
    """
    grouped = df.groupBy(*keys, score).agg(F.sum(positive).alias("pos"), F.sum(negative).alias("neg"))
    ranked = running_totals(grouped, keys, score, ["neg"])
    sums = ranked.groupBy(*keys).agg(F.sum(F.col("pos") * (2 * F.col("before_neg") + F.col("neg"))).alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.filter("p > 0 AND n > 0").select(*keys, (F.col("wins").cast("double") / (2 * F.col("p") * F.col("n")).cast("double")).alias("auc"))


def class_ap(df: DataFrame, keys: list[str], score: str, positive: str = "positive", negative: str = "negative") -> DataFrame:
    """keys, ap: average precision by distinct thresholds; keys without positives have no row."""
    grouped = df.groupBy(*keys, score).agg(F.sum(positive).alias("pos"), F.sum(negative).alias("neg"))
    ranked = running_totals(grouped, keys, score, ["pos", "neg"], descending=True)
    tp, fp = F.col("before_pos") + F.col("pos"), F.col("before_neg") + F.col("neg")
    sums = ranked.groupBy(*keys).agg(F.sum(F.col("pos") * tp.cast("double") / (tp + fp).cast("double")).alias("s"), F.sum("pos").alias("p"))
    return sums.filter("p > 0").select(*keys, (F.col("s") / F.col("p").cast("double")).alias("ap"))


def macro(by_class: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Unweighted mean over the classes that have a value."""
    return by_class.groupBy(*keys).agg(F.avg(value).alias(f"macro_{value}"))


def kl_term(true: Column, predicted: Column, eps: float = 1e-12) -> Column:
    return true * (F.ln(F.greatest(true, F.lit(eps))) - F.ln(F.greatest(predicted, F.lit(eps))))


def mean_kl(df: DataFrame, keys: list[str], item: str, true: str, predicted: str) -> DataFrame:
    """Mean over items of the sum over classes; the multiplier is the unclipped truth."""
    rows = df.groupBy(*keys, item).agg(F.sum(kl_term(F.col(true), F.col(predicted))).alias("kl"))
    return rows.groupBy(*keys).agg(F.avg("kl").alias("mean_kl"))


def mean_error_to_reference(df: DataFrame, keys: list[str], item: str, predicted: str, reference: str) -> DataFrame:
    """Mean over classes, then over items, of the absolute difference to the item's reference row."""
    rows = df.groupBy(*keys, item).agg(F.avg(F.abs(F.col(predicted) - F.col(reference))).alias("e"))
    return rows.groupBy(*keys).agg(F.avg("e").alias("mean_abs_error"))


def class_ranks(df: DataFrame, keys: list[str], score: str, positive: str = "positive", negative: str = "negative") -> DataFrame:
    """keys, auc, ap of `class_auc` and `class_ap` from one pass of running totals; null where the key has none.

    Totals run from the highest score down: what precedes a score are its
    threshold's positives and negatives (ap), what doesn't precede it are the
    negatives that its positives win against (auc).
    """
    grouped = df.groupBy(*keys, score).agg(F.sum(positive).alias("pos"), F.sum(negative).alias("neg"))
    ranked = running_totals(grouped, keys, score, ["pos", "neg"], descending=True)
    tp, fp = F.col("before_pos") + F.col("pos"), F.col("before_neg") + F.col("neg")
    sums = ranked.groupBy(*keys).agg(
        F.sum(F.col("pos") * tp.cast("double") / (tp + fp).cast("double")).alias("steps"), F.sum(F.col("pos") * (2 * F.col("before_neg") + F.col("neg"))).alias("lost"), F.sum("pos").alias("p"), F.sum("neg").alias("n"),
    )
    pairs = 2 * F.col("p") * F.col("n")
    auc = F.when(pairs > 0, (pairs - F.col("lost")).cast("double") / pairs.cast("double"))
    return sums.select(*keys, auc.alias("auc"), F.when(F.col("p") > 0, F.col("steps") / F.col("p").cast("double")).alias("ap"))


def paired_summary(predictions: DataFrame) -> DataFrame:
    """condition_name, n_images, macro_auc, macro_ap, mean_kl, mean_abs_error, delta_auc.

    predictions: stem, condition_name, class, t (support), p (score), r (share).
    One grouped pass over items gives the means, one over scores both rank
    metrics.  Classes that hold one outcome only don't enter the macro means.
    """
    reference = predictions.filter("condition_name = 'reference'").select("stem", "class", F.col("r").alias("reference_r"))
    rows = predictions.join(reference, ["stem", "class"], "left").withColumn("positive", (F.col("t") > 0).cast("int")).withColumn("negative", 1 - F.col("positive"))
    keys = ["condition_name"]
    items = rows.groupBy(*keys, "stem").agg(F.sum(kl_term(F.col("t"), F.col("r"))).alias("kl"), F.avg(F.abs(F.col("r") - F.col("reference_r"))).alias("e"))
    means = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_images"), F.avg("kl").alias("mean_kl"), F.avg("e").alias("mean_abs_error"))
    ranks = class_ranks(rows, [*keys, "class"], "p").groupBy(*keys).agg(F.avg("auc").alias("macro_auc"), F.avg("ap").alias("macro_ap"))
    # One row a condition: the reference's is found without a second pass.
    base = F.max(F.when(F.col("condition_name") == "reference", F.col("macro_auc"))).over(W.partitionBy())
    delta = F.when(F.col("condition_name") != "reference", F.col("macro_auc") - base)
    return means.join(ranks, keys, "left").select(*keys, "n_images", "macro_auc", "macro_ap", "mean_kl", "mean_abs_error", delta.alias("delta_auc"))


def family_draws(families: DataFrame, reps: int) -> DataFrame:
    """rep, family, times: a bootstrap of whole families; families: family, place (0..n-1), n.

    Draws are arithmetic on (rep, slot), so any engine and any partitioning
    draw alike; a family's multiplicity stands for its replicated rows.
    """
    slot = families.select(F.col("place").cast("long").alias("slot"), F.col("n").cast("long").alias("n"))
    drawn = slot.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("rep", F.col("rep").cast("long"))
    mixed = (F.col("rep") + 1) * 7919 + (F.col("slot") + 1) * 104729 + (F.col("rep") + 1) * (F.col("slot") + 1) * (F.col("slot") + 31)
    picks = drawn.select("rep", ((mixed % 1000003) % F.col("n")).alias("place"))
    times = picks.groupBy("rep", "place").agg(F.count(F.lit(1)).alias("times"))
    return times.join(families.select(F.col("place").cast("long").alias("place"), "family"), "place").select("rep", "family", "times")


def numbered_families(rows: DataFrame) -> DataFrame:
    """family, place, n; one row a family."""
    names = rows.select("family").distinct()
    return names.select("family", (F.row_number().over(W.orderBy("family")) - 1).alias("place"), F.count(F.lit(1)).over(W.partitionBy()).alias("n"))


def multiplicities(n: int, reps: int) -> np.ndarray:
    """How often each replicate draws each of n families: reps x n, by the arithmetic of `family_draws`."""
    rep, slot = np.arange(1, reps + 1, dtype=np.int64)[:, None], np.arange(n, dtype=np.int64)[None, :]
    places = (rep * 7919 + (slot + 1) * 104729 + rep * (slot + 1) * (slot + 31)) % 1000003 % n
    return np.stack([np.bincount(row, minlength=n).astype(np.int32) for row in places])


def replicate_aucs(cells: DataFrame, families: list[str], reps: int, keys: list[str]) -> DataFrame:
    """keys, rep, auc of cells (keys, family, p, pos, neg): replicates are columns of a matrix, not rows.

    A group of one key and score bucket adds up, for every replicate at once,
    what its positives win within the bucket; a second step adds what they win
    over the buckets below.  The multiplicities (reps x families) are broadcast.
    A task multiplies ROWS_AT_ONCE cells at a time, however many share a score.
    Keys of few cells have few buckets, so that groups are worth a call.
    """
    largest = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = min(BUCKETS, -(-largest // ROWS_AT_ONCE)) or 1
    times = cells.sparkSession.sparkContext.broadcast((multiplicities(len(families), reps), {f: i for i, f in enumerate(families)}))
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    named = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def inside(rows: pa.Table) -> pa.Table:
        table, place = times.value
        p = rows.column("p").to_numpy()
        order = np.argsort(p, kind="stable")
        p, of = p[order], np.array([place[f] for f in rows.column("family").to_pylist()])[order]
        pos, neg = (rows.column(c).to_numpy()[order] for c in ("pos", "neg"))
        fresh = np.concatenate([[True], p[1:] != p[:-1]])
        won, below, positives, open_a, open_b = (np.zeros(reps, np.int64) for _ in range(5))
        for at in range(0, len(p), ROWS_AT_ONCE):
            weight = table[:, of[at : at + ROWS_AT_ONCE]]
            heads = np.flatnonzero(fresh[at : at + ROWS_AT_ONCE])
            if fresh[at]:  # the score before this block is complete
                won += open_a * (2 * below + open_b)
                below += open_b
                positives += open_a
                open_a, open_b = np.zeros(reps, np.int64), np.zeros(reps, np.int64)
            else:
                heads = np.concatenate([[0], heads])
            a, b = (np.add.reduceat(weight * x[at : at + ROWS_AT_ONCE], heads, axis=1) for x in (pos, neg))
            a[:, 0] += open_a
            b[:, 0] += open_b
            open_a, open_b = a[:, -1].copy(), b[:, -1].copy()
            a, b = a[:, :-1], b[:, :-1]
            before = below[:, None] + np.cumsum(b, axis=1) - b
            won += (a * (2 * before + b)).sum(axis=1)
            below += b.sum(axis=1)
            positives += a.sum(axis=1)
        won += open_a * (2 * below + open_b)
        below += open_b
        positives += open_a
        first = rows.slice(0, 1).select([*keys, "_b"])
        return pa.table({**{c: first.column(c) for c in [*keys, "_b"]}, "won": pa.array([won.tolist()]), "pos": pa.array([positives.tolist()]), "neg": pa.array([below.tolist()])})

    def across(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_b")
        won, pos, neg = (np.array(rows.column(c).to_pylist(), dtype=np.int64) for c in ("won", "pos", "neg"))
        below = np.cumsum(neg, axis=0) - neg
        total = (won + 2 * pos * below).sum(axis=0)
        pairs = 2 * pos.sum(axis=0) * neg.sum(axis=0)
        fine = np.flatnonzero(pairs)
        auc = total[fine].astype(np.float64) / pairs[fine].astype(np.float64)
        return pa.table({**{k: pa.array([rows.column(k)[0].as_py()] * len(fine), rows.schema.field(k).type) for k in keys}, "rep": pa.array(fine), "auc": pa.array(auc)})

    buckets = cells.withColumn("_b", _bucket("p", parts)).groupBy(*keys, "_b").applyInArrow(inside, f"{named}, _b long, won array<long>, pos array<long>, neg array<long>")
    return buckets.groupBy(*keys).applyInArrow(across, f"{named}, rep long, auc double")


FAMILIES_TO_BROADCAST = 20_000


def bootstrap_delta_auc(predictions: DataFrame, reps: int) -> DataFrame:
    """condition_name, delta_auc_mean, delta_auc_variance (population), n_bootstrap_valid over family resamples.

    Counts by (condition, class, family, score) are built once; replicates
    only multiply them.  Replicates without any two-sided class drop out.
    Up to FAMILIES_TO_BROADCAST families, replicates are never rows; beyond,
    cells are joined with the draws.
    """
    cells = predictions.groupBy("condition_name", "class", "family", "p").agg(F.sum((F.col("t") > 0).cast("long")).alias("pos"), F.sum((F.col("t") <= 0).cast("long")).alias("neg"))
    families = [r.family for r in predictions.select("family").distinct().orderBy("family").limit(FAMILIES_TO_BROADCAST + 1).collect()]
    if len(families) <= FAMILIES_TO_BROADCAST:
        by_class = replicate_aucs(cells, families, reps, ["condition_name", "class"])
    else:
        draws = family_draws(numbered_families(predictions), reps)
        weighted = cells.join(draws, "family").withColumn("positive", F.col("pos") * F.col("times")).withColumn("negative", F.col("neg") * F.col("times"))
        by_class = class_auc(weighted, ["condition_name", "rep", "class"], "p")
    auc = macro(by_class, ["condition_name", "rep"], "auc")
    base = auc.filter("condition_name = 'reference'").select("rep", F.col("macro_auc").alias("base"))
    deltas = auc.filter("condition_name <> 'reference'").join(base, "rep").withColumn("delta", F.col("macro_auc") - F.col("base"))
    return deltas.groupBy("condition_name").agg(F.avg("delta").alias("delta_auc_mean"), F.var_pop("delta").alias("delta_auc_variance"), F.count("delta").alias("n_bootstrap_valid"))


def fold_summary(predictions: DataFrame, reps: int) -> DataFrame:
    """paired_summary with delta_auc_variance and n_bootstrap_valid of a family bootstrap (null for the reference)."""
    drawn = bootstrap_delta_auc(predictions, reps).drop("delta_auc_mean")
    return paired_summary(predictions).join(drawn, "condition_name", "left")


def combine_folds(folds: DataFrame) -> DataFrame:
    """Per condition: inverse-variance mean and its deviation, plain and size-weighted means, folds in order; smallest mean first.

    folds: condition_name, fold, n, delta, variance.  A variance that is zero
    (it would weigh without bound), null or NaN is left out of the
    inverse-variance mean.
    """
    w = F.when((F.col("variance") > 0) & ~F.isnan("variance"), 1 / F.col("variance"))
    sums = folds.groupBy("condition_name").agg(
        F.sum(w * F.col("delta")).alias("wd"), F.sum(w).alias("w"), F.count(F.lit(1)).alias("n_folds"), F.avg("delta").alias("mean_delta"),
        (F.sum(F.col("n") * F.col("delta")) / F.sum("n")).alias("size_weighted_delta"),
        F.transform(F.array_sort(F.collect_list(F.struct("fold", "delta"))), lambda x: F.round(x["delta"], 6)).alias("deltas"),
    )
    out = sums.select("condition_name", "n_folds", F.try_divide("wd", "w").alias("iv_mean"), F.try_divide(F.lit(1.0), F.sqrt("w")).alias("iv_std"), "mean_delta", "size_weighted_delta", F.concat_ws(",", F.transform("deltas", lambda x: F.format_string("%.6f", x))).alias("deltas"))
    return out.orderBy(F.asc_nulls_last("iv_mean"), "condition_name")
