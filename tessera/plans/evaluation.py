"""Paired evaluation: rank metrics, divergences, bootstrap and fold combination as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import metrics

from .predictions import PREDICTIONS, predictions
from .registry import ORACLE_SQL, Source, query, rounded

REPS = 500

AUC = """
auc_grouped AS (SELECT {keys}, class, p, sum({pos}) AS pos, sum({neg}) AS neg FROM {rows} GROUP BY ALL),
auc_ranked AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {keys}, class ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM auc_grouped),
auc_class AS (
  SELECT {keys}, class, CAST(sum(pos * (2 * before + neg)) AS DOUBLE) / CAST(2 * sum(pos) * sum(neg) AS DOUBLE) AS auc
  FROM auc_ranked GROUP BY ALL HAVING sum(pos) > 0 AND sum(neg) > 0),
auc_macro AS (SELECT {keys}, avg(auc) AS macro_auc FROM auc_class GROUP BY ALL)"""

AP = """
ap_grouped AS (SELECT condition_name, class, p, sum(CASE WHEN t > 0 THEN 1 ELSE 0 END) AS pos, count(*) AS n FROM rows_ GROUP BY ALL),
ap_ranked AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS k FROM ap_grouped WINDOW w AS (PARTITION BY condition_name, class ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ap_class AS (SELECT condition_name, class, sum(pos * CAST(tp AS DOUBLE) / CAST(k AS DOUBLE)) / CAST(sum(pos) AS DOUBLE) AS ap FROM ap_ranked GROUP BY ALL HAVING sum(pos) > 0),
ap_macro AS (SELECT condition_name, avg(ap) AS macro_ap FROM ap_class GROUP BY ALL)"""

KL = """
kl AS (SELECT condition_name, avg(kl) AS mean_kl FROM (
  SELECT condition_name, stem, sum(t * (ln(greatest(t, CAST(1e-12 AS DOUBLE))) - ln(greatest(r, CAST(1e-12 AS DOUBLE))))) AS kl FROM rows_ GROUP BY ALL) GROUP BY ALL)"""

MAE = """
mae AS (SELECT condition_name, avg(e) AS mean_abs_error FROM (
  SELECT a.condition_name, a.stem, avg(abs(a.r - b.r)) AS e FROM rows_ a LEFT JOIN rows_ b ON a.stem = b.stem AND a.class = b.class AND b.condition_name = 'reference' GROUP BY ALL) GROUP BY ALL)"""

ROWS = f"WITH rows_ AS MATERIALIZED ({PREDICTIONS})"
PLAIN_AUC = AUC.format(keys="condition_name", rows="rows_", pos="CASE WHEN t > 0 THEN 1 ELSE 0 END", neg="CASE WHEN t > 0 THEN 0 ELSE 1 END")


def _rows(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    return rows.withColumn("positive", (F.col("t") > 0).cast("long")).withColumn("negative", (F.col("t") <= 0).cast("long"))


PAIRED = f"""{ROWS},{PLAIN_AUC},{AP},{KL},{MAE}, n AS (SELECT condition_name, count(DISTINCT stem) AS n_images FROM rows_ GROUP BY ALL)
SELECT n.condition_name, n.n_images, round(macro_auc, 6) AS macro_auc, round(macro_ap, 6) AS macro_ap, round(mean_kl, 6) AS mean_kl, round(mean_abs_error, 6) AS mean_abs_error,
       CASE WHEN n.condition_name <> 'reference' THEN round(macro_auc - (SELECT macro_auc FROM auc_macro WHERE condition_name = 'reference'), 6) END AS delta_auc
FROM n LEFT JOIN auc_macro a ON n.condition_name = a.condition_name LEFT JOIN ap_macro p ON n.condition_name = p.condition_name
JOIN kl ON n.condition_name = kl.condition_name JOIN mae ON n.condition_name = mae.condition_name"""


@query(PAIRED)
def paired_condition_summary(spark, sf_dir):
    out = metrics.paired_summary(predictions(spark, sf_dir))
    return rounded(out, "macro_auc", "macro_ap", "mean_kl", "mean_abs_error", "delta_auc")


@query(f"{ROWS},{PLAIN_AUC} SELECT condition_name, round(macro_auc, 6) AS macro_auc FROM auc_macro")
def macro_auc(spark, sf_dir):
    return rounded(metrics.macro(metrics.class_auc(_rows(spark, sf_dir), ["condition_name", "class"], "p"), ["condition_name"], "auc"), "macro_auc")


@query(f"{ROWS},{AP} SELECT condition_name, round(macro_ap, 6) AS macro_ap FROM ap_macro")
def macro_ap(spark, sf_dir):
    return rounded(metrics.macro(metrics.class_ap(_rows(spark, sf_dir), ["condition_name", "class"], "p"), ["condition_name"], "ap"), "macro_ap")


@query(f"{ROWS},{KL} SELECT condition_name, round(mean_kl, 6) AS mean_kl FROM kl")
def mean_kl(spark, sf_dir):
    return rounded(metrics.mean_kl(predictions(spark, sf_dir), ["condition_name"], "stem", "t", "r"), "mean_kl")


@query(f"{ROWS},{MAE} SELECT condition_name, round(mean_abs_error, 6) AS mean_abs_error FROM mae")
def mae_ref(spark, sf_dir):
    from tessera.operators import joins

    rows = predictions(spark, sf_dir)
    reference = rows.filter("condition_name = 'reference'").select("stem", "class", F.col("r").alias("reference_r"))
    out = metrics.mean_error_to_reference(joins.paired(rows, reference, ["stem", "class"]), ["condition_name"], "stem", "r", "reference_r")
    return rounded(out, "mean_abs_error")


@query(f"SELECT stem, family, condition_name, class, round(t, 6) AS t, p, r FROM ({PREDICTIONS}) x")
def bag_predictions(spark, sf_dir):
    """Every prediction of the bag model: each specimen under each of the fixed conditions, by class."""
    return rounded(predictions(spark, sf_dir).select("stem", "family", "condition_name", "class", "t", "p", "r"), "t")  # p and r are rounded already


WEIGHTED_AUC = AUC.format(keys="condition_name, rep", rows="weighted", pos="pos * times", neg="neg * times")


def _bootstrap_sql(reps):
    return f"""{ROWS}, families AS (SELECT family, row_number() OVER (ORDER BY family) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT family FROM rows_)),
picks AS (SELECT rep, (((rep + 1) * 7919 + (place + 1) * 104729 + (rep + 1) * (place + 1) * (place + 31)) % 1000003) % n AS place FROM families CROSS JOIN (SELECT range AS rep FROM range({reps}))),
draws AS (SELECT p.rep, f.family, count(*) AS times FROM picks p JOIN families f ON p.place = f.place GROUP BY ALL),
weighted AS (
  SELECT c.condition_name, c.class, c.p, d.rep, d.times, CASE WHEN c.t > 0 THEN 1 ELSE 0 END AS pos, CASE WHEN c.t > 0 THEN 0 ELSE 1 END AS neg
  FROM rows_ c JOIN draws d ON c.family = d.family),{WEIGHTED_AUC},
deltas AS (SELECT a.condition_name, a.macro_auc - b.macro_auc AS delta FROM auc_macro a JOIN auc_macro b ON a.rep = b.rep AND b.condition_name = 'reference' WHERE a.condition_name <> 'reference')
SELECT condition_name, round(avg(delta), 6) AS delta_auc_mean, round(var_pop(delta), 9) AS delta_auc_variance, count(*) AS n_bootstrap_valid FROM deltas GROUP BY ALL"""


@query(_bootstrap_sql(REPS))
def bootstrap_delta_auc(spark, sf_dir):
    out = metrics.bootstrap_delta_auc(predictions(spark, sf_dir), REPS)
    return rounded(rounded(out, "delta_auc_mean"), "delta_auc_variance", digits=9)


@query(ORACLE_SQL["bootstrap_delta_auc"])
def bootstrap_delta_auc_full(spark, sf_dir):
    """bootstrap_delta_auc, under the name it had when that one drew less often."""
    return bootstrap_delta_auc(spark, sf_dir)


@query(f"SELECT s.*, b.delta_auc_variance, b.n_bootstrap_valid FROM ({PAIRED}) s LEFT JOIN ({_bootstrap_sql(REPS)}) b ON s.condition_name = b.condition_name")
def fold_summary(spark, sf_dir):
    """The summary of one fold, with the variance that fold combination weighs by."""
    out = metrics.fold_summary(predictions(spark, sf_dir), REPS)
    return rounded(rounded(out, "macro_auc", "macro_ap", "mean_kl", "mean_abs_error", "delta_auc"), "delta_auc_variance", digits=9)


#: One fold of a condition has no spread, one has no value at all.
FOLDS = """
SELECT condition_name, fold, n, delta, CASE WHEN condition_name = '1-URGENT' AND fold = 0 THEN CAST(0 AS DOUBLE) WHEN condition_name = '2-HIGH' AND fold = 1 THEN CAST('NaN' AS DOUBLE) ELSE variance END AS variance
FROM (SELECT o_orderpriority AS condition_name, CAST(o_orderkey % 3 AS INT) AS fold, count(*) AS n, CAST(avg(o_totalprice) / 1e6 AS DOUBLE) AS delta, CAST(var_pop(o_totalprice) / 1e12 AS DOUBLE) AS variance
FROM orders GROUP BY 1, 2) plain"""


@query(f"""
WITH f AS ({FOLDS}), u AS (SELECT *, CASE WHEN variance > 0 AND NOT isnan(variance) THEN 1 / variance END AS w FROM f)
SELECT condition_name, count(*) AS n_folds, round(sum(delta * w) / sum(w), 6) AS iv_mean, round(1 / sqrt(sum(w)), 6) AS iv_std, round(avg(delta), 6) AS mean_delta,
       round(sum(n * delta) / sum(n), 6) AS size_weighted_delta, string_agg(printf('%.6f', round(delta, 6)), ',' ORDER BY fold, delta) AS deltas FROM u GROUP BY 1""")
def combine_folds(spark, sf_dir):
    folds = Source(spark, sf_dir).sql(FOLDS).withColumn("delta", F.col("delta").cast("double")).withColumn("variance", F.col("variance").cast("double"))
    return rounded(metrics.combine_folds(folds), "iv_mean", "iv_std", "mean_delta", "size_weighted_delta")
