"""Condition algebra: admissible sets of ablations, draws, marginals, and the fixed evaluation grid."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Codes, the codes that exclude each other, how often a set has 0, 1, 2 or 3 codes.
CODES = ("A1", "A2", "A3", "A4", "A5", "A6", "A7")
EXCLUSIVE = ("A1", "A2", "A6", "A7")
SIZE_PROBABILITY = {0: 0.20, 1: 0.40, 2: 0.30, 3: 0.10}
GRID_CODES, GRID_SIDES, GRID_REALISATIONS, GRID_ANGLES, GRID_LENGTHS = ("A1", "A2", "A5", "A7"), (56, 16, 4, 1), (1, 2, 3), (0, 90), (17, 41, 101)


def admissible(codes: Column) -> Column:
    """At most one of the exclusive codes."""
    return F.size(F.array_intersect(codes, F.array(*map(F.lit, EXCLUSIVE)))) <= 1


def all_conditions(spark: SparkSession) -> DataFrame:
    """condition_name, codes, k of every admissible set."""
    rows = [("+".join(c) or "reference", list(c), k) for k in SIZE_PROBABILITY for c in combinations(CODES, k)]
    return spark.createDataFrame(rows, "condition_name string, codes array<string>, k int").filter(admissible(F.col("codes")))


def numbered(conditions: DataFrame) -> DataFrame:
    """conditions with place (from 0, by name) and pool (count) within their size, and probability."""
    from pyspark.sql import Window as W

    by_k = W.partitionBy("k")
    p = F.coalesce(*(F.when(F.col("k") == k, F.lit(v)) for k, v in SIZE_PROBABILITY.items()))
    return conditions.withColumn("place", F.row_number().over(by_k.orderBy("condition_name")) - 1).withColumn("pool", F.count(F.lit(1)).over(by_k)).withColumn("probability", p / F.col("pool"))


def marginals(conditions: DataFrame) -> DataFrame:
    """code, probability that a drawn set has it."""
    return numbered(conditions).select(F.explode("codes").alias("code"), "probability").groupBy("code").agg(F.sum("probability").alias("probability"))


def restricted(conditions: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """condition_name, codes, k, probability of the sets of `allowed` codes alone (all, if None).

    Rejecting a set and drawing again draws its size again too: each set keeps
    its share of the whole pool of its size, divided by the mass that is kept.
    """
    kept = numbered(conditions)
    if allowed is not None:
        kept = kept.filter(F.size(F.array_except("codes", F.array(*map(F.lit, allowed)) if allowed else F.array().cast("array<string>"))) == 0)
    whole = kept.agg(F.sum("probability").alias("_mass"))  # one row
    return kept.crossJoin(F.broadcast(whole)).select("condition_name", "codes", "k", (F.col("probability") / F.col("_mass")).alias("probability"))


def draw(items: DataFrame, conditions: DataFrame, u: Column, allowed: list[str] | None = None) -> DataFrame:
    """items with k and condition_name; u (0 up to 1) picks the set by its probability, sets in order of size and name."""
    sets = sorted(restricted(conditions, allowed).collect(), key=lambda r: (r.k, r.condition_name))  # 36 at most
    chosen, upto = F.struct(F.lit(sets[-1].k).alias("k"), F.lit(sets[-1].condition_name).alias("condition_name")), 1.0
    for r, after in zip(reversed(sets[:-1]), reversed(sets[1:]), strict=True):
        upto -= after.probability
        chosen = F.when(u < upto, F.struct(F.lit(r.k).alias("k"), F.lit(r.condition_name).alias("condition_name"))).otherwise(chosen)
    return items.withColumn("_drawn", chosen).select(*items.columns, "_drawn.k", "_drawn.condition_name")


def fixed_grid(spark: SparkSession) -> DataFrame:
    """The 23 evaluation conditions with their pinned parameters."""
    rows = [("reference", "", None, None, None, None)] + [(c, c, None, None, None, None) for c in GRID_CODES]
    rows += [(f"A3_h{s}_r{r}", "A3", s, r, None, None) for s in GRID_SIDES for r in GRID_REALISATIONS]
    rows += [(f"A4_theta{a}_L{n}", "A4", None, None, a, n) for a in GRID_ANGLES for n in GRID_LENGTHS]
    return spark.createDataFrame(rows, "condition_name string, code string, side int, realisation int, theta int, length int")
