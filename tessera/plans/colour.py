"""Colour operators over the pixel relation as registered queries; their SQL is a form of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import colour as c
from tessera.operators import colour as op
from tessera.operators import conditions as cond
from tessera.operators import joins, selection
from tessera.sources.relations import PIXELS

from .ordered import STEP
from .registry import Source, query, rounded
from .relational import GRID

FOREGROUND = f"SELECT * FROM ({PIXELS}) bg WHERE r <> 0 OR g <> 0 OR b <> 0"
LAB = c.to_lab(FOREGROUND)
KEEP = "stem, pix"
R6 = lambda *names: ", ".join(f"round({n}, 6) AS {n.strip('_') if n == 'b_' else n}" for n in names)


def _register(name: str, made: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """A query that `made` gives of the foreground pixels."""

    def f(spark, sf_dir):
        return made(op.foreground(Source(spark, sf_dir).sql(PIXELS)))

    f.__name__ = name
    query(sql)(f)


def _six(df: DataFrame, *columns: str) -> DataFrame:
    return rounded(df.select(*columns), *(x for x in columns if x not in ("stem", "pix", "label", "r8", "g8", "b8")))


STORED = ", ".join(f"{c.truncated(n + '1')} AS {n}8" for n in "rgb")
NEAREST = ", ".join(f"CAST(round_even(round({n}1 * {c.num(255)}, 6), 0) AS INT) AS {n}8" for n in "rgb")
OUT = ("r1", "g1", "b1", "r8", "g8", "b8")


def _audit(pixels: DataFrame) -> DataFrame:
    """stem and what the standardised pixels, stored as doubles, realise."""
    moved = op.standardised(pixels)
    held = moved.select("stem", F.col("L1").alias("L0"), F.col("a").alias("a0"), F.col("b_").alias("b0"), *((F.col(f"{n}1") * 255).alias(f"{n}255") for n in "rgb"))
    back = op.with_lab(held, ("r255", "g255", "b255"))
    apart = F.sqrt(F.pow(F.col("L") - F.col("L0"), 2) + F.pow(F.col("a") - F.col("a0"), 2) + F.pow(F.col("b_") - F.col("b0"), 2))
    return back.groupBy("stem").agg(F.round(F.avg("L"), 4).alias("realised_mean"), F.round(F.stddev_pop("L"), 4).alias("realised_std"), F.round(F.avg(apart), 4).alias("mean_delta_e"))


GRAY = c.to_rgb(f"SELECT {KEEP}, L, {c.num(0)} AS a, {c.num(0)} AS b_ FROM ({LAB}) x", KEEP)
CHROMA_ONLY = c.to_rgb(f"SELECT {KEEP}, {c.num(50)} AS L, a, b_ FROM ({LAB}) x", KEEP)
NAMED = c.named(c.to_lab(c.with_probabilities(FOREGROUND), "stem, pix, " + ", ".join("p_" + t for t in c.TERMS)).replace("s0", "s0p"), KEEP)
SOFT = c.soft_named(c.to_lab(c.with_probabilities(FOREGROUND), "stem, pix, " + ", ".join("p_" + t for t in c.TERMS)).replace("s0", "s0p"), KEEP)

_register("pixel_lab", lambda p: _six(op.with_lab(p).withColumnRenamed("b", "blue").withColumnRenamed("b_", "b"), "stem", "pix", "L", "a", "b"), f"SELECT stem, pix, {R6('L', 'a', 'b_')} FROM ({LAB}) x")
_register("hue_chroma", lambda p: op.with_lab(p).filter(op.chroma() > 1).select("stem", "pix", F.round(op.chroma(), 6).alias("chroma"), F.round(op.hue(), 4).alias("hue")), f"SELECT stem, pix, round({c.CHROMA}, 6) AS chroma, round({c.HUE}, 4) AS hue FROM ({LAB}) x WHERE {c.CHROMA} > 1")
_register("gray_lstar", lambda p: _six(op.gray(p), "stem", "pix", *OUT), f"SELECT stem, pix, {R6('r1', 'g1', 'b1')}, {STORED} FROM ({GRAY}) x")
_register("chroma_only", lambda p: _six(op.chroma_only(p), "stem", "pix", *OUT), f"SELECT stem, pix, {R6('r1', 'g1', 'b1')}, {STORED} FROM ({CHROMA_ONLY}) x")
_register("delta_e", lambda p: op.with_lab(p).groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(op.chroma()), 6).alias("mean_delta_e"), F.round(F.max(op.chroma()), 6).alias("max_delta_e")), f"SELECT x.stem, count(*) AS n, round(avg(sqrt(x.a * x.a + x.b_ * x.b_)), 6) AS mean_delta_e, round(max(sqrt(x.a * x.a + x.b_ * x.b_)), 6) AS max_delta_e FROM ({LAB}) x GROUP BY x.stem")
_register("chroma_retention", lambda p: op.with_lab(p).withColumn("C", op.chroma()).groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("C"), 6).alias("mean_chroma"), F.round(F.avg(F.when(F.col("C") > 1, F.col("C"))), 6).alias("mean_chromatic"), F.round(F.avg((F.col("C") > 1).cast("double")), 6).alias("share_chromatic")), f"SELECT stem, count(*) AS n, round(avg({c.CHROMA}), 6) AS mean_chroma, round(avg(CASE WHEN {c.CHROMA} > 1 THEN {c.CHROMA} END), 6) AS mean_chromatic, round(avg(CASE WHEN {c.CHROMA} > 1 THEN {c.num(1)} ELSE {c.num(0)} END), 6) AS share_chromatic FROM ({LAB}) x GROUP BY stem")
_register("colour_names_hard", lambda p: op.named(p).select("stem", "pix", "raw", "base", "label"), f"SELECT stem, pix, raw, base, label FROM ({NAMED}) x")
_register("presence_by_label", op.present, f"SELECT stem, label, count(CASE WHEN label IN ({', '.join(repr(x) for x in c.CHROMATIC)}) THEN 1 END) AS n FROM ({NAMED}) x GROUP BY stem, label HAVING count(CASE WHEN label IN ({', '.join(repr(x) for x in c.CHROMATIC)}) THEN 1 END) > 0")
_register("override_fraction", lambda p: op.named(p).groupBy("stem").agg(F.round(F.avg((F.col("base") != F.col("label")).cast("double")), 6).alias("changed")), f"SELECT stem, round(avg(CASE WHEN base <> label THEN {c.num(1)} ELSE {c.num(0)} END), 6) AS changed FROM ({NAMED}) x GROUP BY stem")
_register("colour_names_soft", lambda p: _six(op.soft_named(p), "stem", "pix", *(f"m_{x}" for x in c.CATEGORIES)), "SELECT stem, pix, " + ", ".join(f"round(m_{x}, 6) AS m_{x}" for x in c.CATEGORIES) + f" FROM ({SOFT}) x")
REMOVED = c.to_rgb(f"SELECT {KEEP}, label, L, CASE WHEN label = 'green' THEN {c.num(0)} ELSE a END AS a, CASE WHEN label = 'green' THEN {c.num(0)} ELSE b_ END AS b_ FROM ({NAMED}) x", f"{KEEP}, label")
_register("colour_remove", lambda p: _six(op.removed(p, "green"), "stem", "pix", "label", "r1", "g1", "b1"), f"SELECT stem, pix, label, {R6('r1', 'g1', 'b1')} FROM ({REMOVED}) x")
SOFT_AB = c.soft_named(c.to_lab(c.with_probabilities(FOREGROUND), "stem, pix, " + ", ".join("p_" + t for t in c.TERMS)).replace("s0", "s0p"), f"{KEEP}, a, b_")
FADED = c.to_rgb(f"SELECT {KEEP}, m_green, L, a * ({c.num(1)} - {c.num(0.8)} * m_green) AS a, b_ * ({c.num(1)} - {c.num(0.8)} * m_green) AS b_ FROM ({SOFT_AB}) x", f"{KEEP}, m_green")
_register("colour_fade_soft", lambda p: _six(op.faded(p, "green", 0.8), "stem", "pix", "m_green", "r1", "g1", "b1"), f"SELECT stem, pix, {R6('m_green', 'r1', 'g1', 'b1')} FROM ({FADED}) x")
# Lightness standardised over the population: each specimen is moved to the mean of all means and deviations; a*, b* stay.
MOMENTS = f"SELECT stem, avg(L) AS m, stddev_pop(L) AS s FROM ({LAB}) x GROUP BY stem"
TARGET = f"SELECT avg(m) AS M0, avg(s) AS S0 FROM ({MOMENTS}) y"
MOVED = f"""
SELECT p.stem, p.pix, p.a, p.b_, CASE WHEN q.s < {c.num(1e-8)} THEN t.M0 ELSE greatest(least((p.L - q.m) / q.s * t.S0 + t.M0, {c.num(100)}), {c.num(0)}) END AS L
FROM ({LAB}) p JOIN ({MOMENTS}) q ON p.stem = q.stem CROSS JOIN ({TARGET}) t"""
STANDARD = c.to_rgb(MOVED, f"{KEEP}, L, a, b_")
_register("population_standardise", lambda p: _six(op.standardised(p), "stem", "pix", *OUT), f"SELECT stem, pix, {R6('r1', 'g1', 'b1')}, {NEAREST} FROM ({STANDARD}) x")
BACK = c.to_lab(f"SELECT stem, pix, L AS L0, a AS a0, b_ AS b0, r1 * {c.num(255)} AS r, g1 * {c.num(255)} AS g, b1 * {c.num(255)} AS b FROM ({STANDARD}) x", "stem, pix, L0, a0, b0")
_register("standardise_audit", _audit, f"SELECT stem, round(avg(L), 4) AS realised_mean, round(stddev_pop(L), 4) AS realised_std, round(avg(sqrt((L - L0) * (L - L0) + (a - a0) * (a - a0) + (b_ - b0) * (b_ - b0))), 4) AS mean_delta_e FROM ({BACK}) x GROUP BY stem")
FIXED = f"SELECT p.stem, p.pix, greatest(least(CASE WHEN q.s < {c.num(1e-8)} THEN {c.num(50)} ELSE (p.L - q.m) / q.s * {c.num(15)} + {c.num(50)} END, {c.num(100)}), {c.num(0)}) AS L, {c.num(0)} AS a, {c.num(0)} AS b_ FROM ({LAB}) p JOIN ({MOMENTS}) q ON p.stem = q.stem"
_register("equalise_fixed_target", lambda p: _six(op.equalised(p), "stem", "pix", "r1", "g1", "b1"), f"SELECT stem, pix, {R6('r1', 'g1', 'b1')} FROM ({c.to_rgb(FIXED, KEEP)}) x")

# Lightness equalised with the whole image's or each crop's own moments; a crop is every fourth pixel here.
BY_SCOPE = {"crop": "stem, crop", "whole_image": "stem"}


def _equalise_audit(pixels: DataFrame) -> DataFrame:
    rows = pixels.withColumn("crop", F.pmod("pix", F.lit(4)).cast("int"))
    both = op.equalise_audits(rows, {scope: tuple(by.split(", ")) for scope, by in BY_SCOPE.items()})
    sums = ("reference_mean", "reference_sd", "crop_mean", "crop_sd", "realised_mean", "realised_sd")
    return rounded(both.select("stem", "crop", "scope", *sums), *sums, digits=4)


IN_CROPS = f"SELECT stem, pix, CAST(pix % 4 AS INT) AS crop, L FROM ({LAB}) x"
SCOPED = {
    scope: f"SELECT p.stem, p.crop, p.L AS L0, q.m, q.s, greatest(least(CASE WHEN q.s < {c.num(1e-8)} THEN {c.num(50)} ELSE (p.L - q.m) / q.s * {c.num(15)} + {c.num(50)} END, {c.num(100)}), {c.num(0)}) AS L, {c.num(0)} AS a, {c.num(0)} AS b_ FROM ({IN_CROPS}) p JOIN (SELECT {by}, avg(L) AS m, stddev_pop(L) AS s FROM ({IN_CROPS}) y GROUP BY {by}) q USING ({by})"
    for scope, by in BY_SCOPE.items()
}
REALISED = {scope: c.to_lab(f"SELECT stem, crop, L0, m, s, r1 * {c.num(255)} AS r, g1 * {c.num(255)} AS g, b1 * {c.num(255)} AS b FROM ({c.to_rgb(sql, 'stem, crop, L0, m, s')}) x", "stem, crop, L0, m, s") for scope, sql in SCOPED.items()}
_register("equalise_audit", _equalise_audit, " UNION ALL ".join(f"SELECT stem, crop, '{scope}' AS scope, round(avg(m), 4) AS reference_mean, round(avg(s), 4) AS reference_sd, round(avg(L0), 4) AS crop_mean, round(stddev_pop(L0), 4) AS crop_sd, round(avg(L), 4) AS realised_mean, round(stddev_pop(L), 4) AS realised_sd FROM ({sql}) z GROUP BY stem, crop" for scope, sql in REALISED.items()))

# What one lightness costs: chroma only, through RGB and back.
AT_50 = c.to_rgb(f"SELECT {KEEP}, label, C AS c0, {c.num(50)} AS L, a, b_ FROM ({NAMED}) x", f"{KEEP}, label, c0, a, b_")
GAMUT = f"""SELECT stem, label, c0, {c.CHROMA} AS c1, CASE WHEN c0 > 1 THEN {c.CHROMA} / c0 ELSE {c.num(1)} END AS kept, sqrt((L - 50) * (L - 50) + (a - a0) * (a - a0) + (b_ - b0) * (b_ - b0)) AS de
FROM ({c.to_lab(f"SELECT stem, pix, label, c0, a AS a0, b_ AS b0, r1 * {c.num(255)} AS r, g1 * {c.num(255)} AS g, b1 * {c.num(255)} AS b FROM ({AT_50}) x", "stem, pix, label, c0, a0, b0")}) y"""
MEANS = ("mean_intended", "mean_realised", "mean_retention", "median_retention", "losing_5", "losing_20", "mean_delta_e", "share_over_1")
_register("gamut_audit", lambda p: rounded(op.gamut_audit(p), *MEANS), f"""
SELECT stem, count(*) AS n_foreground, count(CASE WHEN c0 > 1 THEN 1 END) AS n_chromatic, round(avg(c0), 6) AS mean_intended, round(avg(c1), 6) AS mean_realised,
       round(avg(CASE WHEN c0 > 1 THEN kept END), 6) AS mean_retention, round(median(CASE WHEN c0 > 1 THEN kept END), 6) AS median_retention,
       round(coalesce(avg(CASE WHEN c0 > 1 THEN CASE WHEN kept < 0.95 THEN {c.num(1)} ELSE {c.num(0)} END END), 0), 6) AS losing_5, round(coalesce(avg(CASE WHEN c0 > 1 THEN CASE WHEN kept < 0.8 THEN {c.num(1)} ELSE {c.num(0)} END END), 0), 6) AS losing_20,
       round(avg(de), 6) AS mean_delta_e, round(avg(CASE WHEN de > 1 THEN {c.num(1)} ELSE {c.num(0)} END), 6) AS share_over_1, max(de) > 1 AS distorted
FROM ({GAMUT}) z GROUP BY stem""")
_register("gamut_by_category", lambda p: rounded(op.gamut_by_category(p), "mean_retention", "mean_delta_e"), f"""
WITH m AS ({GAMUT}), g AS (SELECT stem, category FROM (SELECT DISTINCT stem FROM m), (SELECT unnest([{', '.join(map(repr, c.CATEGORIES))}]) AS category))
SELECT g.stem, g.category AS label, count(m.stem) AS n, round(avg(CASE WHEN m.c0 > 1 THEN m.kept END), 6) AS mean_retention, round(avg(m.de), 6) AS mean_delta_e
FROM g LEFT JOIN m ON m.stem = g.stem AND m.label = g.category GROUP BY 1, 2""")

# The whole of A2: moments, the population's histogram, exact matching to it, 8-bit levels.
POPULATION_MATCH = f"""
WITH lab AS ({LAB}), st AS (SELECT stem, avg(L) AS m, stddev_pop(L) AS s FROM lab GROUP BY stem), t AS (SELECT avg(m) AS mean, avg(s) AS spread FROM st),
z AS (SELECT p.stem, p.pix, p.a, p.b_, round(CASE WHEN st.s < 1e-8 THEN t.mean ELSE greatest(least((p.L - st.m) / st.s * t.spread + t.mean, {c.num(100)}), {c.num(0)}) END, 6) AS z FROM lab p JOIN st ON p.stem = st.stem CROSS JOIN t),
h AS (SELECT stem, CAST(greatest(least(round_even(z / {STEP:.17e}, 0), 255), 0) AS INT) AS bin, count(*) AS n FROM z GROUP BY 1, 2),
sizes AS (SELECT stem, sum(n) AS total FROM h GROUP BY stem),
dens AS (SELECT bin, d / sum(d) OVER () AS density FROM (SELECT bin, sum(n / CAST(total AS DOUBLE)) AS d FROM h JOIN sizes ON h.stem = sizes.stem GROUP BY bin) x),
e AS (SELECT stem, total, bin, density * total AS exact FROM sizes CROSS JOIN dens),
f AS (SELECT *, CAST(floor(exact) AS BIGINT) AS base FROM e),
k AS (SELECT *, total - sum(base) OVER (PARTITION BY stem) AS short, row_number() OVER (PARTITION BY stem ORDER BY round(exact - base, 9) DESC, bin) AS place FROM f),
counts AS (SELECT stem, bin, base + CASE WHEN place <= short THEN 1 ELSE 0 END AS n FROM k),
v AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY z, pix) AS rank FROM z),
u AS (SELECT stem, bin, n, sum(n) OVER (PARTITION BY stem ORDER BY bin) AS hi FROM counts)
SELECT v.stem, v.pix, u.bin, v.a, v.b_, u.bin * {STEP:.17e} AS L FROM v JOIN u ON v.stem = u.stem AND v.rank > u.hi - u.n AND v.rank <= u.hi"""
_register("population_match", lambda p: _six(op.matched(p), "stem", "pix", "bin", *OUT), f"SELECT stem, pix, bin, {R6('r1', 'g1', 'b1')}, {NEAREST} FROM ({c.to_rgb(POPULATION_MATCH, f'{KEEP}, bin')}) x")

# A6: a category that the specimen shows is drawn and turns gray.
DRAWN = f"""
SELECT stem, category FROM (
  SELECT stem, label AS category, row_number() OVER (PARTITION BY stem ORDER BY list_position({list(c.CHROMATIC)!r}, label)) - 1 AS place, count(*) OVER (PARTITION BY stem) AS n
  FROM (SELECT DISTINCT stem, label FROM ({NAMED}) n0 WHERE label IN ({', '.join(repr(x) for x in c.CHROMATIC)})) d) e WHERE (stem * 7919 + 13) % n = place"""
GONE = f"SELECT x.stem, x.pix, category, L, CASE WHEN label = category THEN {c.num(0)} ELSE a END AS a, CASE WHEN label = category THEN {c.num(0)} ELSE b_ END AS b_ FROM ({NAMED}) x JOIN ({DRAWN}) d ON x.stem = d.stem"


def _draws(pixels: DataFrame) -> DataFrame:
    return op.drawn_category(pixels, F.col("stem") * 7919 + 13)


_register("colour_removal_drawn", lambda p: _six(op.removed_by_row(p.join(_draws(p), "stem"), F.col("category")), "stem", "pix", *OUT), f"SELECT stem, pix, {R6('r1', 'g1', 'b1')}, {STORED} FROM ({c.to_rgb(GONE, KEEP)}) y")
MEMBER = "CASE d.category " + " ".join(f"WHEN '{x}' THEN s.m_{x}" for x in c.CHROMATIC) + " END"
P, COPY = ", ".join("p_" + t for t in c.TERMS), ", ".join("copy_" + t for t in c.TERMS)
COPIED = f"SELECT *, {', '.join(f'p_{t} AS copy_{t}' for t in c.TERMS)} FROM ({c.with_probabilities(FOREGROUND)}) pc"
BOTH = c.soft_named(
    f"SELECT stem, pix, base AS base_, label AS label_, C AS chroma, list_sort([{COPY}], 'DESC') AS ps, L, a, b_, {', '.join(f'copy_{t} AS p_{t}' for t in c.TERMS)} FROM ({c.named(c.to_lab(COPIED, f'stem, pix, {P}, {COPY}'), f'stem, pix, {COPY}')}) nc",
    "stem, pix, base_, label_, chroma, ps",
)
AUDIT = ("category_fraction", "mean_membership", "mean_chroma_in_category", "fraction_changed", "mean_confidence", "mean_margin", "fraction_ambiguous")
_register("colour_removal_audit", lambda p: rounded(op.removal_audit(p, _draws(p)), *AUDIT), f"""
SELECT d.stem, d.category, round(avg(CASE WHEN s.label_ = d.category THEN {c.num(1)} ELSE {c.num(0)} END), 6) AS category_fraction, round(avg({MEMBER}), 6) AS mean_membership,
       round(coalesce(avg(CASE WHEN s.label_ = d.category THEN s.chroma END), 0), 6) AS mean_chroma_in_category, round(avg(CASE WHEN s.base_ <> s.label_ THEN {c.num(1)} ELSE {c.num(0)} END), 6) AS fraction_changed,
       round(avg(s.ps[1]), 6) AS mean_confidence, round(avg(s.ps[1] - s.ps[2]), 6) AS mean_margin, round(avg(CASE WHEN s.ps[1] - s.ps[2] < 0.15 THEN {c.num(1)} ELSE {c.num(0)} END), 6) AS fraction_ambiguous
FROM ({DRAWN}) d JOIN ({BOTH}) s ON d.stem = s.stem GROUP BY 1, 2""")


def _items(pixels: DataFrame) -> DataFrame:
    """The fixed grid for every specimen, and A6 for each category that it shows."""
    grid = joins.evaluation_items(pixels.select("stem").distinct(), cond.fixed_grid(pixels.sparkSession).select("condition_name", "code")).withColumn("category", F.lit(None).cast("string"))
    shown = op.present(pixels).select("stem", F.concat(F.lit("A6_"), "label").alias("condition_name"), F.lit("A6").alias("code"), F.col("label").alias("category"))
    return grid.unionByName(shown)


_register("evaluation_items_all", _items, f"""
SELECT s.stem, g.condition_name, g.code, CAST(NULL AS VARCHAR) AS category FROM (SELECT DISTINCT stem FROM ({FOREGROUND}) f) s CROSS JOIN (VALUES {GRID}) AS g(condition_name, code)
UNION ALL SELECT stem, 'A6_' || label, 'A6', label FROM (SELECT DISTINCT stem, label FROM ({NAMED}) n0 WHERE label IN ({', '.join(repr(x) for x in c.CHROMATIC)})) x""")


# A6 from the label and gray caches where a specimen has both, else online.  What the caches hold follows the suppliers' accounts.
IN_LABELS, IN_GRAY = "s_acctbal > 0", "s_nationkey < 20"
CACHED = f"SELECT s_suppkey FROM supplier WHERE {IN_LABELS} AND {IN_GRAY}"


@query(f"SELECT y.stem, y.pix, {STORED}, CASE WHEN s.s_suppkey IS NULL THEN 'online' ELSE 'cache' END AS source FROM ({c.to_rgb(f'SELECT {KEEP}, L, CASE WHEN label = ' + repr('green') + f' THEN {c.num(0)} ELSE a END AS a, CASE WHEN label = ' + repr('green') + f' THEN {c.num(0)} ELSE b_ END AS b_ FROM ({NAMED}) x', KEEP)}) y LEFT JOIN ({CACHED}) s ON y.stem = s.s_suppkey WHERE true")
def colour_removal_cached(spark, sf_dir):
    """Green removed: by the stored labels and grays where a specimen has both, by classification where it hasn't."""
    source = Source(spark, sf_dir)
    pixels = op.foreground(source.sql(PIXELS))
    own = source.table("supplier").select(F.col("s_suppkey").alias("stem"), "s_acctbal", "s_nationkey")
    keys = ("stem", "pix", "r", "g", "b")  # line items may repeat a place
    labels = selection.stored(op.named(pixels.join(own.filter(IN_LABELS), "stem", "left_semi")).select(*keys, "label").dropDuplicates(keys), "labels")
    grays = selection.stored(op.gray(pixels.join(own.filter(IN_GRAY), "stem", "left_semi")).select(*keys, "r8", "g8", "b8").dropDuplicates(keys), "grays")
    done = joins.from_caches(pixels, [labels, grays], "stem", lambda p: op.removed_from_caches(p, labels, grays, "green", keys), lambda p: op.removed(p, "green").select(*keys, "r8", "g8", "b8"))
    return done.select("stem", "pix", "r8", "g8", "b8", "source")
