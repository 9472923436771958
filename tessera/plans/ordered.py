"""Epoch metrics, population standardisation, sampling and array operators as registered queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import aggregates as agg
from tessera.operators import ordered, selection
from tessera.sources.relations import EPOCHS, PIXELS

from .registry import Source, query, rounded

DECAY, LAG, TEMPERATURE, BAND, PATIENCE = 0.9, 3, 0.5, (0.3, 0.7), 4
BINS, TOP = 256, 100.0
STEP = TOP / (BINS - 1)
#: A lightness-like value of each pixel, 0..100.
LIGHT = f"SELECT stem, pix, (r * 30 + g * 59 + b * 11) / CAST(255 AS DOUBLE) AS v FROM ({PIXELS}) q"


@query(f"SELECT term, epoch, round(loss, 6) AS loss, round(avg(loss) OVER (PARTITION BY term ORDER BY epoch ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS trailing FROM ({EPOCHS}) e")
def trailing_mean(spark, sf_dir):
    return rounded(ordered.trailing_mean(Source(spark, sf_dir).sql(EPOCHS), "term", "epoch", "loss", 5).select("term", "epoch", "loss", "trailing"), "loss", "trailing")


EMA = f"""
WITH RECURSIVE e AS (SELECT term, loss, epoch, row_number() OVER (PARTITION BY term ORDER BY epoch) AS i FROM ({EPOCHS}) x),
m AS (SELECT term, epoch, i, CAST(loss AS DOUBLE) AS loss, CAST(loss AS DOUBLE) AS ema FROM e WHERE i = 1
      UNION ALL SELECT e.term, e.epoch, e.i, e.loss, CAST({DECAY} AS DOUBLE) * m.ema + CAST({1 - DECAY} AS DOUBLE) * e.loss FROM m JOIN e ON e.term = m.term AND e.i = m.i + 1)
"""


@query(EMA + "SELECT term, epoch, round(ema, 6) AS ema FROM m")
def ema_losses(spark, sf_dir):
    return rounded(ordered.moving_average(Source(spark, sf_dir).sql(EPOCHS), "term", "epoch", "loss", DECAY).select("term", "epoch", "ema"), "ema")


@query("""
WITH RECURSIVE e AS (SELECT event_type AS term, event_id, CAST(value AS DOUBLE) AS x, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events),
m AS (SELECT term, event_id, i, x AS ema FROM e WHERE i = 1 UNION ALL SELECT e.term, e.event_id, e.i, CAST(0.99 AS DOUBLE) * m.ema + CAST(0.01 AS DOUBLE) * e.x FROM m JOIN e ON e.term = m.term AND e.i = m.i + 1)
SELECT term, event_id, i AS place, round(ema, 6) AS ema FROM m""")
def ema_events(spark, sf_dir):
    """The average after every single event: long series, cut over all partitions."""
    e = Source(spark, sf_dir).table("events").select(F.col("event_type").alias("term"), "event_id", "value")
    return rounded(ordered.moving_average(e, "term", "event_id", "value", 0.99).select("term", "event_id", "place", "ema"), "ema")


@query(EMA + f""", r AS (SELECT term, epoch, ema / lag(ema, {LAG}) OVER (PARTITION BY term ORDER BY epoch) AS ratio FROM m),
w AS (SELECT epoch, max(CASE WHEN term = 'click' THEN ratio END) AS a, max(CASE WHEN term = 'view' THEN ratio END) AS b FROM r GROUP BY epoch),
s AS (SELECT epoch, CASE WHEN a IS NULL OR b IS NULL THEN CAST(0.5 AS DOUBLE) ELSE least(greatest(1 / (1 + exp(-(a - b) / {TEMPERATURE})), CAST({BAND[0]} AS DOUBLE)), CAST({BAND[1]} AS DOUBLE)) END AS weight_a FROM w)
SELECT epoch, round(weight_a, 6) AS weight_a, round(1 - weight_a, 6) AS weight_b FROM s""")
def ema_balance(spark, sf_dir):
    averages = ordered.moving_average(Source(spark, sf_dir).sql(EPOCHS), "term", "epoch", "loss", DECAY)
    return rounded(ordered.balanced_weights(averages, "term", "epoch", ("click", "view"), LAG, TEMPERATURE, BAND), "weight_a", "weight_b")


@query(f"""
WITH e AS (SELECT *, round(loss, 9) AS l, row_number() OVER (PARTITION BY term ORDER BY epoch) AS n FROM ({EPOCHS}) x),
b AS (SELECT *, coalesce(l < min(l) OVER (PARTITION BY term ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM e),
s AS (SELECT *, n - max(CASE WHEN is_best THEN n END) OVER (PARTITION BY term ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stale FROM b),
t AS (SELECT *, coalesce(max(CASE WHEN stale >= {PATIENCE} THEN 1 ELSE 0 END) OVER (PARTITION BY term ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops FROM s)
SELECT term, epoch, is_best, CAST(stale AS INT) AS stale FROM t WHERE stops = 0""")
def early_stop(spark, sf_dir):
    e = Source(spark, sf_dir).sql(EPOCHS).withColumn("loss", F.round("loss", 9))
    return ordered.early_stop(e, "term", "epoch", "loss", PATIENCE).select("term", "epoch", "is_best", F.col("stale").cast("int").alias("stale"))


@query(f"SELECT stem, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM ({LIGHT}) l GROUP BY stem")
def population_stats(spark, sf_dir):
    return rounded(agg.population_stats(Source(spark, sf_dir).sql(LIGHT), "stem", "v"), "mean", "std")


POPULATION = f"SELECT stem, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std FROM ({LIGHT}) l GROUP BY stem"


@query(f"SELECT 'image' AS weight, round(avg(mean), 6) AS M, round(avg(std), 6) AS S FROM ({POPULATION}) UNION ALL SELECT 'pixel', round(sum(n * mean) / sum(n), 6), round(sum(n * std) / sum(n), 6) FROM ({POPULATION})")
def weighted_pop(spark, sf_dir):
    stats = agg.population_stats(Source(spark, sf_dir).sql(LIGHT), "stem", "v")
    both = agg.weighted_population(stats, False).select(F.lit("image").alias("weight"), "M", "S").unionByName(agg.weighted_population(stats, True).select(F.lit("pixel").alias("weight"), "M", "S"))
    return rounded(both, "M", "S")


#: Lightness matched to mean 50 and deviation 15; rounded, so that both engines see the same bin edges.
MATCHED = f"""
SELECT l.stem, l.pix, round(CASE WHEN s.std < 1e-8 THEN CAST(50 AS DOUBLE) ELSE least(greatest((l.v - s.mean) / s.std * 15 + 50, CAST(0 AS DOUBLE)), CAST(100 AS DOUBLE)) END, 6) AS z
FROM ({LIGHT}) l JOIN ({POPULATION}) s ON l.stem = s.stem"""


@query(MATCHED)
def lum_match(spark, sf_dir):
    v = Source(spark, sf_dir).sql(LIGHT)
    stats = agg.population_stats(v, "stem", "v")
    joined = v.join(stats, "stem")
    z = F.when(F.col("std") < 1e-8, F.lit(50.0)).otherwise(F.least(F.greatest((F.col("v") - F.col("mean")) / F.col("std") * 15 + 50, F.lit(0.0)), F.lit(100.0)))
    return joined.select("stem", "pix", F.round(z, 6).alias("z"))


HIST = f"SELECT stem, CAST(greatest(least(round_even(v / {STEP:.17e}, 0), 255), 0) AS INT) AS bin, count(*) AS n FROM ({LIGHT}) l GROUP BY 1, 2"
DENSITY = f"""
WITH h AS ({HIST}), sizes AS (SELECT stem, sum(n) AS size FROM h GROUP BY stem),
d AS (SELECT bin, sum(n / CAST(size AS DOUBLE)) AS d FROM h JOIN sizes ON h.stem = sizes.stem GROUP BY bin),
density AS (SELECT bin, d / sum(d) OVER () AS density FROM d)"""


def _density(spark, sf_dir):
    return agg.target_density(agg.histograms(Source(spark, sf_dir).sql(LIGHT), "stem", "v", BINS, TOP), "stem")


@query(DENSITY + " SELECT bin, round(density, 6) AS density FROM density")
def target_density(spark, sf_dir):
    return rounded(_density(spark, sf_dir), "density")


WEIGHED = f"""
WITH h AS ({HIST}), sizes AS (SELECT stem, CAST(sum(n) AS DOUBLE) AS size FROM h GROUP BY stem),
d AS (SELECT w.weight, bin, sum(n / size * CASE w.weight WHEN 'image' THEN CAST(1 AS DOUBLE) ELSE size END) AS d FROM h JOIN sizes ON h.stem = sizes.stem CROSS JOIN (VALUES ('image'), ('pixel')) AS w(weight) GROUP BY 1, 2)"""


@query(WEIGHED + " SELECT weight, bin, round(d / sum(d) OVER (PARTITION BY weight), 6) AS density FROM d")
def weighted_density(spark, sf_dir):
    """The population's histogram with each specimen alike, and by its pixels."""
    counts = agg.histograms(Source(spark, sf_dir).sql(LIGHT), "stem", "v", BINS, TOP)
    both = [agg.weighted_density(counts, "stem", BINS, by_size).select(F.lit(name).alias("weight"), "bin", "density") for name, by_size in (("image", False), ("pixel", True))]
    return rounded(both[0].unionByName(both[1]), "density")


@query(f"SELECT count(DISTINCT stem) AS n_specimens, count(DISTINCT n) AS distinct_pixels, min(n) AS min_pixels, median(CAST(n AS DOUBLE)) AS median_pixels, max(n) AS max_pixels FROM ({POPULATION}) p")
def population_pixels(spark, sf_dir):
    return agg.population_pixels(agg.population_stats(Source(spark, sf_dir).sql(LIGHT), "stem", "v"), "stem", "n")


@query(DENSITY + f""", m AS (SELECT sum(bin * {STEP:.17e} * density) AS mean, sum(bin * {STEP:.17e} * bin * {STEP:.17e} * density) AS square, sum(CASE WHEN bin = 0 THEN density ELSE 0 END) AS lo, sum(CASE WHEN bin = 255 THEN density ELSE 0 END) AS hi FROM density)
SELECT round(mean, 6) AS mean, round(sqrt(square - mean * mean), 6) AS std, round(lo, 6) AS atom_low, round(hi, 6) AS atom_high FROM m""")
def density_moments(spark, sf_dir):
    return rounded(agg.density_moments(_density(spark, sf_dir), BINS, TOP), "mean", "std", "atom_low", "atom_high")


COARSE = "(VALUES (0, 0.05), (1, 0.15), (2, 0.2), (3, 0.25), (4, 0.15), (5, 0.1), (6, 0.07), (7, 0.03)) AS c(bin, density)"
COUNTS = f"""
WITH t AS (SELECT stem, count(*) AS total FROM ({PIXELS}) p GROUP BY stem),
e AS (SELECT stem, total, bin, CAST(density AS DOUBLE) * total AS exact FROM t CROSS JOIN {COARSE}),
f AS (SELECT *, CAST(floor(exact) AS BIGINT) AS base FROM e),
k AS (SELECT *, total - sum(base) OVER (PARTITION BY stem) AS short, row_number() OVER (PARTITION BY stem ORDER BY round(exact - base, 9) DESC, bin) AS place FROM f),
counts AS (SELECT stem, bin, base + CASE WHEN place <= short THEN 1 ELSE 0 END AS n FROM k)"""


def _coarse(spark):
    return spark.createDataFrame([(0, 0.05), (1, 0.15), (2, 0.2), (3, 0.25), (4, 0.15), (5, 0.1), (6, 0.07), (7, 0.03)], "bin int, density double")


@query(COUNTS + " SELECT stem, bin, n FROM counts")
def apportion(spark, sf_dir):
    totals = Source(spark, sf_dir).sql(PIXELS).groupBy("stem").agg(F.count(F.lit(1)).alias("total"))
    return ordered.apportion(_coarse(spark), totals, "stem")


@query(COUNTS + f""", v AS (SELECT stem, pix, v, row_number() OVER (PARTITION BY stem ORDER BY v, pix) AS rank FROM ({LIGHT}) l),
u AS (SELECT stem, bin, sum(n) OVER (PARTITION BY stem ORDER BY bin) AS hi, n FROM counts)
SELECT v.stem, v.pix, u.bin FROM v JOIN u ON v.stem = u.stem AND v.rank > u.hi - u.n AND v.rank <= u.hi""")
def hist_match(spark, sf_dir):
    v = Source(spark, sf_dir).sql(LIGHT)
    counts = ordered.apportion(_coarse(spark), v.groupBy("stem").agg(F.count(F.lit(1)).alias("total")), "stem")
    return selection.matched_bins(v, counts, "stem", "v", "pix").select("stem", "pix", "bin")


CELLS = f"SELECT stem, pix AS cand, CAST(r // 16 AS INT) * 16 + CAST(g // 16 AS INT) AS cell, (pix * 2654435761 + stem * 40503) % 4294967296 AS h FROM ({PIXELS}) p"


@query(f"""
WITH c AS ({CELLS}), f AS (SELECT *, row_number() OVER (PARTITION BY stem, cell ORDER BY h, cand) AS r FROM c),
k AS (SELECT stem, cell, cand, row_number() OVER (PARTITION BY stem ORDER BY h, cell) AS place FROM f WHERE r = 1)
SELECT stem, cell, cand, place FROM k WHERE place <= 16""")
def grid_cell_sample(spark, sf_dir):
    p = Source(spark, sf_dir).sql(PIXELS).select("stem", F.col("pix").alias("cand"), (F.floor(F.col("r") / 16) * 16 + F.floor(F.col("g") / 16)).cast("int").alias("cell"))
    seed = (F.col("cand") * 2654435761 + F.col("stem") * 40503) % 4294967296
    return ordered.one_per_cell(p, "stem", "cell", seed, 16).select("stem", "cell", "cand", "place")


@query("SELECT vec_id, round(list_sort(embedding, 'DESC')[1] - list_sort(embedding, 'DESC')[2], 6) AS margin FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)")
def top2_margin(spark, sf_dir):
    e = Source(spark, sf_dir).table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return rounded(e.select("vec_id", ordered.top2_margin(F.col("v")).alias("margin")), "margin")


@query("SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS BIGINT) AS best FROM (SELECT vec_id, embedding AS v FROM embeddings)")
def argmax_label(spark, sf_dir):
    e = Source(spark, sf_dir).table("embeddings").select("vec_id", F.col("embedding").alias("v"))
    return e.select("vec_id", ordered.argmax(F.col("v")).alias("best"))


@query("""
WITH p AS (SELECT vec_id, i AS radius, avg(abs(embedding[j])) AS profile FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, unnest(range(1, 65)) AS j, unnest(range(1, 65)) // 6 AS i FROM embeddings) GROUP BY 1, 2)
SELECT vec_id, round(-regr_slope(CASE WHEN radius BETWEEN 2 AND 9 AND profile > 0 THEN ln(profile) END, CASE WHEN radius BETWEEN 2 AND 9 AND profile > 0 THEN ln(radius) END), 6) AS alpha FROM p GROUP BY 1""")
def radial_slope(spark, sf_dir):
    e = Source(spark, sf_dir).table("embeddings").select("vec_id", F.posexplode("embedding").alias("j", "x"))
    p = agg.radial_profile(e.select("vec_id", F.floor((F.col("j") + 1) / 6).cast("int").alias("radius"), F.abs(F.col("x").cast("double")).alias("m")), "vec_id", "radius", "m")
    return rounded(agg.loglog_slope(p, "vec_id", "radius", 2, 9), "alpha")


CROP, SIDE = 16, 4
BLOCKS = (CROP // SIDE) ** 2
PLACED = f"""
WITH p AS (SELECT stem, pix, row_number() OVER (PARTITION BY stem ORDER BY pix) - 1 AS i FROM ({PIXELS}) x),
c AS (SELECT stem, pix, i // {CROP * CROP} AS crop, (i % {CROP * CROP}) // {CROP} AS y, i % {CROP} AS x FROM p),
full_ AS (SELECT stem, crop FROM c GROUP BY 1, 2 HAVING count(*) = {CROP * CROP}),
o AS (SELECT stem, crop, b, row_number() OVER (PARTITION BY stem, crop ORDER BY ((b + 1) * 7919 + (crop + 1) * 104729 + stem * 31) % 10007, b) - 1 AS place FROM full_ CROSS JOIN (SELECT range AS b FROM range({BLOCKS})))"""


@query(PLACED + f""" SELECT c.stem, c.crop, c.pix, CAST(CASE WHEN o.place IS NULL THEN y ELSE o.place // {CROP // SIDE} * {SIDE} + y % {SIDE} END AS INT) AS y, CAST(CASE WHEN o.place IS NULL THEN x ELSE o.place % {CROP // SIDE} * {SIDE} + x % {SIDE} END AS INT) AS x
FROM c LEFT JOIN o ON c.stem = o.stem AND c.crop = o.crop AND o.b = (y // {SIDE}) * {CROP // SIDE} + x // {SIDE}""")
def block_permute(spark, sf_dir):
    """Crops of 16 x 16 pixels, their blocks of 4 x 4 dealt anew by keyed order; a crop that isn't full stays."""
    i = F.row_number().over(W.partitionBy("stem").orderBy("pix")) - 1
    p = Source(spark, sf_dir).sql(PIXELS).select("stem", "pix").withColumn("i", i)
    crops = p.select("stem", "pix", F.floor(F.col("i") / CROP**2).alias("crop"), F.floor(F.col("i") % CROP**2 / CROP).alias("y"), (F.col("i") % CROP).cast("long").alias("x"))
    return ordered.permute_blocks(crops, ["stem", "crop"], CROP, SIDE, lambda b: ((b + 1) * 7919 + (F.col("crop") + 1) * 104729 + F.col("stem") * 31) % 10007).select("stem", "crop", "pix", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))


@query("""
SELECT s_suppkey AS stem, CAST(s_suppkey % 3 AS INT) AS kind, CASE WHEN s_suppkey % 3 = 1 THEN CAST(s_suppkey AS INT) END AS fallback_y,
       CASE WHEN s_suppkey % 3 = 2 THEN 3 ELSE 0 END AS n, CASE WHEN s_suppkey % 3 = 2 THEN CAST(s_suppkey + 4 AS INT) END AS last_x, CASE WHEN s_suppkey % 3 = 2 THEN 8 END AS last_cell FROM supplier""")
def candidate_tables(spark, sf_dir):
    from tessera.functions import candidates

    k = F.col("s_suppkey").cast("int")
    general = F.array(F.lit(2), F.lit(3), k, k + 1, k + 2, k + 2, k + 3, k + 4, F.lit(6), F.lit(7), F.lit(8))
    payload = F.when(k % 3 == 0, F.array(F.lit(0))).when(k % 3 == 1, F.array(F.lit(1), k, k)).otherwise(general)
    p = Source(spark, sf_dir).table("supplier").select(F.col("s_suppkey").alias("stem"), candidates.parsed(payload).alias("c"))
    last = F.try_element_at("c.cands", F.lit(-1))
    return p.select("stem", "c.kind", F.col("c.fallback.y").alias("fallback_y"), F.size("c.cands").alias("n"), last["x"].alias("last_x"), last["cell"].alias("last_cell"))
