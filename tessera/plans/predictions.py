"""Predictions of the bag model over the driver tables: 23 conditions and 10 classes of every bag of embeddings.

Sixteen embeddings are the crops of a specimen; their labels give its soft
habitat, and the document of the same number its family.  What an ablation
leaves of each feature is a relation of gains by condition (no image tables
exist here), and the weights are relations by rule, in place of a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import conditions as cond
from tessera.operators import model
from tessera.streaming.events import folder

from .registry import Source

CROPS, SIZE, GATES, HIDDEN, CLASSES = 16, 64, 16, 32, 10
OUT = [((j * 53 + 7) % 41 - 20) / 10 for j in range(GATES)]
NAMES = ["reference", *cond.GRID_CODES, *(f"A3_h{s}_r{r}" for s in cond.GRID_SIDES for r in cond.GRID_REALISATIONS), *(f"A4_theta{a}_L{n}" for a in cond.GRID_ANGLES for n in cond.GRID_LENGTHS)]
#: Weights w(i, j) of a layer with i from 0 (the last i is the bias) and j from 0.
LAYERS = {"gate": (2 * GATES, 11), "hidden": (2 * HIDDEN, 29), "last": (2 * CLASSES, 43)}


def layer(spark: SparkSession, name: str) -> DataFrame:
    """i, j, w of a layer; a head's last layer sees its own hidden units only."""
    width, seed = LAYERS[name]
    rows = spark.range((SIZE + 1) * width).select(F.floor(F.col("id") / width).alias("i"), (F.col("id") % width).alias("j"))
    rows = rows.withColumn("w", ((F.col("i") * 37 + F.col("j") * 101 + seed) % 201 - 100) / F.lit(100.0))
    return rows.filter((F.col("i") == SIZE) | (F.floor(F.col("i") / HIDDEN) == F.floor(F.col("j") / CLASSES))) if name == "last" else rows


def gains(spark: SparkSession) -> DataFrame:
    """condition_name, gain: what a condition leaves of each feature."""
    n = spark.createDataFrame(list(enumerate(NAMES)), "n int, condition_name string")
    left = F.transform(F.sequence(F.lit(0), F.lit(SIZE - 1)), lambda i: F.when(F.col("n") == 0, 1.0).when((i + F.col("n")) % 5 == 0, 0.0).otherwise(1 - (i * F.col("n")) % 7 / F.lit(20.0)))
    return n.select("condition_name", left.alias("gain"))


def bag_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stem, family, condition_name, habitat, cls_prob, reg_prob, cls_logit, reg_logit: one row for each specimen and condition."""
    source = Source(spark, sf_dir)
    crops = source.table("embeddings").filter("embedding is not null").select(F.floor(F.col("vec_id") / CROPS).alias("stem"), F.col("vec_id").alias("crop"), "label", F.col("embedding").cast("array<double>").alias("v"))
    shares = F.expr(f"array({', '.join(f'avg(CAST(label = {c} AS DOUBLE))' for c in range(CLASSES))})")
    families = source.table("documents").select(F.col("doc_id").alias("stem"), F.col("source").alias("family"))
    items = crops.groupBy("stem").agg(shares.alias("habitat")).join(families, "stem")
    # Dealt by stem once: every sum by crop or bag that follows finds its rows together.
    dealt = crops.select("stem", "crop", "v").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "stem")
    seen = dealt.crossJoin(F.broadcast(gains(spark)))  # one row a condition
    seen = seen.select("stem", "condition_name", "crop", F.zip_with("v", "gain", lambda a, b: a * b).alias("features"))
    keys = ["stem", "condition_name"]
    pooled = model.attention_pool(seen, keys, "crop", "features", SIZE, layer(spark, "gate"), OUT)
    return model.predict(pooled, keys, layer(spark, "hidden"), layer(spark, "last"), CLASSES).join(items, "stem")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stem, family, condition_name, class, t, p, r, x, s from a written table: what follows doesn't score again."""
    path = folder(spark, "predictions")
    scored = bag_predictions(spark, sf_dir)
    scored.write.parquet(path)
    return model.by_class(spark.read.schema(scored.schema).parquet(path), ["stem", "family", "condition_name"])


def _weights(name: str) -> str:
    width, seed = LAYERS[name]
    own = f" WHERE i = {SIZE} OR i // {HIDDEN} = j // {CLASSES}" if name == "last" else ""
    return f"SELECT i, j, ((i * 37 + j * 101 + {seed}) % 201 - 100) / CAST(100 AS DOUBLE) AS w FROM range({SIZE + 1}) a(i) CROSS JOIN range({width}) b(j){own}"


ERF = f"2 / sqrt(pi()) * {{x}} * exp(-{{x}} * {{x}}) * list_reduce(list_transform(range({model.TERMS}, 0, -1), lambda k: CAST(k AS DOUBLE)), lambda q, k: 1 + q * 2 * {{x}} * {{x}} / (2 * k + 1), CAST(1 AS DOUBLE))"
CLIPPED = f"greatest(least(y / sqrt(CAST(2 AS DOUBLE)), CAST({model.FAR} AS DOUBLE)), CAST(-{model.FAR} AS DOUBLE))"
#: The same rows as `predictions`, as SQL over embeddings and documents.
PREDICTIONS = f"""
WITH gate AS ({_weights("gate")}), hidden AS ({_weights("hidden")}), last_ AS ({_weights("last")}),
out_ AS (SELECT j, ((j * 53 + 7) % 41 - 20) / CAST(10 AS DOUBLE) AS w FROM range({GATES}) a(j)),
cond AS (SELECT * FROM (VALUES {", ".join(f"({n}, '{c}')" for n, c in enumerate(NAMES))}) AS c(n, condition_name)),
crops AS (SELECT e.vec_id // {CROPS} AS stem, e.vec_id AS crop, e.label, CAST(e.embedding AS DOUBLE[]) AS v, d.source AS family FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id // {CROPS} WHERE e.embedding IS NOT NULL),
f AS MATERIALIZED (SELECT stem, crop, n, i, v[i + 1] * CASE WHEN n = 0 THEN 1 WHEN (i + n) % 5 = 0 THEN 0 ELSE 1 - (i * n) % 7 / CAST(20 AS DOUBLE) END AS x FROM crops CROSS JOIN cond CROSS JOIN range({SIZE}) a(i)),
g AS MATERIALIZED (SELECT f.stem, f.crop, f.n, gate.j, sum(f.x * gate.w) + any_value(b.w) AS y FROM f JOIN gate ON f.i = gate.i JOIN gate b ON b.i = {SIZE} AND b.j = gate.j GROUP BY 1, 2, 3, 4),
scored AS (SELECT a.stem, a.crop, a.n, exp(sum(o.w * tanh(a.y) / (1 + exp(-s.y)))) AS w FROM g a JOIN g s ON a.stem = s.stem AND a.crop = s.crop AND a.n = s.n AND s.j = a.j + {GATES} JOIN out_ o ON o.j = a.j GROUP BY 1, 2, 3),
pooled AS (SELECT f.stem, f.n, f.i, sum(s.w * f.x) / sum(s.w) AS x FROM f JOIN scored s ON f.stem = s.stem AND f.crop = s.crop AND f.n = s.n GROUP BY 1, 2, 3),
inner_ AS (SELECT p.stem, p.n, h.j AS i, sum(p.x * h.w) + any_value(b.w) AS y FROM pooled p JOIN hidden h ON p.i = h.i JOIN hidden b ON b.i = {SIZE} AND b.j = h.j GROUP BY 1, 2, 3),
active AS (SELECT stem, n, i, 0.5 * y * (1 + {ERF.format(x="z")}) AS x FROM (SELECT *, {CLIPPED} AS z FROM inner_) q),
logits AS (SELECT a.stem, a.n, l.j, sum(a.x * l.w) + any_value(b.w) AS y FROM active a JOIN last_ l ON a.i = l.i JOIN last_ b ON b.i = {SIZE} AND b.j = l.j GROUP BY 1, 2, 3),
wide AS (SELECT stem, n, j % {CLASSES} AS class, max(CASE WHEN j < {CLASSES} THEN y END) AS x, max(CASE WHEN j >= {CLASSES} THEN y END) AS s FROM logits GROUP BY 1, 2, 3),
truth AS (SELECT stem, class, any_value(family) AS family, avg(CASE WHEN label = class THEN CAST(1 AS DOUBLE) ELSE 0 END) AS t FROM crops CROSS JOIN range({CLASSES}) a(class) GROUP BY 1, 2)
SELECT w.stem, t.family, c.condition_name, CAST(w.class AS INT) AS class, t.t, round(1 / (1 + exp(-w.x)), 9) AS p, round(exp(w.s) / sum(exp(w.s)) OVER (PARTITION BY w.stem, w.n), 9) AS r, w.x, w.s
FROM wide w JOIN truth t ON t.stem = w.stem AND t.class = w.class JOIN cond c ON c.n = w.n"""
