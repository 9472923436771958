"""Joins, set operations, aggregations and the condition algebra as registered queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators import aggregates as agg
from tessera.operators import conditions as cond
from tessera.operators import joins, training
from tessera.operators.selection import stored
from tessera.sources import arrays, folds
from tessera.sources.relations import ITEMS, PIXELS
from tessera.streaming.events import folder

from .registry import Source, query, rounded

STEMS_TO_PUSH = 1000  # in one filter of the array source

VIEWED = "SELECT doc_id AS stem, source AS family, CASE lang WHEN 'en' THEN 'Back' WHEN 'fr' THEN 'Belly' ELSE 'Side' END AS view FROM documents"
CATEGORY = "CASE CAST(floor((r * 3 + g * 5 + b * 7) / 128) AS INT) % 4 WHEN 0 THEN 'blue' WHEN 1 THEN 'red' WHEN 2 THEN 'green' ELSE 'brown' END"


@query(f"SELECT * FROM ({VIEWED}) v WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = v.stem)")
def fold_semi_join(spark, sf_dir):
    s = Source(spark, sf_dir)
    return joins.keep_available(s.sql(VIEWED), s.table("labels").select(F.col("doc_id").alias("stem")), ["stem"])


@query(f"SELECT * FROM ({VIEWED}) v WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = v.stem)")
def todo_anti_join(spark, sf_dir):
    s = Source(spark, sf_dir)
    return joins.not_yet_built(s.sql(VIEWED), s.table("labels").select(F.col("doc_id").alias("stem")), ["stem"])


@query("SELECT doc_id AS stem FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM documents WHERE lang = 'en'")
def done_intersect(spark, sf_dir):
    s = Source(spark, sf_dir)
    rgb = s.table("labels").filter("quality = 1").select(F.col("doc_id").alias("stem"))
    lab = s.table("documents").filter("lang = 'en'").select(F.col("doc_id").alias("stem"))
    return joins.built_everywhere([rgb, lab], ["stem"])


GRID = ", ".join(f"('{r}', '{c}')" for r, c in [("reference", ""), *((c, c) for c in cond.GRID_CODES), *((f"A3_h{s}_r{r}", "A3") for s in cond.GRID_SIDES for r in cond.GRID_REALISATIONS), *((f"A4_theta{a}_L{n}", "A4") for a in cond.GRID_ANGLES for n in cond.GRID_LENGTHS)])


@query(f"SELECT l.doc_id AS stem, g.condition_name, g.code FROM labels l CROSS JOIN (VALUES {GRID}) AS g(condition_name, code)")
def eval_grid_cross(spark, sf_dir):
    items = Source(spark, sf_dir).table("labels").select(F.col("doc_id").alias("stem"))
    return joins.evaluation_items(items, cond.fixed_grid(spark).select("condition_name", "code"))


@query("""
WITH wide AS (SELECT user_id AS stem, bool_or(event_type = 'click') AS blue, bool_or(event_type = 'error') AS red, bool_or(value > 50) AS green FROM events GROUP BY 1)
SELECT stem, 'blue' AS category FROM wide WHERE blue UNION ALL SELECT stem, 'red' FROM wide WHERE red UNION ALL SELECT stem, 'green' FROM wide WHERE green""")
def presence_unpivot(spark, sf_dir):
    wide = Source(spark, sf_dir).table("events").groupBy(F.col("user_id").alias("stem")).agg(F.bool_or(F.col("event_type") == "click").alias("blue"), F.bool_or(F.col("event_type") == "error").alias("red"), F.bool_or(F.col("value") > 50).alias("green"))
    return joins.present_items(wide, ["stem"], ["blue", "red", "green"])


@query("SELECT d.doc_id AS stem, d.lang, f.n_items, f.first_item FROM documents d JOIN (SELECT source, count(*) AS n_items, min(doc_id) AS first_item FROM documents GROUP BY source) f ON d.source = f.source")
def family_lookup(spark, sf_dir):
    d = Source(spark, sf_dir).table("documents").select("doc_id", "lang", "source")
    families = d.groupBy("source").agg(F.count(F.lit(1)).alias("n_items"), F.min("doc_id").alias("first_item"))
    return d.join(joins.small(families), "source").select(F.col("doc_id").alias("stem"), "lang", "n_items", "first_item")


@query(f"SELECT t.term, count(*) AS n, sum(p.pix) AS pixes FROM ({PIXELS}) p JOIN (SELECT CAST(range AS INT) AS idx, CAST((range * 7 + 3) % 11 AS INT) AS term FROM range(32768)) t ON t.idx = CAST(floor(r / 8) AS INT) + 32 * CAST(floor(g / 8) AS INT) + 1024 * CAST(floor(b / 8) AS INT) GROUP BY 1")
def lookup_index_join(spark, sf_dir):
    pixels = Source(spark, sf_dir).sql(PIXELS).withColumn("idx", (F.floor(F.col("r") / 8) + 32 * F.floor(F.col("g") / 8) + 1024 * F.floor(F.col("b") / 8)).cast("int"))
    lookup = spark.range(32768).select(F.col("id").cast("int").alias("idx"), ((F.col("id") * 7 + 3) % 11).cast("int").alias("term"))  # 32768 rows
    return pixels.join(F.broadcast(lookup), "idx").groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("pix").alias("pixes"))


@query("""
WITH t AS (SELECT * FROM documents WHERE doc_id % 5 <> 0), v AS (SELECT * FROM documents WHERE doc_id % 5 = 0)
SELECT 'doc_id' AS what, count(*) AS shared FROM (SELECT doc_id FROM t INTERSECT SELECT doc_id FROM v)
UNION ALL SELECT 'source', count(*) FROM (SELECT source FROM t INTERSECT SELECT source FROM v)""")
def leak_check(spark, sf_dir):
    d = Source(spark, sf_dir).table("documents").select("doc_id", "source")
    return joins.leaks(d.filter("doc_id % 5 <> 0"), d.filter("doc_id % 5 = 0"), ["doc_id", "source"])


@query("SELECT text, count(*) AS rows FROM documents GROUP BY text HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return joins.repeated_keys(Source(spark, sf_dir).table("documents").select("text"), ["text"])


@query("SELECT d.doc_id AS stem, coalesce(l.quality, CAST(d.doc_id % 2 AS INT)) AS value FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def cache_fallback(spark, sf_dir):
    s = Source(spark, sf_dir)
    items = s.table("documents").select(F.col("doc_id").alias("stem"))
    cache = s.table("labels").select(F.col("doc_id").alias("stem"), F.col("quality").alias("value"))
    return joins.with_cached(items, cache, ["stem"], "value", (F.col("stem") % 2).cast("int"))


@query("SELECT l.doc_id AS stem, d.lang FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def strict_lookup(spark, sf_dir):
    s = Source(spark, sf_dir)
    return joins.strict_lookup(s.table("labels").select(F.col("doc_id").alias("stem")), s.table("documents").select(F.col("doc_id").alias("stem"), "lang"), ["stem"], "lang")


@query("""
WITH p AS (SELECT l_suppkey AS stem, l_orderkey, l_linenumber, CAST(l_quantity AS INT) % 4 * l_quantity AS a, l_tax * 100 AS b, l_discount * 100 AS c FROM lineitem),
s AS (SELECT *, CASE WHEN a + b + c < 1e-12 THEN CAST(1 AS DOUBLE) ELSE a + b + c END AS t FROM p)
SELECT stem, round(avg(a / t), 6) AS share_a, round(avg(b / t), 6) AS share_b, round(avg(c / t), 6) AS share_c, sum(CASE WHEN a / t > 0 THEN 1 ELSE 0 END) AS support_a FROM s GROUP BY stem""")
def habitat_normalise(spark, sf_dir):
    p = Source(spark, sf_dir).table("lineitem").select(F.col("l_suppkey").alias("stem"), F.array(F.col("l_quantity").cast("int") % 4 * F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_discount") * 100).alias("h"))
    n = p.select("stem", agg.normalised(F.col("h")).alias("h"))
    out = n.groupBy("stem").agg(*(F.avg(F.col("h")[i]).alias(f"share_{c}") for i, c in enumerate("abc")), F.sum((F.col("h")[0] > 0).cast("long")).alias("support_a"))
    return rounded(out, "share_a", "share_b", "share_c")


PREVALENCE = "SELECT CAST(i - 1 AS INT) AS class, avg(CASE WHEN embedding[i] > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS prevalence FROM (SELECT embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1"


@query(f"SELECT class, round(prevalence, 6) AS prevalence FROM ({PREVALENCE})")
def class_prevalence(spark, sf_dir):
    e = Source(spark, sf_dir).table("embeddings").select(F.col("embedding").alias("v"))
    return rounded(agg.class_prevalence(e, "v"), "prevalence")


@query(f"WITH p AS ({PREVALENCE}), w AS (SELECT class, 1 / greatest(prevalence, CAST(1e-6 AS DOUBLE)) AS w FROM p) SELECT class, round(w / avg(w) OVER (), 6) AS weight FROM w")
def class_weights(spark, sf_dir):
    e = Source(spark, sf_dir).table("embeddings").select(F.col("embedding").alias("v"))
    return rounded(agg.class_weights(agg.class_prevalence(e, "v")), "weight")


@query("SELECT event_type AS term, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(coalesce(stddev_samp(value), 0), 6) AS std, min(value) AS min, max(value) AS max FROM events GROUP BY 1")
def bench_stats(spark, sf_dir):
    e = Source(spark, sf_dir).table("events").select(F.col("event_type").alias("term"), "value")
    return rounded(agg.bench_stats(e, "term", "value"), "mean", "median", "std")


@query("SELECT term, round(avg(m), 6) AS mean_of_means, count(*) AS batches FROM (SELECT event_type AS term, event_id // 64 AS batch, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1")
def batch_mean_of_means(spark, sf_dir):
    e = Source(spark, sf_dir).table("events").select(F.col("event_type").alias("term"), F.floor(F.col("event_id") / 64).alias("batch"), "value")
    return rounded(agg.mean_of_means(e, ["term"], "batch", "value"), "mean_of_means")


STATS = f"SELECT stem, r, sqrt(CAST((r - g) * (r - g) + (g - b) * (g - b) AS DOUBLE)) AS c FROM ({PIXELS}) p"


@query(f"SELECT stem, count(CASE WHEN c > 90 THEN 1 END) AS n_met, round(avg(CASE WHEN c > 90 THEN r END), 6) AS mean_met, round(median(CASE WHEN c > 90 THEN CAST(r AS DOUBLE) END), 6) AS median_met, round(avg(CASE WHEN c > 90 THEN CASE WHEN r > 128 THEN CAST(1 AS DOUBLE) ELSE 0 END END), 6) AS share_over, round(avg(CASE WHEN c > 90 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS share_met FROM ({STATS}) s GROUP BY stem")
def conditional_stats(spark, sf_dir):
    p = Source(spark, sf_dir).sql(STATS)
    return rounded(agg.conditional_stats(p, "stem", "r", F.col("c") > 90, 128), "mean_met", "median_met", "share_over", "share_met")


@query(f"""
WITH p AS (SELECT stem, {CATEGORY} AS category FROM ({PIXELS}) x), n AS (SELECT stem, category, count(*) AS n FROM p GROUP BY 1, 2),
grid AS (SELECT DISTINCT p.stem, c.category FROM p CROSS JOIN (VALUES ('blue'), ('red'), ('green'), ('brown'), ('white')) AS c(category))
SELECT g.stem, g.category, coalesce(n.n, 0) AS n, round(coalesce(n.n, 0) / CAST(sum(coalesce(n.n, 0)) OVER (PARTITION BY g.stem) AS DOUBLE), 6) AS share
FROM grid g LEFT JOIN n ON g.stem = n.stem AND g.category = n.category""")
def category_zero_fill(spark, sf_dir):
    p = Source(spark, sf_dir).sql(f"SELECT stem, {CATEGORY} AS category FROM ({PIXELS}) x")
    categories = spark.createDataFrame([(c,) for c in ("blue", "red", "green", "brown", "white")], "category string")
    return rounded(agg.zero_filled(p, "stem", "category", categories), "share")


@query(f"SELECT stem, min(r) AS y0, max(r) AS y1, min(g) AS x0, max(g) AS x1 FROM ({PIXELS}) p WHERE r <> 0 OR g <> 0 OR b <> 0 GROUP BY stem")
def foreground_box(spark, sf_dir):
    p = Source(spark, sf_dir).sql(PIXELS).filter("r <> 0 or g <> 0 or b <> 0")
    return agg.bounding_box(p, "stem", "r", "g")


SETS = """
WITH RECURSIVE one AS (SELECT 'A' || CAST(range AS VARCHAR) AS c FROM range(1, 8)),
sets AS (
  SELECT '' AS name, '' AS last, 0 AS k
  UNION ALL SELECT CASE WHEN s.k = 0 THEN c ELSE s.name || '+' || c END, c, s.k + 1 FROM sets s JOIN one ON c > s.last WHERE s.k < 3),
ok AS (
  SELECT CASE WHEN k = 0 THEN 'reference' ELSE name END AS condition_name, k, name FROM sets
  WHERE CAST(contains(name, 'A1') AS INT) + CAST(contains(name, 'A2') AS INT) + CAST(contains(name, 'A6') AS INT) + CAST(contains(name, 'A7') AS INT) <= 1),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY condition_name) - 1 AS place, count(*) OVER (PARTITION BY k) AS pool,
         CASE k WHEN 0 THEN 0.2 WHEN 1 THEN 0.4 WHEN 2 THEN 0.3 ELSE 0.1 END / CAST(count(*) OVER (PARTITION BY k) AS DOUBLE) AS probability FROM ok)
"""


@query(SETS + "SELECT condition_name, k FROM numbered")
def conditions_all(spark, sf_dir):
    return cond.all_conditions(spark).select("condition_name", "k")


@query(SETS + "SELECT one.c AS code, round(sum(probability), 6) AS probability FROM numbered JOIN one ON contains(name, one.c) GROUP BY 1")
def condition_marginals(spark, sf_dir):
    return rounded(cond.marginals(cond.all_conditions(spark)), "probability")


DRAWN = """, kept AS (SELECT condition_name, k, probability / sum(probability) OVER () AS probability FROM numbered WHERE {where}),
bounds AS (SELECT *, coalesce(sum(probability) OVER (ORDER BY k, condition_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, sum(probability) OVER (ORDER BY k, condition_name) AS hi FROM kept),
drawn AS (SELECT doc_id AS stem, ((doc_id * 7919 + 13) % 100003 + 0.5) / CAST(100003 AS DOUBLE) AS u FROM labels)
SELECT d.stem, b.k, b.condition_name FROM drawn d JOIN bounds b ON d.u >= b.lo AND d.u < b.hi"""


def _drawn(spark, sf_dir, allowed=None):
    items = Source(spark, sf_dir).table("labels").select(F.col("doc_id").alias("stem"))
    u = ((F.col("stem") * 7919 + 13) % 100003 + 0.5) / F.lit(100003.0)
    return cond.draw(items, cond.all_conditions(spark), u, allowed).select("stem", "k", "condition_name")


@query(SETS + DRAWN.format(where="true"))
def condition_draw(spark, sf_dir):
    return _drawn(spark, sf_dir)


WITHOUT_A7 = [c for c in cond.CODES if c != "A7"]


@query(SETS + DRAWN.format(where="NOT contains(name, 'A7')"))
def condition_draw_without_a7(spark, sf_dir):
    return _drawn(spark, sf_dir, WITHOUT_A7)


@query(SETS + "SELECT condition_name, k, round(probability / sum(probability) OVER (), 6) AS probability FROM numbered WHERE NOT contains(name, 'A7')")
def condition_draw_restricted(spark, sf_dir):
    return rounded(cond.restricted(cond.all_conditions(spark), WITHOUT_A7).select("condition_name", "k", "probability"), "probability")


@query(f"SELECT view, family, count(*) AS n, sum(quality) AS good FROM ({ITEMS}) i GROUP BY 1, 2")
def concat_views(spark, sf_dir):
    items = Source(spark, sf_dir).sql(ITEMS)
    back, rest = items.filter("view = 'Back'"), items.filter("view <> 'Back'")
    return back.unionByName(rest).groupBy("view", "family").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY (doc_id * 2654435761 + 12345) % 4294967296, doc_id) AS r FROM documents) WHERE r <= 5")
def sample_stems(spark, sf_dir):
    """Five specimens of each family without replacement, by keyed draw (the sampling is the feature)."""
    from pyspark.sql import Window as W

    d = Source(spark, sf_dir).table("documents").select("source", "doc_id")
    r = F.row_number().over(W.partitionBy("source").orderBy((F.col("doc_id") * 2654435761 + 12345) % 4294967296, "doc_id"))
    return d.withColumn("r", r).filter("r <= 5").drop("r")


EPOCH_COUNT, RUN_SEED = 3, 42
SEED_ = "((r * 31 + key + {k} * 104729) % 2147483647)"
FEISTEL = f"xor(l, ((({SEED_} * {SEED_} % 2147483647 + {SEED_} * 48271) % 2147483647) >> 7) & mask)"
ROUND = "SELECT epoch, i, key, bits, mask, n, steps{more}, r AS l, " + FEISTEL + " AS r FROM {table}"


@query(f"""
WITH RECURSIVE items AS (SELECT stem, family, view, row_number() OVER (ORDER BY view, stem) - 1 AS i, count(*) OVER () AS n FROM ({ITEMS}) x),
size AS (SELECT n, greatest(CAST(ceil(ceil(log2(CAST(n AS DOUBLE))) / 2) AS INT), 1) AS bits FROM (SELECT max(n) AS n FROM items) m),
walk AS (
  SELECT e.epoch, i.i, ({RUN_SEED} * 104729 + e.epoch * 7919) % 2147483647 AS key, s.bits, (CAST(1 AS BIGINT) << s.bits) - 1 AS mask, s.n, 0 AS steps, i.i AS v FROM items i CROSS JOIN size s CROSS JOIN (SELECT range AS epoch FROM range({EPOCH_COUNT})) e
  UNION ALL SELECT epoch, i, key, bits, mask, n, steps + 1, (l << bits) | r FROM (
    {ROUND.format(k=3, more="", table="(" + ROUND.format(k=2, more="", table="(" + ROUND.format(k=1, more="", table="(" + ROUND.format(k=0, more="", table="(SELECT *, v >> bits AS l, v & mask AS r FROM walk WHERE steps = 0 OR v >= n) w0") + ") w1") + ") w2") + ") w3")}) w4)
SELECT w.epoch, w.v AS place, w.i AS index, i.stem, i.family, i.view, '{RUN_SEED}|' || w.epoch || '|' || w.i || '|' || i.stem AS draw_key FROM walk w JOIN items i ON w.i = i.i WHERE w.steps > 0 AND w.v < w.n""")
def training_items(spark, sf_dir):
    """Every item of the united folds in every epoch, at its place in the epoch's order, with the key of its draws."""
    items = training.dense_index(Source(spark, sf_dir).sql(ITEMS).select("stem", "family", "view"), ["view", "stem"])
    ordered_ = training.epoch_orders(items, "index", EPOCH_COUNT, RUN_SEED)
    return ordered_.select(F.col("epoch").cast("long").alias("epoch"), "place", "index", "stem", "family", "view", training.draw_key(RUN_SEED, "index", "stem").alias("draw_key"))


@query("""
WITH a AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), b AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 0)
SELECT d.doc_id AS stem FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM a INTERSECT SELECT doc_id FROM b)""")
def still_to_build(spark, sf_dir):
    """Specimens that one of two outputs lacks: what both have, taken away."""
    source = Source(spark, sf_dir)
    labels = source.table("labels").withColumnRenamed("doc_id", "stem")
    done = joins.built_everywhere([labels.filter("quality = 1"), labels.filter("toxic = 0")], ["stem"])
    return joins.not_yet_built(source.table("documents").select(F.col("doc_id").alias("stem")), done, ["stem"])


@query(f"SELECT v.stem, v.family, v.view FROM ({VIEWED}) v JOIN labels l ON v.stem = l.doc_id WHERE l.quality = 1 AND v.view <> 'Side'")
def view_semi_join(spark, sf_dir):
    """Specimens of a view-partitioned table that a fold names; only the folders of its views are read."""
    source = Source(spark, sf_dir)
    viewed = source.sql(VIEWED)
    by_view = folds.write_by_view(viewed, folder(spark, "by-view"))
    good = source.table("labels").filter("quality = 1").select(F.col("doc_id").alias("stem"))
    return folds.kept_by_view(by_view, viewed.join(good, "stem", "left_semi").filter("view <> 'Side'")).select("stem", "family", "view")


@query("""
WITH b AS (SELECT vec_id // 16 AS bag, count(*) AS n, sum(list_sum(CAST(embedding AS DOUBLE[]))) AS total FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1)
SELECT 'bag' || bag AS stem, CAST(n AS INT) AS height, round(total, 4) AS total FROM b JOIN labels l ON b.bag = l.doc_id WHERE l.quality = 1""")
def npy_round_trip(spark, sf_dir):
    """Bags of embeddings written as one file each; the files of labelled good specimens, found in a listing, are opened again."""
    source = Source(spark, sf_dir)
    spark.dataSource.register(arrays.NpyZst)
    path = folder(spark, "arrays")
    e = source.table("embeddings").filter("embedding is not null").select(F.floor(F.col("vec_id") / 16).alias("bag"), "vec_id", "embedding")

    def packed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        block = np.stack([np.asarray(v, dtype=np.float32) for v in rows.column("embedding").to_pylist()])
        return pa.table({"stem": [f"bag{rows.column('bag')[0].as_py()}"], "height": pa.array([block.shape[0]], pa.int32()), "width": pa.array([block.shape[1]], pa.int32()), "channels": pa.array([1], pa.int32()), "dtype": ["float32"], "data": [block.tobytes()]})

    e.groupBy("bag").applyInArrow(packed, arrays.SCHEMA).write.format("npyzst").mode("append").option("path", path).save()
    good = source.table("labels").filter("quality = 1").select(F.concat(F.lit("bag"), "doc_id").alias("stem"))
    wanted = [r.stem for r in arrays.listed(spark, path).join(good, "stem", "left_semi").limit(STEMS_TO_PUSH + 1).collect()]
    files = spark.read.format("npyzst").option("pushdown", "true").load(path)
    few = len(wanted) <= STEMS_TO_PUSH  # an IN list names the files; beyond, a join picks the rows

    def sums(batches):
        for batch in batches:
            totals = [float(np.frombuffer(d, np.float32).astype(np.float64).sum()) for d in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("stem"), batch.column("height"), pa.array(totals, pa.float64())], names=["stem", "height", "total"])

    with arrays.pushed_filters(spark):
        picked = files.filter(F.col("stem").isin(wanted)) if few else files.join(good, "stem", "left_semi")
        return rounded(stored(picked.mapInArrow(sums, "stem string, height int, total double"), "sums"), "total", digits=4)
