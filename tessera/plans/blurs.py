"""Blurs near sampled crops as registered queries; line items are the pixels of canvases of 2,048 orders each."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import tiles

from .registry import Source, query

HEIGHT, WIDTH, SIDE = 64, 128, 24
PLACED = f"""
SELECT l_orderkey // 2048 AS stem, CAST(((l_orderkey % 2048) * 4 + l_linenumber % 4) // {WIDTH} AS INT) AS y, CAST(((l_orderkey % 2048) * 4 + l_linenumber % 4) % {WIDTH} AS INT) AS x,
       CAST((l_orderkey * 7 + l_linenumber * 31) % 256 AS INT) AS r, CAST((l_partkey * 13 + l_linenumber * 17) % 256 AS INT) AS g, CAST((l_suppkey * 29 + l_orderkey * 3) % 256 AS INT) AS b
FROM lineitem"""
CROPS = f"""
SELECT s.stem, c.crop, CAST((s.stem * 29 + c.crop * 20) % {HEIGHT - SIDE + 1} AS INT) AS y, CAST((s.stem * 41 + c.crop * c.crop * 26) % {WIDTH - SIDE + 1} AS INT) AS x, {SIDE} AS side,
       {HEIGHT} AS height, {WIDTH} AS width, CAST(s.stem % 2 * 90 AS INT) AS theta, CAST(17 + s.stem * 5 % 43 * 2 AS INT) AS length
FROM (SELECT DISTINCT l_orderkey // 2048 AS stem FROM lineitem) s CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2)) v(crop)) c"""

# Every place of every crop, and what a directional mean reads for it: mirrored places, the edge repeated.
READ = f"""
crops AS ({CROPS}), canvas AS (SELECT stem, y, x, max(r) AS r, max(g) AS g, max(b) AS b FROM ({PLACED}) p GROUP BY ALL),
places AS (SELECT stem, crop, theta, length, y + dy AS py, x + dx AS px FROM crops, (SELECT range AS dy FROM range({SIDE})), (SELECT range AS dx FROM range({SIDE}))),
steps AS (SELECT p.*, py + CASE WHEN theta = 90 THEN o - length // 2 ELSE 0 END AS ry, px + CASE WHEN theta = 0 THEN o - length // 2 ELSE 0 END AS rx FROM places p, (SELECT range AS o FROM range(101)) WHERE o < length),
reads AS (SELECT stem, crop, length, py, px, CASE WHEN ry < 0 THEN -1 - ry WHEN ry >= {HEIGHT} THEN 2 * {HEIGHT} - 1 - ry ELSE ry END AS y, CASE WHEN rx < 0 THEN -1 - rx WHEN rx >= {WIDTH} THEN 2 * {WIDTH} - 1 - rx ELSE rx END AS x FROM steps)"""
MEAN = ", ".join(f"CAST((2 * sum(coalesce(c.{n}, 0)) + r.length) // (2 * r.length) AS INT) AS {n}" for n in "rgb")
MIDDLE = ", ".join(f"CAST(list_sort(list(coalesce(c.{n}, 0)))[113] AS INT) AS {n}" for n in "rgb")
SHOWN = "SELECT r.stem, r.crop, CAST(r.py AS INT) AS y, CAST(r.px AS INT) AS x"


def _blurred(spark, sf_dir, k: int, mean: bool = True):
    source = Source(spark, sf_dir)
    crops = source.sql(CROPS.replace("//", "DIV")).drop("height", "width", "theta", "length")
    stems = source.table("lineitem").select(F.floor(F.col("l_orderkey") / 2048).alias("stem")).distinct()
    number = lambda c: c.cast("int")
    canvases = stems.select("stem", F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width"), number(F.col("stem") % 2 * 90 if mean else F.lit(None)).alias("theta"), number(17 + F.col("stem") * 5 % 43 * 2).alias("length"))
    return tiles.blurred_crops(source.sql(PLACED.replace("//", "DIV")), crops, canvases, k, 32)


@query(f"WITH {READ} {SHOWN}, {MEAN} FROM reads r LEFT JOIN canvas c ON c.stem = r.stem AND c.y = r.y AND c.x = r.x GROUP BY r.stem, r.crop, r.length, r.py, r.px")
def tile_directional_mean(spark, sf_dir):
    """The directional mean alone, in crops at the canvas' edges and inside."""
    return _blurred(spark, sf_dir, 1)


WINDOW = f"""
w AS (SELECT m.stem, m.y, m.x, least(greatest(m.y + dy, 0), {HEIGHT - 1}) AS wy, least(greatest(m.x + dx, 0), {WIDTH - 1}) AS wx FROM spots m, (SELECT range - 7 AS dy FROM range(15)), (SELECT range - 7 AS dx FROM range(15))),
middle AS (SELECT w.stem, w.y, w.x, {MIDDLE} FROM w LEFT JOIN canvas c ON c.stem = w.stem AND c.y = w.wy AND c.x = w.wx GROUP BY w.stem, w.y, w.x)"""


@query(f"WITH {READ}, spots AS (SELECT DISTINCT stem, y, x FROM reads), {WINDOW} {SHOWN}, {MEAN} FROM reads r JOIN middle c ON c.stem = r.stem AND c.y = r.y AND c.x = r.x GROUP BY r.stem, r.crop, r.length, r.py, r.px")
def tile_blur_near_crops(spark, sf_dir):
    """The median over 15 x 15 places, then the directional mean, only where crops need them."""
    return _blurred(spark, sf_dir, 15)


@query(f"WITH {READ}, spots AS (SELECT DISTINCT stem, py AS y, px AS x FROM places), {WINDOW} SELECT r.stem, r.crop, CAST(r.py AS INT) AS y, CAST(r.px AS INT) AS x, c.r, c.g, c.b FROM places r JOIN middle c ON c.stem = r.stem AND c.y = r.py AND c.x = r.px")
def tile_median(spark, sf_dir):
    """The median alone."""
    return _blurred(spark, sf_dir, 15, mean=False)
