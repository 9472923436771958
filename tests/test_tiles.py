"""Blurs near crops against blurs of whole canvases."""

import numpy as np
import pytest

from tessera.functions import kernels
from tessera.operators import tiles

PIXEL = "stem string, y int, x int, r int, g int, b int"
CANVAS = "stem string, height int, width int, theta int, length int"
CROP = "stem string, crop int, y int, x int, side int"


def whole(image, k, theta, length):
    """The canvas blurred as a whole, place by place."""
    image = kernels.median_blur(image, k) if k > 1 else image
    if theta is None:
        return image
    lines = image if theta == 90 else image.swapaxes(0, 1)
    out = np.empty_like(lines)
    n = len(lines)
    for i in range(n):
        held = []
        for at in range(i - length // 2, i + length // 2 + 1):
            while not 0 <= at < n:
                at = -1 - at if at < 0 else 2 * n - 1 - at
            held.append(lines[at].astype(float))
        out[i] = np.rint(np.mean(held, axis=0))
    return out if theta == 90 else out.swapaxes(0, 1)


def rows_of(stem, image):
    return [(stem, y, x, *map(int, image[y, x])) for y, x in np.argwhere(image.any(axis=2)).tolist()]


@pytest.mark.parametrize("tile", [16, 64])
def test_equals_the_whole_canvas(spark, tile):
    """Edges, means longer than the canvas (mirrored several times), canvases that tiles don't divide, and a black one."""
    rng = np.random.default_rng(1)
    shapes = {"rows": (40, 53, 0, 17), "columns": (53, 40, 90, 33), "mirrored": (9, 70, 90, 41), "plain": (30, 30, None, None), "black": (20, 20, 0, 17)}
    pixels, want, crops = [], {}, []
    for stem, (h, w, theta, length) in shapes.items():
        image = rng.integers(0, 256, (h, w, 3)).astype(np.uint8) if stem != "black" else np.zeros((h, w, 3), np.uint8)
        image[rng.random((h, w)) < 0.3] = 0
        pixels += rows_of(stem, image)
        blurred = whole(image, 5, theta, length)
        for crop, (y, x) in enumerate([(0, 0), (h - 9, w - 9), (0, w - 9), (max(0, h // 2 - 4), w // 2 - 4)]):
            crops.append((stem, crop, y, x, 9))
            want |= {(stem, crop, y + i, x + j): tuple(map(int, blurred[y + i, x + j])) for i in range(9) for j in range(9)}
    got = tiles.blurred_crops(spark.createDataFrame(pixels, PIXEL), spark.createDataFrame(crops, CROP), spark.createDataFrame([(s, *v) for s, v in shapes.items()], CANVAS), 5, tile).collect()
    assert {(r.stem, r.crop, r.y, r.x): (r.r, r.g, r.b) for r in got} == want and len(got) == len(want)


def test_only_near_tiles_are_built(spark):
    """A crop inside one tile asks for the tiles within its reach, however large the canvas is."""
    crops = spark.createDataFrame([("a", 0, 40, 40, 8)], CROP)
    canvases = spark.createDataFrame([("a", 640, 640, 0, 17), ("b", 640, 640, 0, 17)], CANVAS)
    strips = tiles.needed_strips(tiles.wanted_tiles(crops, canvases, 15, 32), 32)
    assert {(r.stem, r.sy, r.sx) for r in strips.collect()} == {("a", y, x) for y in (0, 1, 2) for x in (0, 1, 2)}
    pixels = spark.range(640 * 640).selectExpr("'a' AS stem", "CAST(id div 640 AS INT) AS y", "CAST(id % 640 AS INT) AS x", "1 AS r", "2 AS g", "3 AS b")
    assert tiles.built(pixels, strips, 32).count() == 9


def test_odd_rows(spark):
    """Nulls, repeated places, places off the canvas, extra columns, crops partly or wholly outside, and no rows at all."""
    pixels = [("a", 1, 1, 9, None, 3), ("a", 1, 1, 4, 7, 3), ("a", None, 1, 9, 9, 9), (None, 1, 1, 9, 9, 9), ("a", 2, 2, None, None, None), ("a", -1, 0, 9, 9, 9), ("a", 50, 50, 9, 9, 9)]
    crops = [("a", 0, -1, -1, 4), ("a", 1, 90, 90, 4), ("a", 2, None, 0, 4), ("z", 0, 0, 0, 4), (None, 0, 0, 0, 4)]
    canvas = spark.createDataFrame([("a", 5, 5, None, None)], CANVAS)
    df, asked = spark.createDataFrame(pixels, PIXEL).selectExpr("*", "1 AS tile", "2 AS data"), spark.createDataFrame(crops, CROP).selectExpr("*", "3 AS height", "4 AS ty")
    got = {(r.crop, r.y, r.x): (r.r, r.g, r.b) for r in tiles.blurred_crops(df, asked, canvas, 1, 4).collect()}
    assert got == {(0, y, x): (9, 7, 3) if (y, x) == (1, 1) else (0, 0, 0) for y in range(3) for x in range(3)}
    assert tiles.blurred_crops(df.limit(0), asked, canvas, 3, 4).count() == 9
    assert tiles.blurred_crops(df, asked.limit(0), canvas, 3, 4).count() == 0
