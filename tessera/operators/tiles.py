"""Blurs near sampled crops, on square tiles of the canvases.

Only tiles that a crop touches are blurred, and only tiles that their
neighbourhoods reach are built from pixels: a semi join drops the rest before
anything is gathered.  A tile sends each blurred tile just the strip that lies in
its neighbourhood, so a task never holds more than one tile and its surroundings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import kernels

_SPAN = ("y0", "y1", "x0", "x1")  # first and last row and column of a neighbourhood, all on the canvas


def reflected(at: np.ndarray, n: int) -> np.ndarray:
    """Places on a line of n that is mirrored at both ends with the end repeated, any number of times."""
    at = np.mod(at, 2 * n)
    return np.minimum(at, 2 * n - 1 - at)


def directional_mean(region: np.ndarray, first: int, wanted: np.ndarray, n: int, length: int) -> np.ndarray:
    """Means over `length` (odd) rows around the wanted rows of a mirrored line of n rows; region starts at row `first`.

    A box sum is the difference of two running sums; whole numbers, so a mean
    of half a level cannot occur.
    """
    half = length // 2
    held = region[reflected(np.arange(wanted[0] - half, wanted[-1] + half + 1), n) - first].astype(np.int64)
    running = np.concatenate([np.zeros_like(held[:1]), held.cumsum(axis=0)])
    return ((2 * (running[length:] - running[:-length]) + length) // (2 * length)).astype(np.uint8)


def _reach(first: Column, last: Column, n: Column, extra: Column, r: int) -> tuple[Column, Column]:
    """First and last place that means over `extra` mirrored places, then medians over r places, read for first..last."""
    a, b = first - extra, last + extra
    low = F.when(a < 0, F.lit(0)).when(b >= n, F.greatest(F.lit(0), F.least(a, 2 * n - 1 - b))).otherwise(a)
    high = F.when(b >= n, n - 1).when(a < 0, F.least(n - 1, F.greatest(b, -1 - a))).otherwise(b)
    return F.greatest(F.lit(0), low - r), F.least(n - 1, high + r)


def _touched(first: Column, last: Column, tile: int) -> Column:
    return F.explode(F.sequence(F.floor(first / tile).cast("int"), F.floor(last / tile).cast("int")))


def _inside(crops: DataFrame, canvases: DataFrame) -> DataFrame:
    """Crops with y0..y1, x0..x1 on their canvas; those that don't meet it, or lack a place, go."""
    met = crops.select("stem", "crop", "y", "x", "side").join(canvases, "stem")
    on = met.withColumns({"y0": F.greatest("y", F.lit(0)), "y1": F.least(F.col("y") + F.col("side"), F.col("height")) - 1, "x0": F.greatest("x", F.lit(0)), "x1": F.least(F.col("x") + F.col("side"), F.col("width")) - 1})
    return on.filter("y IS NOT NULL AND x IS NOT NULL AND side IS NOT NULL AND y0 <= y1 AND x0 <= x1")


def wanted_tiles(crops: DataFrame, canvases: DataFrame, k: int, tile: int) -> DataFrame:
    """One row for each tile to blur: stem, ty, tx, its canvas' columns and its neighbourhood y0, y1, x0, x1."""
    touched = _inside(crops, canvases).withColumn("ty", _touched(F.col("y0"), F.col("y1"), tile)).withColumn("tx", _touched(F.col("x0"), F.col("x1"), tile))
    tiles = touched.select("stem", "ty", "tx", "height", "width", "theta", "length").distinct()
    ends = {"y": ("ty", "height", 90), "x": ("tx", "width", 0)}
    for axis, (at, n, theta) in ends.items():
        extra = F.when(F.col("theta") == theta, F.floor(F.col("length") / 2)).otherwise(0).cast("int")
        last = F.least((F.col(at) + 1) * tile, F.col(n)) - 1
        low, high = _reach(F.col(at) * tile, last, F.col(n), extra, k // 2)
        tiles = tiles.withColumns({f"{axis}0": low.cast("int"), f"{axis}1": high.cast("int")})
    return tiles


def needed_strips(wanted: DataFrame, tile: int) -> DataFrame:
    """wanted, a row for each tile (sy, sx) that its neighbourhood reaches."""
    return wanted.withColumn("sy", _touched(F.col("y0"), F.col("y1"), tile)).withColumn("sx", _touched(F.col("x0"), F.col("x1"), tile))


def built(pixels: DataFrame, needed: DataFrame, tile: int) -> DataFrame:
    """stem, sy, sx, data (tile x tile x 3 bytes) of the tiles in `needed`; where pixels are missing the canvas is black.

    Of pixels with one place each channel's largest value stands; pixels that lack
    a place are left out, and a missing channel is 0.
    """
    placed = pixels.filter("y >= 0 AND x >= 0").withColumns({"sy": F.floor(F.col("y") / tile).cast("int"), "sx": F.floor(F.col("x") / tile).cast("int")})
    near = placed.join(needed.select("stem", "sy", "sx").distinct(), ["stem", "sy", "sx"], "left_semi")
    place = (F.col("y") % tile * tile + F.col("x") % tile).cast("int")
    colour = [F.coalesce(F.max(c), F.lit(0)).cast("int") for c in "rgb"]
    once = near.groupBy("stem", "sy", "sx", place.alias("place")).agg((colour[0] * 65536 + colour[1] * 256 + colour[2]).alias("colour"))
    gathered = once.groupBy("stem", "sy", "sx").agg(F.collect_list(F.struct("place", "colour")).alias("pixels"))

    def run(batches):
        for batch in batches:
            out = []
            for held in batch.column("pixels"):
                at, colours = (held.values.field(i).to_numpy() for i in range(2))
                image = np.zeros((tile * tile, 3), dtype=np.uint8)
                image[at] = (colours[:, None] >> np.array([16, 8, 0])) & 255
                out.append(image.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=["stem", "sy", "sx", "data"])

    return gathered.mapInArrow(run, f"stem {pixels.schema['stem'].dataType.simpleString()}, sy int, sx int, data binary")


def _overlap(row: dict, tile: int) -> tuple[int, int, int, int]:
    """Rows and columns (first, one past the last) that a source tile gives a neighbourhood."""
    y, x = row["sy"] * tile, row["sx"] * tile
    return max(row["y0"], y), min(row["y1"] + 1, y + tile), max(row["x0"], x), min(row["x1"] + 1, x + tile)


def blurred_tiles(pixels: DataFrame, crops: DataFrame, canvases: DataFrame, k: int = 15, tile: int = 64) -> DataFrame:
    """stem, ty, tx, data: the tiles that crops touch after a median over k x k places and the canvas' directional mean.

    pixels: stem, y, x, r, g, b; absent ones are black.  crops: stem, crop, y, x,
    side.  canvases, one row a stem: height, width, theta (0 along rows, 90 along
    columns, null for no mean) and length (odd).  k is odd; 1 leaves out the
    median.  Medians repeat the canvas' edge, means mirror it with the edge
    repeated, as if the whole canvas had been blurred.  Crops without a canvas,
    or outside it, ask for nothing.
    """
    wanted = wanted_tiles(crops, canvases, k, tile)
    strips = needed_strips(wanted, tile)
    met = strips.join(built(pixels, strips, tile), ["stem", "sy", "sx"], "left")
    fields = [f for f in met.schema if f.name != "data"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", data binary"

    def cut(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["data"] is not None:
                    ya, yb, xa, xb = _overlap(row, tile)
                    y, x = row["sy"] * tile, row["sx"] * tile
                    row["data"] = np.frombuffer(row["data"], np.uint8).reshape(tile, tile, 3)[ya - y : yb - y, xa - x : xb - x].tobytes()
                out.append(row["data"])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(out, pa.binary())], names=[*(f.name for f in fields), "data"])

    def blur(batches):
        for batch in batches:
            out = []
            for row in batch.drop_columns(["stem"]).to_pylist():
                region = np.zeros((row["y1"] - row["y0"] + 1, row["x1"] - row["x0"] + 1, 3), dtype=np.uint8)
                for part in row["parts"]:
                    if part["data"] is not None:
                        ya, yb, xa, xb = _overlap(row | part, tile)
                        region[ya - row["y0"] : yb - row["y0"], xa - row["x0"] : xb - row["x0"]] = np.frombuffer(part["data"], np.uint8).reshape(yb - ya, xb - xa, 3)
                region = kernels.median_blur(region, k) if k > 1 else region
                ys = np.arange(row["ty"] * tile, min((row["ty"] + 1) * tile, row["height"]))
                xs = np.arange(row["tx"] * tile, min((row["tx"] + 1) * tile, row["width"]))
                if row["theta"] == 90:
                    inner = directional_mean(region, row["y0"], ys, row["height"], row["length"])[:, xs - row["x0"]]
                elif row["theta"] == 0:
                    inner = directional_mean(region.swapaxes(0, 1), row["x0"], xs, row["width"], row["length"]).swapaxes(0, 1)[ys - row["y0"]]
                else:
                    inner = region[ys - row["y0"]][:, xs - row["x0"]]
                whole = np.zeros((tile, tile, 3), dtype=np.uint8)
                whole[: len(ys), : len(xs)] = inner
                out.append(whole.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("stem"), batch.column("ty"), batch.column("tx"), pa.array(out, pa.binary())], names=["stem", "ty", "tx", "data"])

    sent = met.select(*(f.name for f in fields), "data").mapInArrow(cut, schema)
    keys = ["stem", "ty", "tx", "height", "width", "theta", "length", *_SPAN]
    around = sent.groupBy(*keys).agg(F.collect_list(F.struct("sy", "sx", "data")).alias("parts"))
    return around.mapInArrow(blur, f"stem {pixels.schema['stem'].dataType.simpleString()}, ty int, tx int, data binary")


def blurred_crops(pixels: DataFrame, crops: DataFrame, canvases: DataFrame, k: int = 15, tile: int = 64) -> DataFrame:
    """stem, crop, y, x (on the canvas), r, g, b of every place of every crop, blurred as blurred_tiles does."""
    tiles = blurred_tiles(pixels, crops, canvases, k, tile)
    asked = _inside(crops, canvases).select("stem", "crop", *_SPAN)
    asked = asked.withColumn("ty", _touched(F.col("y0"), F.col("y1"), tile)).withColumn("tx", _touched(F.col("x0"), F.col("x1"), tile))
    y = F.explode(F.sequence(F.greatest(F.col("y0"), F.col("ty") * tile), F.least(F.col("y1"), (F.col("ty") + 1) * tile - 1)))
    x = F.explode(F.sequence(F.greatest(F.col("x0"), F.col("tx") * tile), F.least(F.col("x1"), (F.col("tx") + 1) * tile - 1)))
    places = asked.join(tiles, ["stem", "ty", "tx"]).withColumn("y", y).withColumn("x", x)
    at = (F.col("y") % tile * tile + F.col("x") % tile) * 3
    level = lambda c: F.conv(F.hex(F.substring("data", (at + c + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return places.select("stem", "crop", "y", "x", *(level(i).alias(c) for i, c in enumerate("rgb")))
