"""Images as tables of lines, and thresholds over them.

A row is a line of an image: image_id, y (from 0, without gaps), px (grey values from 0 to 255). What looks along a line is an array expression; what looks at lines above and below is a window over an
image's lines with a fixed number of rows, so an image is streamed by its lines and never held.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.dialect import once

# Side and offset of the adaptive threshold, and what it makes of a pixel.
SIDE, OFFSET, WHITE = 31, 8, 255

Border = Callable[[Column, Column], Column]


def replicate(i: Column, size: Column) -> Column:
    """The index that stands for i beyond the border: the nearest."""
    return F.greatest(F.lit(0), F.least(i, size - 1))


def reflect(i: Column, size: Column) -> Column:
    """The index that stands for i beyond the border: mirrored at the first and last, which aren't repeated."""
    period = F.greatest(2 * (size - 1), F.lit(1))
    within = F.pmod(i, period)
    return F.when(size <= 1, 0).when(within >= size, period - within).otherwise(within)


def gaussian(side: int, sigma: float = 0.0) -> list[float]:
    """Weights of a bell of that many pixels; without sigma it fits the side."""
    sigma = sigma or 0.3 * ((side - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((i - side // 2) ** 2) / (2 * sigma * sigma)) for i in range(side)]
    return [x / sum(raw) for x in raw]


def lines_of(images: DataFrame, px: str, width: int) -> DataFrame:
    """image_id, y, px for images (image_id and an array column with all pixels, line after line); other columns are left behind. Images without pixels have no line."""
    rows = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(px) / width).cast("int") - 1, F.lit(0))), lambda i: F.slice(px, i * width + 1, F.lit(width)))
    return images.where(F.size(px) >= width).select("image_id", F.posexplode(rows).alias("y", "px"))


def grey_lines(images: DataFrame) -> DataFrame:
    """image_id (the origin), y, px, value and saturation of each line of rows from the image source; value is the strongest channel, saturation how far the weakest is from it (0 to 255)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.float64(), pa.int32(), pa.int32()]
        for batch in batches:
            for origin, height, width, channels, data in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)[..., :3].astype(float)
                grey = pixels[..., 0] if channels == 1 else np.rint(pixels[..., 0] * 0.114 + pixels[..., 1] * 0.587 + pixels[..., 2] * 0.299)
                high = pixels.max(2)
                away = np.rint(np.divide((high - pixels.min(2)) * 255, high, out=np.zeros_like(high), where=high > 0))
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, height * width + 1, width, dtype=np.int32)), pa.array(v.ravel().astype(k.to_pandas_dtype()))) for v, k in zip((grey, high, away), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([origin] * height), pa.array(np.arange(height, dtype=np.int32)), *lists], names=["image_id", "y", "px", "value", "saturation"])

    rows = images.where("image.height > 0 and image.width > 0").select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return rows.mapInArrow(run, "image_id string, y int, px array<double>, value array<int>, saturation array<int>")


def around(radius: int) -> Window:
    return Window.partitionBy("image_id").orderBy("y").rowsBetween(-radius, radius)


def smoothed(lines: DataFrame, weights: list[float], border: Border, name: str) -> DataFrame:
    """lines with column name: px weighed along lines, then across them, rounded to whole values. weights: an odd number of them."""
    radius = len(weights) // 2
    size, weigh, zero = F.size("px"), F.array(*map(F.lit, weights)), F.lit(0.0)
    empty = F.array().cast("array<double>")
    beyond = lambda first: F.transform(F.sequence(F.lit(0), F.lit(radius - 1)), lambda k: F.get("px", border(first + k, size).cast("int")))
    padded = F.concat(beyond(F.lit(-radius)), "px", beyond(size)) if radius else F.col("px")
    near = lambda line, x: F.aggregate(F.zip_with(F.slice(line, x + 1, F.lit(len(weights))), weigh, lambda v, w: v * w), zero, lambda a, v: a + v)
    along = once(padded, lambda line: F.transform(F.sequence(F.lit(0), size - 1), lambda x: near(line, x)))
    held = lines.withColumn("_along", F.when(size > 0, along).otherwise(empty))
    height = F.count(F.lit(1)).over(Window.partitionBy("image_id"))
    met = held.withColumns({"_near": F.collect_list("_along").over(around(radius)), "_height": height})
    first = F.greatest(F.col("y") - radius, F.lit(0))
    rows = F.transform(F.sequence(F.lit(-radius), F.lit(radius)), lambda k: F.get("_near", (border(F.col("y") + k, F.col("_height")) - first).cast("int")))
    pairs = F.zip_with(rows, weigh, lambda r, w: F.struct(r.alias("r"), w.alias("w")))
    across = F.aggregate(pairs, F.transform("_along", lambda v: v * 0.0), lambda a, p: F.zip_with(a, p["r"], lambda s, v: s + v * p["w"]))
    return met.withColumn(name, F.transform(across, lambda v: F.floor(F.round(v, 6) + 0.5).cast("double"))).drop("_along", "_near", "_height")


def adaptive(lines: DataFrame, side: int = SIDE, offset: int = OFFSET) -> DataFrame:
    """lines with px as black and white: white what is brighter than its surroundings less the offset."""
    held = smoothed(lines, gaussian(side), replicate, "_mean")
    return held.withColumn("px", F.zip_with("px", "_mean", lambda v, m: F.when(v - m > -offset, float(WHITE)).otherwise(0.0))).drop("_mean")


def otsu(lines: DataFrame) -> DataFrame:
    """image_id, threshold: the grey value that separates darker from brighter pixels so that their means are farthest apart, weighed by both numbers of pixels; of equals the lowest. 0 if all pixels are alike.

    Pixels are counted by value before they meet: at most 256 rows an image go through the prefix sums.
    """
    counts = lines.select("image_id", F.explode("px").alias("v")).groupBy("image_id", "v").agg(F.count(F.lit(1)).alias("n"))
    up, whole = Window.partitionBy("image_id").orderBy("v"), Window.partitionBy("image_id")
    sums = counts.select("image_id", "v", F.sum("n").over(up).alias("n1"), F.sum(F.col("n") * F.col("v")).over(up).alias("s1"), F.sum("n").over(whole).alias("n"), F.sum(F.col("n") * F.col("v")).over(whole).alias("s"))
    rest, apart = F.col("n") - F.col("n1"), F.try_divide(F.col("s1"), F.col("n1")) - F.try_divide(F.col("s") - F.col("s1"), F.col("n") - F.col("n1"))
    between = F.coalesce(F.round(F.col("n1") * rest * apart * apart, 6), F.lit(0.0))
    best = sums.groupBy("image_id").agg(F.max(F.struct(between.alias("between"), (-F.col("v")).alias("v"))).alias("best"))
    return best.select("image_id", F.when(F.col("best.between") > 0, -F.col("best.v")).otherwise(0.0).cast("long").alias("threshold"))


def otsu_lines(lines: DataFrame) -> DataFrame:
    """lines with px as black and white by each image's own threshold."""
    return lines.join(otsu(lines), "image_id").withColumn("px", F.transform("px", lambda v: F.when(v > F.col("threshold"), float(WHITE)).otherwise(0.0))).drop("threshold")


def edges(lines: DataFrame, least: float) -> DataFrame:
    """image_id, x, y of each pixel that differs by least or more from the one to its right or below it."""
    below = F.lead("px").over(Window.partitionBy("image_id").orderBy("y"))
    held = lines.withColumn("_below", F.coalesce(below, F.col("px")))
    size = F.size("px")
    steep = lambda i: F.greatest(F.abs(F.get("px", F.least(i + 1, size - 1)) - F.get("px", i)), F.abs(F.get("_below", i) - F.get("px", i))) >= least
    at = F.filter(F.sequence(F.lit(0), size - 1), steep)
    return held.where(size > 0).select("image_id", F.explode(at).alias("x"), "y")


# Turns up to this many degrees are looked for, in such steps; smaller ones than the least are left, and so many lines at least have to agree.
MOST_TURN, TURN_STEP, LEAST_TURN, LEAST_LINES = 3.0, 0.25, 0.5, 3


def votes(points: DataFrame) -> DataFrame:
    """image_id, turn (degrees), rho, n: how many points lie on the nearly level, or nearly upright, line with that turn and distance. upright tells them apart."""
    turns = [round(-MOST_TURN + TURN_STEP * i, 4) for i in range(round(2 * MOST_TURN / TURN_STEP) + 1)]
    bins = F.array(*[F.struct(F.lit(t).alias("turn"), F.lit(math.cos(math.radians(t))).alias("c"), F.lit(math.sin(math.radians(t))).alias("s")) for t in turns])
    met = points.select("image_id", "x", "y", F.explode(bins).alias("b"))
    level, upright = F.col("y") * F.col("b.c") - F.col("x") * F.col("b.s"), F.col("x") * F.col("b.c") + F.col("y") * F.col("b.s")
    rho = lambda v: F.floor(F.round(v, 6) + 0.5).cast("long")
    both = F.array(F.struct(F.lit(False).alias("upright"), rho(level).alias("rho")), F.struct(F.lit(True).alias("upright"), rho(upright).alias("rho")))
    return met.select("image_id", F.col("b.turn").alias("turn"), F.explode(both).alias("line")).groupBy("image_id", "turn", "line.upright", "line.rho").agg(F.count(F.lit(1)).alias("n"))


def peaks(counted: DataFrame, least: int) -> DataFrame:
    """The lines with least votes or more that no line of a neighbouring turn or distance beats; of equals the one with the smaller turn and distance."""
    strong = counted.where(F.col("n") >= least)
    step = F.round(F.col("turn") / TURN_STEP).cast("int")
    numbered = strong.withColumn("step", step)
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    spread = numbered.select("image_id", "upright", "n", "step", "rho", F.explode(moves).alias("m"))
    spread = spread.select("image_id", "upright", (F.col("step") + F.col("m.a")).alias("step"), (F.col("rho") + F.col("m.b")).alias("rho"), F.struct("n", (-F.col("step")).alias("s"), (-F.col("rho")).alias("r")).alias("rival"))
    rivals = spread.groupBy("image_id", "upright", "step", "rho").agg(F.max("rival").alias("rival"))
    met = numbered.join(rivals, ["image_id", "upright", "step", "rho"], "left")
    return met.where(F.col("rival").isNull() | (F.struct("n", (-F.col("step")).alias("s"), (-F.col("rho")).alias("r")) > F.col("rival"))).select("image_id", "turn", "upright", "rho", "n")


def skew(found: DataFrame) -> DataFrame:
    """image_id, lines, turn, turned: of an image's lines (see peaks) the median turn, and whether it is to be turned back. With less than three lines the turn is 0. Images without a line have no row."""
    sums = found.groupBy("image_id").agg(F.count(F.lit(1)).alias("lines"), F.percentile("turn", F.lit(0.5)).alias("median"))
    turn = F.when(F.col("lines") >= LEAST_LINES, F.col("median")).otherwise(0.0)
    return sums.select("image_id", "lines", turn.alias("turn"), (F.abs(turn) >= LEAST_TURN).alias("turned"))
