"""Black and white images as runs: morphology by arithmetic on intervals, glare, connected regions, and the package's boundary.

A row is a line of a mask: image_id, y, width, runs (array of (a, b): pixels from a up to b are set; in order, apart from each other).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.dialect import once
from tagloom.functions.tables import checkpointed
from tagloom.operators.pixels import around, gaussian, reflect, smoothed

RUNS = "array<struct<a:int,b:int>>"
# What is bright and colourless, how much brighter than its surroundings, the kernel, and how often gaps are closed.
BRIGHT, COLOURLESS, EXCESS, KERNEL, CLOSINGS, SIGMA = 250, 18, 18.0, 7, 2, 15.0
# How a region is scored as a package, and when an image is a label as it is.
LEAST_AREA, OUTER_AREA, LEAST_FILL, GAP, LEAST_SCORE = 0.15, 0.72, 0.60, 0.12, 55.0
FRAME_WIDTH, FRAME_HEIGHT, FRAME_CONTRAST, FRAME_EDGES, FRAME_SCORE = 300, 200, 12.0, 0.008, 88.0
WEIGHTS = (0.65, 0.20, 0.15)
REASONS = {
    "OUTER_RECTANGLE": "Strong outer package boundary detected.",
    "FULL_IMAGE_LABEL": "The uploaded image is already a usable label/panel. Full image retained.",
    "UNKNOWN": "No reliable label region detected.",
}

#: Lines are this far apart in the numbers of runs, so no image may be wider.
WIDEST = 1 << 20


def ellipse(side: int) -> list[int]:
    """How far the kernel goes to each side in each of its lines."""
    r = side // 2
    return [round(r * math.sqrt((r * r - d * d) / (r * r))) if r else 0 for d in range(-r, r + 1)]


def _pair(a: Column, b: Column) -> Column:
    return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))


def masked(lines: DataFrame, test: Column) -> DataFrame:
    """lines as runs of where test, an array<boolean> column, is true; nulls aren't. Other columns stay."""

    def found(bits: Column) -> Column:
        on = lambda i: F.coalesce(F.get(bits, i), F.lit(False))
        places = F.sequence(F.lit(0), F.size(bits) - 1)
        begins, ends = F.filter(places, lambda i: on(i) & ~on(i - 1)), F.filter(places, lambda i: on(i) & ~on(i + 1))
        return F.when(F.size(bits) > 0, F.zip_with(begins, ends, lambda a, b: _pair(a, b + 1))).otherwise(F.array().cast(RUNS))

    return lines.withColumns({"runs": once(test, found), "width": F.size(test)})


def _united(runs: Column) -> Column:
    """In order, with what overlaps or touches put together."""

    def add(done: Column, q: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(_pair(last["a"], F.greatest(last["b"], q["b"]))))
        return F.when(F.size(done) == 0, F.array(q)).when(last["b"] >= q["a"], longer).otherwise(F.concat(done, F.array(q)))

    return F.aggregate(F.array_sort(runs), F.array().cast(RUNS), add)


def inverted(mask: DataFrame) -> DataFrame:
    begins = F.concat(F.array(F.lit(0)), F.transform("runs", lambda q: q["b"]))
    ends = F.concat(F.transform("runs", lambda q: q["a"]), F.array(F.col("width")))
    return mask.withColumn("runs", F.filter(F.zip_with(begins, ends, _pair), lambda q: q["a"] < q["b"]))


def dilated(mask: DataFrame, kernel: list[int]) -> DataFrame:
    """What the kernel reaches from a set pixel; beyond the image nothing is set."""
    r = len(kernel) // 2
    reach = F.array(*map(F.lit, kernel))

    def grown(near: Column) -> Column:
        wider = lambda line: F.transform(line["runs"], lambda q: _pair(F.greatest(F.lit(0), q["a"] - F.get(reach, line["y"] - F.col("y") + r)), F.least(F.col("width"), q["b"] + F.get(reach, line["y"] - F.col("y") + r))))
        return _united(F.flatten(F.transform(near, wider)))

    met = mask.withColumn("_near", F.collect_list(F.struct(F.col("y").cast("int").alias("y"), "runs")).over(around(r)))
    return met.withColumn("runs", grown(F.col("_near"))).drop("_near")


def eroded(mask: DataFrame, kernel: list[int]) -> DataFrame:
    """Where the kernel meets only set pixels; beyond the image all are taken as set."""
    return inverted(dilated(inverted(mask), kernel))


def opened(mask: DataFrame, kernel: list[int]) -> DataFrame:
    return dilated(eroded(mask, kernel), kernel)


def closed(mask: DataFrame, kernel: list[int], times: int = 1) -> DataFrame:
    """Grown that often, then shrunk as often. All of these need one shuffle together: their windows are alike."""
    for step in (dilated, eroded):
        for _ in range(times):
            mask = step(mask, kernel)
    return mask


def glare(lines: DataFrame, bright: int = BRIGHT, colourless: int = COLOURLESS, excess: float = EXCESS, kernel: int = KERNEL, sigma: float = SIGMA) -> DataFrame:
    """image_id, glare: the share in percent of pixels that shine: bright and without colour, in spots that aren't tiny, and well above their surroundings; a white label isn't glare.

    lines: image_id, y, px, value, saturation (see pixels.grey_lines).
    """
    candidate = F.zip_with("value", "saturation", lambda v, s: (v >= bright) & (s <= colourless))
    side = round(sigma * 6 + 1) | 1
    held = masked(smoothed(lines, gaussian(side, sigma), reflect, "_background"), candidate)
    shape = ellipse(kernel)
    held = closed(opened(held, shape), shape, CLOSINGS)
    above = F.zip_with("px", "_background", lambda v, m: v - m >= excess)
    within = lambda q: F.size(F.filter(F.slice("_above", q["a"] + 1, q["b"] - q["a"]), lambda x: x))
    counted = held.withColumn("_above", above).select("image_id", "width", F.aggregate(F.transform("runs", within), F.lit(0), lambda a, n: a + n).alias("n"))
    return counted.groupBy("image_id").agg((F.sum("n") * 100.0 / F.greatest(F.sum("width"), F.lit(1))).alias("glare"))


def labelled(mask: DataFrame) -> DataFrame:
    """image_id, y, a, b, region: each run with the number of its connected region (runs that meet, also at corners, in neighbouring lines); the number is that of the region's first run.

    Rounds: a run and the run it points to take the smallest number that any neighbour knows, then everyone points to where that points. The number of rounds grows slowly with the number of lines.
    """
    runs = mask.select("image_id", "y", F.explode("runs").alias("q")).select("image_id", F.col("y").cast("long").alias("y"), "q.a", "q.b")
    runs = checkpointed(runs.withColumn("node", F.col("y") * WIDEST + F.col("a")))
    above = runs.select("image_id", (F.col("y") + 1).alias("y"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("node").alias("other"))
    links = runs.join(above, ["image_id", "y"]).where("a <= b2 and a2 <= b").select("image_id", "node", "other")
    links = checkpointed(links.unionByName(links.select("image_id", F.col("other").alias("node"), F.col("node").alias("other"))))
    held, before = checkpointed(runs.select("image_id", "node", F.col("node").alias("region"))), None
    while True:
        state = held.agg(F.sum(F.col("region").cast("decimal(38,0)")).alias("s")).first().s
        if state == before:
            break
        before = state
        known = held.select("image_id", F.col("node").alias("other"), F.col("region").alias("theirs"))
        least = links.join(known, ["image_id", "other"]).groupBy("image_id", "node").agg(F.min("theirs").alias("least"))
        offered = held.join(least, ["image_id", "node"])
        both = offered.select("image_id", "node", "least").unionByName(offered.select("image_id", F.col("region").alias("node"), "least"))
        best = both.groupBy("image_id", "node").agg(F.min("least").alias("least"))
        hooked = checkpointed(held.join(best, ["image_id", "node"], "left").select("image_id", "node", F.least("region", "least").alias("region")))
        beyond = hooked.select("image_id", F.col("node").alias("region"), F.col("region").alias("further"))
        held = checkpointed(hooked.join(beyond, ["image_id", "region"]).select("image_id", "node", F.col("further").alias("region")))
    return runs.join(held, ["image_id", "node"]).select("image_id", "y", "a", "b", "region")


def regions(mask: DataFrame) -> DataFrame:
    """image_id, region, area, x, y, width, height (of the upright hull) and corners (the outermost pixels towards the four corners) of each connected region."""
    last = F.col("b") - 1
    corner = lambda by, x, pick: pick(F.struct(by.alias("by"), F.col("y").alias("y"), x.alias("x")))
    sums = labelled(mask).groupBy("image_id", "region").agg(
        F.sum(F.col("b") - F.col("a")).alias("area"), F.min("a").alias("x"), F.min("y").alias("top"), F.max("b").alias("right"), F.max("y").alias("bottom"),
        corner(F.col("a") + F.col("y"), F.col("a"), F.min).alias("tl"), corner(F.col("y") - last, last, F.min).alias("tr"),
        corner(last + F.col("y"), last, F.max).alias("br"), corner(F.col("y") - F.col("a"), F.col("a"), F.max).alias("bl"),
    )
    point = lambda c: F.struct(F.col(c)["x"].cast("double").alias("x"), F.col(c)["y"].cast("double").alias("y"))
    return sums.select(
        "image_id", "region", "area", "x", F.col("top").alias("y"), (F.col("right") - F.col("x")).alias("width"), (F.col("bottom") + 1 - F.col("top")).alias("height"), F.array(*map(point, ("tl", "tr", "br", "bl"))).alias("corners")
    )


def scored(found: DataFrame, images: DataFrame) -> DataFrame:
    """Regions (see regions) that may be a package, with area_ratio, rectangularity, edge_score and score. images: image_id, image_width, image_height."""
    met = found.join(images.select("image_id", "image_width", "image_height"), "image_id")
    wide, high = F.col("image_width"), F.col("image_height")
    gap = F.greatest(F.col("x") / wide, F.col("y") / high, (wide - F.col("x") - F.col("width")) / wide, (high - F.col("y") - F.col("height")) / high)
    shares = met.withColumns({"area_ratio": F.col("area") / (wide * high), "rectangularity": F.col("area") / (F.col("width") * F.col("height")), "edge_score": F.greatest(F.lit(0.0), 1.0 - F.least(gap / GAP, F.lit(1.0)))})
    kept = shares.where((F.col("area_ratio") >= LEAST_AREA) & (F.col("rectangularity") >= LEAST_FILL))
    area, fill, edge = WEIGHTS
    score = area * F.least(F.col("area_ratio") / OUTER_AREA, F.lit(1.0)) + fill * F.least("rectangularity", F.lit(1.0)) + edge * F.col("edge_score")
    return kept.withColumn("score", F.round(score, 8))


def boundaries(found: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, detection_mode, confidence, candidates, area_ratio (percent), corners (null unless a region is the package) and reason for each of images (image_id, image_width, image_height, contrast, edge_density).

    The best region, if it is large and sure enough, is the package; else an image that is large and not empty is a label as it is; else nothing is known. A null contrast or edge density counts as 0.
    """
    tried = scored(found, images)
    best = tried.groupBy("image_id").agg(F.count(F.lit(1)).alias("candidates"), F.max(F.struct("score", "area_ratio", (-F.col("region")).alias("first"), "corners")).alias("best"))
    met = images.join(best, "image_id", "left")
    sure = F.round(F.col("best.score") * 100, 2)
    outer = F.coalesce((F.col("best.area_ratio") >= OUTER_AREA) & (F.col("best.score") * 100 >= LEAST_SCORE), F.lit(False))
    there = lambda c, least: F.coalesce(F.col(c), F.lit(0.0)) >= least
    full = (F.col("image_width") >= FRAME_WIDTH) & (F.col("image_height") >= FRAME_HEIGHT) & (there("contrast", FRAME_CONTRAST) | there("edge_density", FRAME_EDGES))
    mode = F.when(outer, "OUTER_RECTANGLE").when(full, "FULL_IMAGE_LABEL").otherwise("UNKNOWN")
    reason = F.element_at(F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair]), F.col("detection_mode"))
    return met.select(
        "image_id", mode.alias("detection_mode"), F.when(outer, sure).when(full, FRAME_SCORE).otherwise(0.0).alias("confidence"), F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"),
        F.when(outer, F.round(F.col("best.area_ratio") * 100, 2)).when(full, 100.0).otherwise(0.0).alias("area_ratio"), F.when(outer, F.col("best.corners")).alias("corners"),
    ).withColumn("reason", reason)
