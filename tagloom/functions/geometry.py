"""Boxes of four points, as array<struct<x:double,y:double>> columns, and regions of an image."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grid and regions that are read again, and how near boxes count as one place.
TILE_ROWS = TILE_COLUMNS = 3
TILE_OVERLAP = 0.18
CLOSE, NEARBY, RELATED = 0.035, 0.12, 0.15


def upright_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h))


def _mean(box: Column, axis: str) -> Column:
    return F.when(F.size(box) > 0, F.aggregate(box, F.lit(0.0), lambda a, p: a + p[axis]) / F.size(box)).otherwise(0.0)


def center(box: Column) -> Column:
    """Mean of the points; null and empty boxes: (0, 0)."""
    return F.struct(_mean(box, "x").alias("x"), _mean(box, "y").alias("y"))


def extent(box: Column, axis: str) -> Column:
    values = F.transform(box, lambda p: p[axis])
    return F.coalesce(F.array_max(values) - F.array_min(values), F.lit(0.0))


def width(box: Column) -> Column:
    return extent(box, "x")


def height(box: Column) -> Column:
    return extent(box, "y")


def area(box: Column) -> Column:
    """Of the polygon, from the cross products of neighbouring corners."""
    following = F.concat(F.slice(box, 2, F.greatest(F.size(box) - 1, F.lit(1))), F.slice(box, 1, 1))
    crossed = F.zip_with(box, following, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.coalesce(F.abs(F.aggregate(crossed, F.lit(0.0), lambda a, c: a + c)) / 2, F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of the upright hulls; nothing to unite: 0."""
    low = lambda box, axis: F.array_min(F.transform(box, lambda p: p[axis]))
    high = lambda box, axis: F.array_max(F.transform(box, lambda p: p[axis]))
    side = lambda axis: F.greatest(F.lit(0.0), F.least(high(a, axis), high(b, axis)) - F.greatest(low(a, axis), low(b, axis)))
    common = side("x") * side("y")
    union = width(a) * height(a) + width(b) * height(b) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def distance(a: Column, b: Column) -> Column:
    """Between centers (structs of x and y)."""
    return F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))


def close(a: Column, b: Column, longer_side: Column) -> Column:
    return distance(a, b) <= longer_side * CLOSE


def from_crop(box: Column, offset_x: Column, offset_y: Column, scale_x: Column, scale_y: Column) -> Column:
    """A box in an enlarged crop, in the image's coordinates."""
    return F.transform(box, lambda p: F.struct((p["x"] / scale_x + offset_x).alias("x"), (p["y"] / scale_y + offset_y).alias("y")))


def unrotated(box: Column, angle: Column, image_width: Column, image_height: Column) -> Column:
    """A box in an image turned by 90, 180 or 270 degrees, in the original's coordinates; other angles change nothing."""

    def turn(p: Column) -> Column:
        x, y = p["x"], p["y"]
        back_x = F.when(angle == 90, y).when(angle == 180, image_width - 1 - x).when(angle == 270, image_width - 1 - y).otherwise(x)
        back_y = F.when(angle == 90, image_height - 1 - x).when(angle == 180, image_height - 1 - y).when(angle == 270, x).otherwise(y)
        return F.struct(back_x.cast("double").alias("x"), back_y.cast("double").alias("y"))

    return F.transform(box, turn)


def ordered_corners(box: Column) -> Column:
    """Top left, top right, bottom right, bottom left, by the sum and the difference of the coordinates."""
    by = lambda key: F.transform(F.array_sort(F.transform(box, lambda p: F.struct(key(p).alias("k"), p["x"].alias("x"), p["y"].alias("y")))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))
    total, across = by(lambda p: p["x"] + p["y"]), by(lambda p: p["y"] - p["x"])
    return F.array(F.get(total, 0), F.get(across, 0), F.element_at(total, -1), F.element_at(across, -1))


def expanded(box: Column, share: float, image_width: Column, image_height: Column) -> Column:
    """Moved outwards from the center by a share of the way, and kept inside the image."""
    mean_x, mean_y = _mean(box, "x"), _mean(box, "y")
    out = lambda v, mean, most: F.least(F.greatest(v + (v - mean) * share, F.lit(0.0)), most - 1.0)
    return F.transform(box, lambda p: F.struct(out(p["x"], mean_x, image_width).alias("x"), out(p["y"], mean_y, image_height).alias("y")))


def tiles(image_width: Column, image_height: Column) -> Column:
    """array of (name, x, y, width, height): a grid of overlapping tiles, clipped to the image; empty tiles are left out."""
    side = lambda size, n: F.floor(size / n)
    tw, th = side(image_width, TILE_COLUMNS), side(image_height, TILE_ROWS)
    found = []
    for r in range(TILE_ROWS):
        for c in range(TILE_COLUMNS):
            whole = lambda v: v.cast("long")  # noqa: E731  towards zero
            x1, y1 = F.greatest(whole(c * tw - tw * TILE_OVERLAP), F.lit(0)), F.greatest(whole(r * th - th * TILE_OVERLAP), F.lit(0))
            x2, y2 = F.least(whole((c + 1) * tw + tw * TILE_OVERLAP), image_width), F.least(whole((r + 1) * th + th * TILE_OVERLAP), image_height)
            found.append(F.struct(F.lit(f"tile_{r}_{c}").alias("name"), x1.alias("x"), y1.alias("y"), (x2 - x1).alias("width"), (y2 - y1).alias("height")))
    return F.filter(F.array(*found), lambda t: (t["width"] > 0) & (t["height"] > 0))


def regions(image_width: Column, image_height: Column) -> Column:
    """array of (name, x, y, width, height): the parts where declarations are often found."""
    part = lambda size, share: (size * share).cast("long")
    low, high, middle = part(image_height, 0.55), part(image_height, 0.45), part(image_width, 0.5)
    zero = F.lit(0).cast("long")
    row = lambda name, x, y, w, h: F.struct(F.lit(name).alias("name"), x.cast("long").alias("x"), y.cast("long").alias("y"), w.cast("long").alias("width"), h.cast("long").alias("height"))
    found = F.array(
        row("bottom_region", zero, low, image_width, image_height - low), row("top_region", zero, zero, image_width, high),
        row("left_region", zero, zero, middle, image_height), row("right_region", middle, zero, image_width - middle, image_height),
    )
    return F.filter(found, lambda t: (t["width"] > 0) & (t["height"] > 0))


def evidence_label(text: Column, confidence: Column) -> Column:
    """What is written next to a box: the text's beginning and the confidence."""
    return F.format_string("%s (%.0f%%)", F.substring(F.trim(F.coalesce(text, F.lit(""))), 1, 28), F.coalesce(confidence, F.lit(0.0)) * 100)


# Bounds of an image's width or sides, in pixels.
WIDEST, LONGEST_READ, SHORTEST_READ, LONGEST_SMOOTHED = 2200, 2800, 1100, 2200


def _size(width: Column, height: Column) -> Column:
    return F.struct(width.cast("long").alias("width"), height.cast("long").alias("height"))


def scan_size(width: Column, height: Column) -> Column:
    """(width, height) of an image for the scanner: not wider than `WIDEST`."""
    scale = F.lit(float(WIDEST)) / width
    return F.when(width <= WIDEST, _size(width, height)).otherwise(_size(F.floor(width * scale), F.floor(height * scale)))


def smoothed_size(width: Column, height: Column) -> Column:
    """(width, height) of an image for smoothing: no side over `LONGEST_SMOOTHED`, none below 1."""
    scale = F.lit(float(LONGEST_SMOOTHED)) / F.greatest(width, height)
    return F.when(F.greatest(width, height) <= LONGEST_SMOOTHED, _size(width, height)).otherwise(_size(F.greatest(F.lit(1), F.floor(width * scale)), F.greatest(F.lit(1), F.floor(height * scale))))


def reading_size(width: Column, height: Column) -> Column:
    """(width, height) of an image for recognition: large ones shrink to `LONGEST_READ`, small ones grow to `SHORTEST_READ` as far as that bound lets them; null without a side."""
    at_least_1 = lambda x: F.greatest(F.lit(1), x)
    down, up = F.lit(float(LONGEST_READ)) / F.greatest(width, height), F.lit(float(SHORTEST_READ)) / F.least(width, height)
    shrunk = _size(at_least_1(F.floor(width * down)), at_least_1(F.floor(height * down)))
    wide, high = F.floor(width * up), F.floor(height * up)
    limit = F.least(F.lit(1.0), F.lit(float(LONGEST_READ)) / F.greatest(wide, high))
    grown = _size(at_least_1(F.floor(wide * limit)), at_least_1(F.floor(high * limit)))
    usual = F.when(F.greatest(width, height) > LONGEST_READ, shrunk).when(F.least(width, height) < SHORTEST_READ, grown).otherwise(_size(width, height))
    return F.when((width > 0) & (height > 0), usual)
