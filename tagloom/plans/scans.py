"""From images to scan rows: quality, the package's boundary, whether it is straightened and turned, and the summary that a report shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions import geometry, projective
from tagloom.functions.tables import checkpointed
from tagloom.operators import images as quality
from tagloom.operators import masks, pixels

# How far corners are moved outwards, the share of an image that a straightened package must keep, and the version that scan rows name.
MARGIN, LEAST_SHARE, VERSION = 0.025, 0.55, "5.0-FULL-FRAME-SAFE"
#: Differences of grey values that count as an edge, and the share of the shorter side that a line has to have in points.
STEEP, LINE_SHARE, LINE_LEAST = 60.0, 0.2, 80

SUMMARY = (
    "image_id string, quality_score double, quality_status string, brightness double, contrast double, sharpness double, glare double, label_detected boolean, label_confidence double, detection_mode string, "
    "perspective_applied boolean, processing_mode string, deskew_angle double, scanner_version string, warnings array<string>, suggestions array<string>"
)


def outcome(found: DataFrame) -> DataFrame:
    """found (image_width, image_height, detection_mode, corners, turn) with label_detected, perspective_applied, processing_mode and deskew_angle.

    A package's corners are moved outwards a little; it is straightened if the result has enough of the image's area. The turn is only kept where lines agree on it (see pixels.skew); null: 0.
    """
    wide, high = F.col("image_width"), F.col("image_height")
    outer = (F.col("detection_mode") == "OUTER_RECTANGLE") & F.col("corners").isNotNull()
    straight = projective.straightened_for_scan(geometry.expanded(geometry.ordered_corners(F.col("corners")), MARGIN, wide, high))
    # a package that is too small to be straightened leaves the image, and so all of its area
    share = F.coalesce(straight["width"] * straight["height"] / (wide * high), F.lit(1.0))
    applied = F.coalesce(outer & (share >= LEAST_SHARE), F.lit(False))
    full = F.col("detection_mode") == "FULL_IMAGE_LABEL"
    mode = F.when(F.col("perspective_applied"), "OUTER_PACKAGE_CORRECTED").when(full, "FULL_IMAGE_LABEL").otherwise("FULL_IMAGE_PRESERVED")
    held = found.withColumns({"label_detected": F.coalesce(outer | full, F.lit(False)), "perspective_applied": applied})
    return held.withColumns({"processing_mode": mode, "deskew_angle": F.round(F.coalesce("turn", F.lit(0.0)), 3)})


def summarised(statistics: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of SUMMARY. statistics: image_id with the columns of images.STATISTICS; found: image_id with what outcome gives, and confidence."""
    scored = quality.capture_quality(statistics)
    rounded = lambda c: F.round(c, 2).alias(c)
    return scored.join(found, "image_id").select(
        "image_id", F.col("score").alias("quality_score"), F.col("status").alias("quality_status"), *map(rounded, ("brightness", "contrast", "sharpness", "glare")), "label_detected",
        F.round("confidence", 2).alias("label_confidence"), "detection_mode", "perspective_applied", "processing_mode", "deskew_angle", F.lit(VERSION).alias("scanner_version"), "warnings", "suggestions",
    )


def scans(images: DataFrame) -> DataFrame:
    """The rows of SUMMARY for images from the image source (image_id: their origin), which needn't be of one size. Packages are looked for among what is brighter than an image's own threshold."""
    # images are decoded twice, once for each table that all steps read
    statistics = checkpointed(quality.image_statistics(images).withColumnRenamed("origin", "image_id"))
    lines = checkpointed(pixels.grey_lines(images))
    sizes = statistics.select("image_id", F.col("width").alias("image_width"), F.col("height").alias("image_height"), "contrast")
    points = checkpointed(pixels.edges(lines.select("image_id", "y", "px"), STEEP))
    density = points.groupBy("image_id").agg(F.count(F.lit(1)).alias("points"))
    sizes = checkpointed(sizes.join(density, "image_id", "left").withColumn("edge_density", F.coalesce("points", F.lit(0)) / (F.col("image_width") * F.col("image_height"))))
    # an image without contrast has nothing that stands out
    told = sizes.where(F.col("contrast") >= masks.FRAME_CONTRAST).select("image_id")
    bright = pixels.otsu_lines(lines.select("image_id", "y", "px").join(told, "image_id", "left_semi"))
    mask = masks.masked(bright.select("image_id", "y", "px"), F.transform("px", lambda v: v > 0))
    bounds = masks.boundaries(masks.regions(mask), sizes)
    least = F.greatest(F.lit(LINE_LEAST), F.floor(F.least("image_width", "image_height") * LINE_SHARE))
    counted = pixels.votes(points).join(sizes.select("image_id", least.alias("least")), "image_id").where("n >= least").drop("least")
    turns = pixels.skew(pixels.peaks(counted, LINE_LEAST)).select("image_id", "turn")
    found = bounds.join(sizes.select("image_id", "image_width", "image_height"), "image_id").join(turns, "image_id", "left")
    return summarised(statistics.drop("glare").join(masks.glare(lines), "image_id"), outcome(found).select("image_id", "confidence", "detection_mode", "label_detected", "perspective_applied", "processing_mode", "deskew_angle"))
