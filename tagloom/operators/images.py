"""Capture quality of images from their grey values: statistics, and the scores that follow from them.

Statistics of small grey images (arrays) are array expressions; those of encoded images come from Spark's image source and are computed in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds.
DARK, BRIGHT, BLURRED, FLAT, GLARE, DARK_SHARE = 45.0, 220.0, 70.0, 25.0, 8.0, 45.0
LEAST_WIDTH, LEAST_HEIGHT = 500, 400
DARK_PIXEL, DARKISH_PIXEL, BRIGHT_PIXEL = 25, 35, 245
STATISTICS = "brightness double, contrast double, sharpness double, glare double, dark double, darkish double, width int, height int"


def grey_statistics(pixels: Column, width: int, height: int) -> dict[str, Column]:
    """Of array<double> columns with width * height grey values (0 to 255), row by row: mean, population deviation, variance of the Laplacian (edges mirrored), and shares in percent."""
    n = width * height
    mean = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.lit(float(n))
    share = lambda test: F.size(F.filter(pixels, test)) * F.lit(100.0) / F.lit(float(n))
    inside = lambda i, size: abs(i) if i < size else 2 * size - 2 - i
    around = [[inside(y, height) * width + inside(x, width) for y, x in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1))] for r in range(height) for c in range(width)]
    near = F.array(*[F.array(*map(F.lit, places)) for places in around])
    laplacian = F.zip_with(pixels, near, lambda v, p: F.aggregate(p, F.lit(0.0), lambda a, i: a + F.get(pixels, i)) - 4 * v)
    average = mean(pixels)
    spread = lambda values: mean(F.transform(values, lambda v: v * v)) - mean(values) * mean(values)
    return {
        "brightness": average, "contrast": F.sqrt(F.greatest(F.lit(0.0), spread(pixels))), "sharpness": F.greatest(F.lit(0.0), spread(laplacian)),
        "glare": share(lambda v: v >= BRIGHT_PIXEL), "dark": share(lambda v: v <= DARK_PIXEL), "darkish": share(lambda v: v <= DARKISH_PIXEL), "width": F.lit(width), "height": F.lit(height),
    }


def _statistics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for origin, height, width, channels, data in batch.itertuples(index=False):
            pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(float)
            grey = pixels[..., 0] if channels == 1 else np.rint(pixels[..., 0] * 0.114 + pixels[..., 1] * 0.587 + pixels[..., 2] * 0.299)
            edged = np.pad(grey, 1, mode="reflect" if min(grey.shape) > 1 else "edge")
            laplacian = edged[:-2, 1:-1] + edged[2:, 1:-1] + edged[1:-1, :-2] + edged[1:-1, 2:] - 4 * grey
            share = lambda test: float(test.mean() * 100)
            rows.append((origin, grey.mean(), grey.std(), laplacian.var(), share(grey >= BRIGHT_PIXEL), share(grey <= DARK_PIXEL), share(grey <= DARKISH_PIXEL), width, height))
        yield pd.DataFrame(rows, columns=["origin", "brightness", "contrast", "sharpness", "glare", "dark", "darkish", "width", "height"])


def image_statistics(images: DataFrame) -> DataFrame:
    """origin and STATISTICS of rows from the image source; images that couldn't be decoded are left out."""
    rows = images.where("image.height > 0 and image.width > 0").select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return rows.mapInPandas(_statistics, f"origin string, {STATISTICS}")


def _penalised(*steps: tuple[Column, float]) -> Column:
    score = F.lit(100.0)
    for test, points in steps:
        score = score - F.when(test, points).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def _status(score: Column, good: float, fair: float, middle: str) -> Column:
    return F.when(score >= good, "GOOD").when(score >= fair, middle).otherwise("POOR")


def _texts(*pairs: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(test, text) for test, text in pairs]), lambda x: x.isNotNull())


def capture_quality(s: DataFrame) -> DataFrame:
    """Adds score, status, warnings and suggestions by the scanner's steps."""
    c = {n: F.col(n) for n in s.columns}
    small = (c["width"] < LEAST_WIDTH) | (c["height"] < LEAST_HEIGHT)
    dark, bright = c["brightness"] < DARK, c["brightness"] > BRIGHT
    blurred, flat, glare = c["sharpness"] < BLURRED, c["contrast"] < FLAT, c["glare"] > GLARE
    score = _penalised((dark, 20.0), (bright, 15.0), (blurred, 30.0), (flat, 15.0), (glare, 15.0), (small, 20.0))
    # The messages, here and below.
    warnings = _texts(
        (small, "Image resolution is low. Move closer to the package."), (dark, "Image is too dark."), (bright, "Image is too bright."), (blurred, "Image appears blurry."), (flat, "Image has low contrast."),
        (glare, "Possible strong glare detected."), (c["dark"] > DARK_SHARE, "Large dark regions detected."),
    )
    suggestions = _texts(
        (small, "Move closer to the product."), (dark, "Increase lighting."), (bright, "Reduce direct lighting."), (blurred, "Hold the camera steady."), (flat, "Use better lighting."),
        (glare, "Tilt the package slightly to remove reflections."),
    )
    return s.withColumns({"score": F.round(score, 1), "status": _status(score, 80, 55, "ACCEPTABLE"), "warnings": warnings, "suggestions": suggestions})


def reading_quality(s: DataFrame) -> DataFrame:
    """Adds score, status and warnings by the ladders that text recognition uses."""
    b, x, g = F.col("brightness"), F.col("sharpness"), F.col("glare")
    light = F.when(b < 35, 30.0).when(b < 55, 15.0).when(b < 75, 5.0).when(b > 240, 25.0).when(b > 225, 10.0).otherwise(0.0)
    blur = F.when(x < 30, 35.0).when(x < 60, 20.0).when(x < 100, 10.0).otherwise(0.0)
    shine = F.when(g > 40, 25.0).when(g > 25, 15.0).when(g > 15, 5.0).otherwise(0.0)
    score = F.greatest(F.lit(0.0), 100.0 - light - blur - shine)
    warnings = _texts((b < 50, "Image is dark."), (b > 225, "Image is overexposed."), (x < 70, "Image may be blurry."), (g > 20, "Strong glare detected."))
    return s.withColumns({"score": F.round(score, 1), "status": _status(score, 75, 50, "FAIR"), "warnings": warnings})


def continuous_quality(s: DataFrame) -> DataFrame:
    """Adds score and status by penalties in proportion to what is wrong."""
    over = lambda x, factor, most: F.least(F.lit(most), F.greatest(F.lit(0.0), x) * factor)
    b = F.col("brightness")
    score = 100.0 - over(70.0 - F.col("sharpness"), 0.20, 25.0) - over(45.0 - b, 0.35, 20.0) - over(b - 220.0, 0.25, 20.0) - over(F.col("glare"), 3.0, 20.0) - over(F.col("darkish") - 35.0, 0.25, 15.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(score, 8)))
    return s.withColumns({"score": F.round(score, 1), "status": _status(score, 75, 50, "ACCEPTABLE")})
