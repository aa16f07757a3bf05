"""Text recognition itself is a provider's work; what it gives back are detections, in the coordinates of the pass that read them."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame

from tagloom.operators import merging, passes

DETECTIONS = "image_id long, source string, det_idx int, text string, confidence double, box array<struct<x:double,y:double>>"


class Recogniser(Protocol):
    def detections(self, made: DataFrame) -> DataFrame:
        """Rows of DETECTIONS for passes (see operators.passes.passes)."""


class Given:
    """Detections that are there already."""

    def __init__(self, detections: DataFrame):
        self.held = detections

    def detections(self, made: DataFrame) -> DataFrame:
        return self.held.join(made.select("image_id", "source"), ["image_id", "source"], "left_semi")


def texts(images: DataFrame, recogniser: Recogniser) -> tuple[DataFrame, DataFrame]:
    """For images (image_id, width, height, corners): all that any pass read, once and in order (see operators.passes.read), and each image's text (image_id, text)."""
    found = passes.read(recogniser.detections(passes.passes(images)), images)
    return found, merging.final_text(found)
