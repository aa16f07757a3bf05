"""Images as tables; views of one package share a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = "*.{jpg,jpeg,png,JPG,JPEG,PNG}"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """image (origin, height, width, nChannels, mode, data) of every file that can be decoded."""
    return spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", FORMATS).option("recursiveFileLookup", True).load(path)


def package_views(images: DataFrame) -> DataFrame:
    """package_id (the folder), view (the file's name) and image."""
    path = F.split("image.origin", "/")
    return images.select(F.element_at(path, -2).alias("package_id"), F.element_at(path, -1).alias("view"), "image")
