"""From label texts or detections to checked packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.text import normal
from tagloom.operators import compliance, extraction, line_classification, merging
from tagloom.sources.rules import RULES, Rule


def checked_labels(labels: DataFrame, rules: list[Rule] = RULES, one_line: bool = False) -> DataFrame:
    """labels (label_id, text and any rule inputs) with the five fields, checks, overall status and counts.

    one_line: texts are put into normal form first, which makes them one line; headings then only have values behind them. No shuffle: every step is an expression over one row.
    """
    held = labels.withColumn("text", normal(F.col("text"))) if one_line else labels
    return compliance.with_status(compliance.with_checks(extraction.extract(held), rules=rules))


def reports(checked: DataFrame) -> DataFrame:
    """label_id, overall_status, total, passed, failed and violations."""
    return checked.select("label_id", "overall_status", F.col("total_checks").alias("total"), "passed", "failed", compliance.violations(F.col("checks")).alias("violations"))


def text_of_images(detections: DataFrame, longer_side: float) -> DataFrame:
    """image_id, text from detections: repaired, merged, in reading order, each line once."""
    return merging.final_text(merging.merged_in_order(merging.kept_detections(detections), longer_side))


def checked_packages(views: DataFrame, rules: list[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """For views (package_id, view, text, confidence): checked packages, and their classified fields with confidence."""
    merged = merging.merge_views(views).withColumnRenamed("package_id", "label_id")
    sure = views.groupBy(F.col("package_id").alias("label_id")).agg(F.avg("confidence").alias("ocr_confidence"))
    fields = line_classification.classify_lines(merged, "label_id").join(sure, "label_id", "left")
    return checked_labels(merged, rules), line_classification.with_confidence(fields, F.col("ocr_confidence")).drop("ocr_confidence")
