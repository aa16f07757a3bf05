"""Confidence of field candidates and of recognised texts, from weighted evidence.

Candidates are rows; a column that isn't there, or null, is evidence that isn't there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.dialect import steady

# Weights, penalties by the gap between the two best alternatives, and bands.
WEIGHTS = {"ocr": 0.30, "semantic": 0.25, "format": 0.20, "spatial": 0.10, "context": 0.10, "consistency": 0.05}
PENALTIES = [(0.35, 0.0), (0.20, 0.05), (0.10, 0.12)]
WORST_PENALTY = 0.20
BANDS = [(0.85, "VERY HIGH"), (0.70, "HIGH"), (0.50, "MEDIUM"), (0.30, "LOW")]
LOWEST = "VERY LOW"
STRONG, WEAK, LOW = 0.70, 0.30, 0.50


def unit(x: Column) -> Column:
    """Kept between 0 and 1; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def level(score: Column) -> Column:
    band = F.lit(LOWEST)
    for least, name in reversed(BANDS):
        band = F.when(unit(score) >= least, name).otherwise(band)
    return band


def _either(columns: list[str], *names: str, default: float = 0.0) -> Column:
    """The first of these columns that isn't null, as a number."""
    return unit(F.coalesce(*[F.col(n).try_cast("double") for n in names if n in columns], F.lit(default)))


def _from_count(n: Column) -> Column:
    return unit(1 - F.exp(-n / 2.0))


def ambiguity(alternatives: Column) -> Column:
    """alternatives: array<double>. Fewer than two: nothing to mix up."""
    ordered = F.sort_array(F.filter(alternatives, lambda x: x.isNotNull()), asc=False)
    gap = F.round(F.get(ordered, 0) - F.get(ordered, 1), 8)
    penalty = F.lit(WORST_PENALTY)
    for least, worth in reversed(PENALTIES):
        penalty = F.when(gap >= least, worth).otherwise(penalty)
    return F.when(gap.isNull(), 0.0).otherwise(penalty)


def field_confidence(candidates: DataFrame) -> DataFrame:
    """Adds confidence: (score, percentage, level, components).

    Reads, as far as there: ocr_confidence or confidence_ocr; semantic_score, field_score, classification_score or score; format_score or value_format_score; spatial_score or
    relationship_score; context_score or neighbors (a number); consistency_score, occurrences or support_count; alternatives (array<double>).
    """
    c = candidates.columns
    counted = F.greatest(F.lit(1), F.coalesce(*[F.col(n).try_cast("int") for n in ("occurrences", "support_count") if n in c], F.lit(1)))
    near = F.coalesce(F.col("neighbors").try_cast("double"), F.lit(0.0)) if "neighbors" in c else F.lit(0.0)
    context = F.coalesce(unit(F.col("context_score").try_cast("double")), _from_count(near)) if "context_score" in c else _from_count(near)
    consistency = F.coalesce(unit(F.col("consistency_score").try_cast("double")), _from_count(counted)) if "consistency_score" in c else _from_count(counted)
    parts = {
        "ocr": _either(c, "ocr_confidence", "confidence_ocr"), "semantic": _either(c, "semantic_score", "field_score", "classification_score", "score"), "format": _either(c, "format_score", "value_format_score"),
        "spatial": _either(c, "spatial_score", "relationship_score"), "context": context, "consistency": consistency,
    }
    penalty = ambiguity(F.col("alternatives")) if "alternatives" in c else F.lit(0.0)
    total = sum((parts[k] * w for k, w in WEIGHTS.items()), F.lit(0.0)) - penalty
    held = candidates.withColumn("_total", unit(F.round(total, 8)))
    components = F.struct(*[steady(x, 4).alias(k) for k, x in parts.items()], steady(penalty, 4).alias("ambiguity_penalty"))
    out = F.struct(steady(F.col("_total"), 4).alias("score"), steady(F.col("_total") * 100, 1).alias("percentage"), level(F.col("_total")).alias("level"), components.alias("components"))
    return held.withColumn("confidence", out).drop("_total")


def ranked(candidates: DataFrame, *keys: str, position: str) -> DataFrame:
    """field_confidence with rank by falling score within keys; of equals the earlier position first."""
    order = Window.partitionBy(*keys).orderBy(F.desc("confidence.score"), position)
    return field_confidence(candidates).withColumn("rank", F.row_number().over(order))


def best_of_each(ranked_candidates: DataFrame) -> DataFrame:
    return ranked_candidates.where("rank = 1")


def recognition_statistics(detections: DataFrame, *keys: str) -> DataFrame:
    """keys, total_detections, average_confidence, average_confidence_percent and maximum_confidence."""
    average = F.coalesce(F.avg("confidence"), F.lit(0.0))
    return detections.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_detections"), steady(average, 4).alias("average_confidence"), steady(average * 100, 1).alias("average_confidence_percent"),
        steady(F.coalesce(F.max("confidence"), F.lit(0.0)), 4).alias("maximum_confidence"),
    )


def recognition_quality(detections: DataFrame, *keys: str) -> DataFrame:
    """keys, score, percentage, level, the average, the shares of strong and weak detections, and their number. Confidences that aren't there are 0."""
    value = unit(F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)))
    share = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    sums = detections.groupBy(*keys).agg(F.avg(value).alias("a"), share(value >= STRONG).alias("s"), share(value < WEAK).alias("w"), F.count(F.lit(1)).alias("detection_count"))
    total = unit(F.round(F.col("a") * 0.65 + F.col("s") * 0.35 - F.col("w") * 0.15, 8))
    return sums.withColumn("t", total).select(
        *keys, steady(F.col("t"), 4).alias("score"), steady(F.col("t") * 100, 1).alias("percentage"), level(F.col("t")).alias("level"), steady(F.col("a"), 4).alias("average_ocr_confidence"),
        steady(F.col("s"), 4).alias("strong_detection_ratio"), steady(F.col("w"), 4).alias("weak_detection_ratio"), "detection_count",
    )


def summarised(fields: DataFrame, *keys: str, score: str = "confidence_score") -> DataFrame:
    """keys, overall_score, overall_percentage, level, field_count, high_confidence_fields, low_confidence_fields; rows without a score don't count, and keys without any give zeros."""
    value = unit(F.col(score).try_cast("double"))
    sums = fields.groupBy(*keys).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("a"), F.count(value).alias("field_count"), F.count_if(value >= STRONG).alias("high_confidence_fields"), F.count_if(value < LOW).alias("low_confidence_fields"))
    average = F.round("a", 8)
    return sums.select(*keys, steady(average, 4).alias("overall_score"), steady(average * 100, 1).alias("overall_percentage"), level(average).alias("level"), "field_count", "high_confidence_fields", "low_confidence_fields")
