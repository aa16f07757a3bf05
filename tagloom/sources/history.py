"""Scan history and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.functions.text import shown
from tagloom.sources import committed

COLUMNS = ["product_name", "mrp", "net_quantity", "manufacturer", "address", "overall_status", "scanned_at"]
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS)
#: Ranges by which rows are numbered.
RANGES = 64


def create_history(spark: SparkSession, path: str) -> None:
    """An empty history, unless there is one."""
    committed.create(spark, path)


def history_rows(results: DataFrame, scanned_at: str | None = None) -> DataFrame:
    """What is kept of results: all columns as text; scanned_at is the given time or now, as ISO text."""
    now = F.lit(scanned_at) if scanned_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return results.select(*[F.col(c).cast("string").alias(c) for c in COLUMNS[:-1]], now.alias("scanned_at"))


def save_scans(results: DataFrame, path: str, scanned_at: str | None = None, batch: str | None = None) -> bool:
    """Adds results to the history at path as one batch, which needs no creation before; whether they were added. Ids go on from what is there without gaps, also with several writers.

    batch: a name; a batch of that name is added once, so one that may have been saved can be saved again.
    """
    return committed.append(history_rows(results, scanned_at), path, batch)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Latest first; no row where nothing was saved."""
    return committed.read(spark, path, SCHEMA).orderBy(F.desc("id"))


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows with id from 1 in the order of a column of numbers or times without repeats; nulls come first.

    Rows are dealt to ranges of that column and numbered in each; a range begins where the counts of those before it end. Only one row for each range goes through a single task.
    """
    shares = [i / RANGES for i in range(1, RANGES)]
    bounds = rows.agg(F.percentile_approx(order, shares, 1000).alias("b")).first().b or []
    place = F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    dealt = rows.withColumn("_range", F.coalesce(place, F.lit(-1)))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_before"))
    within = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(F.col(order).asc_nulls_first())))
    return within.join(before, "_range").withColumn("id", F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def export_json(results: DataFrame) -> DataFrame:
    """value: one JSON document for each row, with the extraction, the checks and the text."""
    data = F.struct(*[c for c in COLUMNS[:-2] if c in results.columns])
    checks = F.struct("overall_status", "total_checks", "passed", "failed", "review", "not_applicable", "checks")
    return results.select(F.to_json(F.struct(data.alias("product_data"), checks.alias("compliance"), F.col("text").alias("ocr_text")), {"ignoreNullFields": "false"}).alias("value"))


def export_text(results: DataFrame, path: str) -> None:
    results.select(F.coalesce("text", F.lit("")).alias("value")).write.mode("overwrite").text(path)


def shown_fields(results: DataFrame) -> DataFrame:
    """The five fields as a report shows them."""
    return results.withColumns({c: shown(F.col(c)) for c in COLUMNS[:5]})
