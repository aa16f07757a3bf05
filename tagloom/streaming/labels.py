"""Labels as a stream: each arriving file of labels is checked and added to the history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tagloom.plans.packages import checked_labels
from tagloom.sources.committed import stream_batch
from tagloom.sources.history import save_scans

SCHEMA = "label_id long, text string, scanned_at timestamp"


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(path)


def checked_once(labels: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Checked labels; of a label that is sent again within the delay the first is kept, and its state is dropped once the watermark has passed."""
    return checked_labels(labels.withWatermark("scanned_at", delay).dropDuplicatesWithinWatermark(["label_id"]))


def statuses_by_window(checked: DataFrame, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """start, overall_status, n: how many labels had which status in each window of time."""
    held = checked.withWatermark("scanned_at", delay) if checked.isStreaming else checked
    return held.groupBy(F.window("scanned_at", width).alias("w"), "overall_status").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "overall_status", "n")


def run_into_history(checked: DataFrame, history: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch is added to the history once, also if it is retried; what is there already is processed, then the query ends."""

    def save(batch: DataFrame, number: int) -> None:
        save_scans(batch, history, batch=stream_batch(batch.sparkSession, checkpoint, number))

    return checked.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
