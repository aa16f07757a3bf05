"""A camera as a stream: images that arrive in a folder become scan rows, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tagloom.plans import scans
from tagloom.sources import committed
from tagloom.sources.images import FORMATS

IMAGE = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def read_camera(spark: SparkSession, path: str, most: int = 32) -> DataFrame:
    """image of each file that arrives at path; most: files of a micro-batch. Files must arrive whole, by renaming; what can't be decoded is left out."""
    source = spark.readStream.format("image").schema(IMAGE).option("dropInvalid", True).option("pathGlobFilter", FORMATS).option("recursiveFileLookup", True).option("maxFilesPerTrigger", most)
    return source.load(path)


def run_scans(images: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Scan rows (see plans.scans) of what has arrived are added to a committed table, a micro-batch at a time and once each; then the query ends, and the next one goes on with new files."""

    def save(batch: DataFrame, number: int) -> None:
        committed.append(scans.scans(batch).withColumn("batch", F.lit(number).cast("long")), table, committed.stream_batch(batch.sparkSession, checkpoint, number))

    return images.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_scans(spark: SparkSession, table: str) -> DataFrame:
    return committed.read(spark, table, f"{scans.SUMMARY}, batch long")
