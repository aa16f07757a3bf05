"""Tables to which several writers append whole batches, once each, with ids without gaps.

A batch is written to a folder of its own, which nobody reads yet. It becomes part of the table when its entry in the log does: entries are numbered, and only one writer can create a number. The
entry says which id the batch's first row has, so ids are known in the order of the log whoever writes. What was written but not committed (a lost driver, a second attempt) is never read.
"""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ENTRY = "number long, name string, folder string, first long, rows long, parts array<struct<part:int,before:long>>"
_PLACE = "folder string, part int, seq long"


def _file_system(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, log = _file_system(spark, f"{path}/log")
    if not fs.exists(log):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(log)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def _create_alone(spark: SparkSession, path: str, text: str) -> bool:
    """Whether this writer created the file; if another has, it stays as it is."""
    fs, place = _file_system(spark, path)
    if fs.getUri().getScheme() == "file":  # a link is whole at once, or isn't made
        target = place.toUri().getPath()
        os.makedirs(os.path.dirname(target), exist_ok=True)
        own = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
        with open(own, "w") as f:
            f.write(text)
        try:
            os.link(own, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
        return True
    try:
        out = fs.create(place, False)
    except Py4JJavaError as taken:
        if "AlreadyExists" not in taken.java_exception.getClass().getName():
            raise
        return False
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_ENTRY).json(f"{path}/log").where("number is not null")


def create(spark: SparkSession, path: str) -> None:
    """An empty table, unless there is one."""
    fs, log = _file_system(spark, f"{path}/log")
    fs.mkdirs(log)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """number, name, folder, first, rows and parts of each batch of the table, as they were committed."""
    return _log(spark, path) if _numbers(spark, path) else spark.createDataFrame([], _ENTRY)


def append(rows: DataFrame, path: str, name: str | None = None) -> bool:
    """Adds rows as one batch; whether it was added. name: of the batch; one of a name that is there already isn't added again, whatever it holds, so whoever isn't sure may repeat it."""
    spark = rows.sparkSession
    if name is not None and not commits(spark, path).where(F.col("name") == name).isEmpty():
        return False
    folder = uuid.uuid4().hex
    own = F.monotonically_increasing_id()
    placed = rows.withColumns({"part": F.spark_partition_id(), "seq": own.bitwiseAND(F.lit((1 << 33) - 1))})
    placed.write.parquet(f"{path}/rows/folder={folder}")
    counts = spark.read.schema(placed.schema).parquet(f"{path}/rows/folder={folder}").groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each task that wrote
    parts = [(r.part, r.before, r.n) for r in counts.select("part", "n", before.alias("before")).collect()]
    total = sum(n for _, _, n in parts)
    while True:
        there = _numbers(spark, path)
        last = _log(spark, path).where(F.col("number") == there[-1]).first() if there else None
        if there and last is None:  # its writer hasn't closed it yet
            continue
        # all entries up to the last one are known here; whoever adds the name from now on takes the next number, and then this writer can't
        if name is not None and there and not _log(spark, path).where(F.col("name") == name).isEmpty():
            return False
        first = last.first + last.rows if last else 1
        number = there[-1] + 1 if there else 1
        entry = {"number": number, "name": name or folder, "folder": folder, "first": first, "rows": total, "parts": [{"part": p, "before": b} for p, b, _ in parts]}
        if _create_alone(spark, f"{path}/log/{number:012d}.json", json.dumps(entry)):
            return True


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """id (from 1, without gaps) and the columns of schema of all committed batches; no row where there is no table."""
    if not _numbers(spark, path):
        return spark.createDataFrame([], f"id long, {schema}")
    rows = spark.read.schema(f"{schema}, part int, seq long, folder string").parquet(f"{path}/rows")
    starts = _log(spark, path).select("folder", "first", F.explode("parts").alias("p")).select("folder", F.col("p.part").alias("part"), (F.col("first") + F.col("p.before")).alias("start"))
    columns = [c for c in rows.columns if c not in ("part", "seq", "folder")]
    return rows.join(starts, ["folder", "part"]).select((F.col("start") + F.col("seq")).alias("id"), *columns)


def stream_batch(spark: SparkSession, checkpoint: str, number: int) -> str:
    """The name of a stream's micro-batch: the stream's own id, which lives in its checkpoint, and the batch's number. A retried batch has the same name, a new checkpoint other ones."""
    return f"{json.loads(spark.read.text(f'{checkpoint}/metadata').first().value)['id']}-{number}"
