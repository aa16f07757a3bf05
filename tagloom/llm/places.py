"""Numbers rows within groups without taking a group to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import checkpointed



def placed(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows with part and seq, and (of_part, of_group, first, before, count) for each part of a group; a row's place in its group is seq - first + before.

    rows are dealt to ranges of (group, order), nulls first, and sorted there; seq rises with that order. Only one row for each range and group goes on to be summed: first is its least seq, before
    the rows of its group in earlier ranges and count all rows of its group. Rows equal in group and order are told apart by seq alone. Other columns are kept; rows must have none named
    part, seq, of_part, of_group, first, before or count.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(ranges, group, *order).sortWithinPartitions(group, *order)
    dealt = checkpointed(dealt.withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}))
    pieces = dealt.groupBy("part", group).agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("rows"))
    own = Window.partitionBy(group)
    earlier = F.coalesce(F.sum("rows").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt, pieces.select(F.col("part").alias("of_part"), F.col(group).alias("of_group"), "first", earlier.alias("before"), F.sum("rows").over(own).alias("count"))


def joined(dealt: DataFrame, pieces: DataFrame, group: str) -> DataFrame:
    """Each row with the sums of its part of its group; a part holds as many rows as any other, however large the group."""
    return dealt.join(pieces, (F.col("part") == F.col("of_part")) & F.col(group).eqNullSafe(F.col("of_group")))


def place() -> Column:
    """A row's place in its group, from 0, once its part's sums are beside it."""
    return F.col("seq") - F.col("first") + F.col("before")


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with idx (place from 0 in their group) and count (rows of the group); see placed."""
    dealt, pieces = placed(rows, group, order)
    return joined(dealt, pieces, group).select(*rows.columns, place().alias("idx"), "count")
