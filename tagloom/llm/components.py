"""Connected components of a table of links, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a long, b long); component is the smallest node that can be reached.

    Rounds of two steps, each of which keeps what is connected connected: every node tells its larger neighbours, then its
    smaller ones, about the smallest node it knows. Once nothing changes, each node is linked to its component's smallest
    node only. The number of rounds grows with the logarithm of the number of nodes. No group is collected: all of a node's
    neighbours are aggregated before the shuffle and joined back.
    """
    edges = checkpointed(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (state.n, state.x) == seen or not state.n:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = (state.n, state.x)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        # what a node knows of smaller nodes is little by now, at most one for each of its smaller neighbours: a window, not another join
        small = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = checkpointed(small.select("e.*").where("a != b").distinct())
