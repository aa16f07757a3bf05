"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source should be taken target / size of its source times. The whole part is taken as it is; the fractions
are rounded in pairs: a random amount of words moves from one side to the other, in either direction with chances that
leave all expectations alone, such that one of the two fractions becomes 0 or 1. So a source's total never changes. The sides are a document and all smaller ones of its node, so
that a node is left with one open document, in general its smallest; those of up to `FAN` nodes meet in a node of the next level of a tree, and what is rounded without a partner at its root is small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.llm.common import NULL_ID, U64, WORD_PATTERN, checkpointed, documents, free_name, in_arrow, mix

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
FAN = 128
SEED = 20240611
CLOSE = 1e-9

_ROUNDED = "source_rank int, node long, key long, words long, whole int, part double, number int, settled boolean"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, n_docs, source_rank (0 for the first by code point, null last) and target of each source in sizes (source, words).

    Targets share `share` of all words by weight, the weights repeating in the order of sources; none is above `most` times its source's size,
    and what that leaves is shared by weight again: target = min(most * size, level * weight), where level makes the sum right. The windows run over one row for each source.
    """
    sources = sizes.groupBy("source").agg(F.sum("words").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranked = sources.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_rank") % len(weights)) + 1)
    ranked = ranked.withColumns({"weight": weight, "most": most * F.col("source_size")}).withColumn("bound", F.col("most") / F.col("weight"))
    order = Window.orderBy("bound", "source_rank")
    filled = ranked.withColumns({
        "spent": F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        "all_words": F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    }).withColumn("level", (share * F.col("all_words") - F.col("spent")) / F.col("open"))
    level = F.min(F.when(F.col("level") <= F.col("bound"), F.struct("bound", "source_rank", "level"))).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    reached = filled.withColumn("reached", level.getField("level"))
    return reached.select("source", "source_size", "n_docs", "source_rank", F.when(F.col("reached").isNull(), F.col("most")).otherwise(F.least("most", F.col("reached") * F.col("weight"))).alias("target"))


def _random(keys: np.ndarray, numbers: np.ndarray, level: int) -> np.ndarray:
    """So many numbers in [0, 1); each depends on a document, on the one that follows, and on the level only."""
    x = np.full(len(keys), SEED, U64)
    for part in (keys, numbers, np.roll(keys, -1), np.roll(numbers, -1), np.full(len(keys), level)):
        with np.errstate(over="ignore"):
            x = mix(x * U64(3) + part.astype(np.int64).view(U64))
    return (x >> U64(11)) / 2**53


def _whole(x: float) -> float:
    return 0.0 if x < CLOSE else 1.0 if x > 1 - CLOSE else x


def pivot(first: tuple[float, int], second: tuple[float, int], u: float) -> tuple[float, float]:
    """New fractions of two documents, given (fraction, words) of each: their words stay the same in sum, and one fraction becomes 0 or 1."""
    (p, s), (q, t) = first, second
    up, down = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
    move = up if u * (up + down) < down else -down
    return _whole(p + move / s), _whole(q - move / t)


def rounded(words: np.ndarray, parts: np.ndarray, u: np.ndarray, last: bool) -> np.ndarray:
    """New fractions of a node's documents, which come by falling size; all but one become 0 or 1, and all do where `last`.

    Each document in turn makes a pair with those open ones that follow: what it gets or gives is spread over them by q (1 - q) of each fraction q, so every expectation stays, until it or one of them is 0 or 1. Smaller
    ones together settle a larger one, so what is left open is small in general. u has a random number for each step. Where `last`, a document that those can't settle both ways goes the way that leaves fewer
    words wrong, and if words are wrong in the end, the one document or the two (one each way) whose turn leaves fewest are turned.
    """
    out, step = np.array(parts, float), 0
    for i, s in enumerate(words):
        q, t = out[i + 1 :], words[i + 1 :]
        while 0 < (p := out[i]) < 1:
            live = (q > 0) & (q < 1)
            has, lacks = float((q * t)[live].sum()), float(((1 - q) * t)[live].sum())
            missing = np.array([(1 - p) * s - has, p * s - lacks])
            if last and missing.max() > CLOSE * s:
                up = missing[0] <= missing[1]
                out[i] = float(up)
                if up and has:
                    q[live] *= 1 - min((1 - p) * s / has, 1.0)
                elif not up and lacks:
                    q[live] = 1 - (1 - q[live]) * (1 - min(p * s / lacks, 1.0))
            elif not live.any():
                break
            else:
                share = q * (1 - q)
                share /= share @ t
                give, get = 1 / (share[live] / q[live]).max(), 1 / (share[live] / (1 - q[live])).max()
                out[i], _ = pivot((p, s), (give / (give + get), give + get), u[step])
                q -= (out[i] - p) * s * share
                step += 1
            q[q < CLOSE], q[q > 1 - CLOSE] = 0.0, 1.0
    return _nearest(words, out, float(words @ parts)) if last else out


def _nearest(words: np.ndarray, parts: np.ndarray, goal: float) -> np.ndarray:
    """Whole fractions whose words are nearest to the goal, from such fractions by a turn of one document or of one each way; as they are, where no turn comes nearer."""
    off, out = float(words @ parts) - goal, parts.copy()
    give, get = np.flatnonzero(out == 1), np.flatnonzero(out == 0)
    change = np.append(-words[give], 0)[:, None] + np.append(words[get], 0)
    i, j = np.unravel_index(np.argmin(np.abs(off + change)), change.shape)
    if abs(off + change[i, j]) < abs(off) - CLOSE:
        out[give[i : i + 1]], out[get[j : j + 1]] = 0.0, 1.0
    return out


def _settle(level: int, last: bool):
    """A pass over sorted nodes, of which one is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in (*batches, None):
            own = [] if batch is None else [c.to_numpy() for c in batch.columns]
            if held is not None:
                own = [np.concatenate(x) for x in zip(held, own, strict=True)] if own else held
            if not own or not len(own[0]):
                continue
            cuts = np.flatnonzero((np.diff(own[0]) != 0) | (np.diff(own[1]) != 0)) + 1
            ends = [*cuts.tolist(), len(own[0])] if batch is None else cuts.tolist()
            ready = ends[-1] if ends else 0
            held = [c[ready:] for c in own]
            rank, node, key, words, whole, part, number = (c[:ready] for c in own)
            part = part.copy()
            begin = 0
            for end in ends:
                open_ = begin + np.flatnonzero((part[begin:end] > CLOSE) & (part[begin:end] < 1 - CLOSE) & (words[begin:end] > 0))
                part[open_] = rounded(words[open_], part[open_], _random(key[open_], number[open_], level), last)
                begin = end
            part = np.where(words > 0, np.where(part < CLOSE, 0.0, np.where(part > 1 - CLOSE, 1.0, part)), 0.0)
            settled = (part == 0.0) | (part == 1.0)
            if ready:
                columns = [rank, node, key, words, whole + settled * part.astype(np.int32), np.where(settled, 0.0, part), number, settled]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _SCHEMA.types, strict=True)], schema=_SCHEMA)

    return run


_SCHEMA = pa.schema([("source_rank", pa.int32()), ("node", pa.int64()), ("key", pa.int64()), ("words", pa.int64()), ("whole", pa.int32()), ("part", pa.float64()), ("number", pa.int32()), ("settled", pa.bool_())])


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, source, words, source_size, target (of its source) and copies (how often the mix takes it) for each row of docs.

    A null text has no words and is taken no time, as any text without words. Null is a source of its own, the last one. Rows that share a doc_id are counted and rounded one by one.
    Other columns are ignored; an empty table gives an empty one. The same rows give the same result in any order and partitioning.
    """
    spark = docs.sparkSession
    sizes = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_PATTERN)).cast("long").alias("words"),
    )
    sizes = checkpointed(sizes)
    goals = targets(sizes)
    nodes = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / FAN)).cast("long")
    rate = F.when(F.col("words") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = checkpointed(sizes.join(goals, sizes.source.eqNullSafe(goals.source)).drop(goals.source))
    # equal ids would be one document in two places: number those that nothing else tells apart
    row = ["source_rank", "key", "words"]
    joined = joined.withColumn("number", F.row_number().over(Window.partitionBy(*row).orderBy(F.lit(1))))
    rows = joined.select(
        "source_rank",
        F.pmod(F.xxhash64("key", "words", "number"), nodes).alias("node"),
        "key", "number", "doc_id", "source", "words", "source_size", "target", "n_docs", rate.alias("rate"),
    )
    rows = checkpointed(rows)
    most = rows.agg(F.max("n_docs")).first()[0] or 0
    levels, width = 1, -(-most // FAN)
    while width > 1:
        levels, width = levels + 1, -(-width // FAN)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    waiting = rows.select("source_rank", "node", "key", "words", F.floor("rate").cast("int").alias("whole"), (F.col("rate") - F.floor("rate")).alias("part"), "number")
    settled = []
    for level in range(levels):
        sorted_nodes = waiting.repartition(parts, "source_rank", "node").sortWithinPartitions("source_rank", "node", F.desc("words"), "key", "number")
        out = checkpointed(in_arrow(sorted_nodes, _settle(level, level == levels - 1), _ROUNDED))
        settled.append(out.where("settled").select(*row, "number", F.col("whole").alias("copies")))
        waiting = out.where("not settled").select("source_rank", F.floor(F.col("node") / FAN).alias("node"), "key", "words", "whole", "part", "number")
    copies = settled[0]
    for more in settled[1:]:
        copies = copies.unionByName(more)
    return rows.join(copies, [*row, "number"]).select("doc_id", "source", "words", "source_size", "target", "copies")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture(documents(spark, sf_dir))
    return mixed.select("doc_id", F.col("words").alias("size"), "source_size", "target", (F.col("words") * F.col("copies")).alias("taken"))


def taken(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of docs as often as the mix takes them. A document that it takes twice comes as two equal rows; one that it takes no time goes, and so does one without words.

    Rows that share a doc_id (or have none) each come as often as the mix takes one of them at most. All columns stay, whatever their names. An empty table gives an empty one.
    """
    own = free_name(docs, "mixing")
    mixed = mixture(docs).groupBy(F.coalesce("doc_id", F.lit(NULL_ID)).alias("key")).agg(F.max("copies").alias("copies")).select(F.struct("key", "copies").alias(own))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    joined = docs.join(mixed, key == F.col(f"{own}.key")).where(F.col(f"{own}.copies") > 0)
    return joined.withColumn(own, F.explode(F.sequence(F.lit(1), F.col(f"{own}.copies")))).select(*docs.columns)
