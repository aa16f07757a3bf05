"""Exact top-k inner products by buckets of similar length.

Vectors are sorted by length, longest first, and cut into buckets. Against a bucket, a query's score to beat becomes a cosine to
beat: score / (query's length * bucket's greatest length). Over 1, the bucket is left out. If it is high, only vectors are kept
whose largest query coordinates lie where a vector of that cosine can have them; if it is low, only the vectors that are
long enough. What is left is multiplied out in integers. The score to beat comes from a first round over the longest vectors (one bucket for each number of dimensions) and one
bucket in sixteen of the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.llm.common import checkpointed, in_arrow

K, SCALE, QUERY_STEP = 5, 256, 50
BUCKET, QUERIES = 4096, 512
#: Coordinates that are looked at, and the local cosine from which looking at them pays.
COORDINATES, STEEP = 4, 0.35
FIRST_ROUND = 16
SLACK = 1e-9
#: 64-bit integers.
LEAST, MOST = -(2**63), 2**63 - 1

_BLOCKS = "dims int, number long, ids binary, vectors binary, longest double"


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array<long>: floor(scale * x) of each component as double), dims and norm; vectors null, empty or holding null or non-finite components, and rows without vec_id, are left out."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    whole = vectors.where(
        F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    )
    v = whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    return v.select("vec_id", "v", F.size("v").alias("dims"), norm.alias("norm"))


def _packed(limit: int):
    """Blocks of at most `limit` consecutive rows with the same number of dimensions; the vectors as 64-bit integers, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows: pa.Table) -> pa.RecordBatch:
            ids = rows.column("vec_id").to_numpy()
            matrix = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in rows.column("v").chunks]).astype("<i8")
            dims = rows.column("dims")[0].as_py()
            number = int(ids[0]) * 2654435761 % (2**31)
            return pa.RecordBatch.from_pydict(
                {"dims": [dims], "number": [number], "ids": [ids.astype("<i8").tobytes()], "vectors": [matrix.tobytes()], "longest": [rows.column("norm")[0].as_py()]},
                schema=pa.schema([("dims", pa.int32()), ("number", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("longest", pa.float64())]),
            )

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            while table.num_rows:
                dims = table.column("dims").to_numpy()
                n = int(np.argmax(dims != dims[0])) if (dims != dims[0]).any() else len(dims)
                if n == len(dims) and n < limit:
                    break
                n = min(n, limit)
                yield block(table.slice(0, n))
                table = table.slice(n)
            held = table.combine_chunks().to_batches()
        if held:
            yield block(pa.Table.from_batches(held))

    return run


def allowed(cosine: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Between which values a unit vector's coordinate lies if its cosine with a unit vector is at least `least`, given that one's coordinate."""
    angle, spread = np.arccos(np.clip(cosine, -1, 1)), np.arccos(np.clip(least, -1, 1))
    return np.cos(np.minimum(angle + spread, np.pi)) - SLACK, np.cos(np.maximum(angle - spread, 0)) + SLACK


def _best(query_ids: np.ndarray, queries: np.ndarray, beat: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, vector, score) of the k best in a bucket for each query, as far as they reach its score to beat."""
    norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
    units = np.ascontiguousarray((vectors / np.maximum(norms, 1e-300)[:, None]).T)
    longest = norms[0] if len(norms) else 0.0
    whole = np.abs(vectors).max(initial=0) * max(1, np.abs(queries).max(initial=0)) * vectors.shape[1] < 2**53
    exact = vectors.astype(np.float64) if whole else vectors.astype(object)
    out = []
    for q, query, least in zip(query_ids.tolist(), queries, beat, strict=True):
        own = float(np.sqrt((query.astype(np.float64) ** 2).sum()))
        rows = slice(None)
        if least > 0:
            local = least / (own * longest) if own and longest else np.inf
            if local > 1 + SLACK:
                continue
            if local >= STEEP:
                unit = query / own
                keep = np.ones(len(ids), bool)
                for f in np.argsort(-np.abs(unit))[:COORDINATES]:
                    low, high = allowed(unit[f], local - SLACK)
                    keep &= (units[f] >= low) & (units[f] <= high)
                rows = np.flatnonzero(keep)
            else:
                rows = slice(0, int(np.searchsorted(-norms, -(least / own) * (1 - SLACK), "right")))
        names = ids[rows]
        if not len(names):
            continue
        scores = exact[rows] @ (query.astype(np.float64) if whole else query.astype(object))
        other = names != q
        names, scores = names[other], scores[other]
        if len(names) > 4 * k:
            cut = np.partition(scores, len(scores) - k)[len(scores) - k]
            names, scores = names[scores >= cut], scores[scores >= cut]
        order = np.lexsort((names, -scores))[:k]
        out += [(q, int(v), max(LEAST, min(MOST, int(s)))) for v, s in zip(names[order], scores[order], strict=True) if s >= least]
    return out


def _pairs(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shape = (-1, row["dims"])
                beat = np.frombuffer(row["beat"], "<f8") if row["beat"] is not None else np.full(len(row["query_ids"]) // 8, -np.inf)
                found = _best(np.frombuffer(row["query_ids"], "<i8"), np.frombuffer(row["queries"], "<i8").reshape(shape), beat, np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vectors"], "<i8").reshape(shape), k)
                columns = zip(*found, strict=True) if found else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def _scored(queries: DataFrame, buckets: DataFrame, k: int, slots: int) -> DataFrame:
    """The best of each query in each bucket. Every block of queries meets every bucket of its dimensions whose length can reach its lowest score to beat.

    Buckets lie in as many slots as there are buckets, and each block of queries is sent to each slot, so the work is dealt out evenly.
    """
    buckets = buckets.withColumn("slot", F.pmod("number", F.lit(slots)))
    queries = queries.withColumn("q_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    reach = F.col("lowest").isNull() | (F.col("lowest") <= F.col("q_longest") * F.col("longest") * (1 + SLACK))
    met = queries.join(buckets, (F.col("q_dims") == F.col("dims")) & (F.col("q_slot") == F.col("slot")) & reach)
    columns = ["dims", "query_ids", "queries", "beat", "ids", "vectors"]
    return in_arrow(met.select(*columns), _pairs(k), "query_id long, vec_id long, score long")


def first_buckets(buckets: DataFrame) -> DataFrame:
    """The buckets of the first round: there is always one for each number of dimensions."""
    longest = buckets.groupBy("dims").agg(F.max_by("number", F.struct("longest", "number")).alias("number")).withColumn("chosen", F.lit(True))
    return buckets.join(longest, ["dims", "number"], "left").where((F.pmod("number", F.lit(FIRST_ROUND)) == 0) | F.col("chosen")).drop("chosen")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _with_beat(queries: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """Blocks of queries with each query's k-th score so far (minus infinity: fewer)."""
    known = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("score")).where(F.col("n") >= k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            beats, lowest = [], []
            for ids, scores in zip(batch.column("query_ids").to_pylist(), batch.column("scores").to_pylist(), strict=True):
                of = {x["query_id"]: x["score"] for x in scores or ()}
                own = [of.get(i, -np.inf) for i in np.frombuffer(ids, "<i8").tolist()]
                beats.append(np.array(own, "<f8").tobytes())
                lowest.append(min(own) if min(own) > 0 else None)
            columns = [batch.column(n) for n in ("q_dims", "query_ids", "queries", "q_longest")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(beats, pa.binary()), pa.array(lowest, pa.float64())], names=["q_dims", "query_ids", "queries", "q_longest", "beat", "lowest"])

    owner = queries.select("q_number", F.explode("members").alias("query_id"))
    scores = owner.join(known, "query_id").groupBy("q_number").agg(F.collect_list(F.struct("query_id", "score")).alias("scores"))
    joined = queries.drop("beat", "lowest", "members").join(scores, "q_number", "left").select("q_dims", "query_ids", "queries", "q_longest", "scores")
    return in_arrow(joined, run, "q_dims int, query_ids binary, queries binary, q_longest double, beat binary, lowest double")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each vector with is_query (of vec_id) the k highest inner products of the integer vectors, ties to the smaller vec_id.

    A query's own vec_id takes no part; vectors of another number of dimensions don't either. Vectors that are null, empty or hold null or non-finite components, or lack an id, are left out.
    Each vec_id should be there once: further rows with a query's id are queries too, and their candidates are merged. Fewer than k candidates: all of them. Components and scores beyond 64-bit integers count as the least or greatest one. Other columns are ignored; an empty table gives an empty one.
    """
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = checkpointed(integer_vectors(vectors, scale))
    sorted_rows = own.repartitionByRange(parts, "dims", F.desc("norm"), "vec_id").sortWithinPartitions("dims", F.desc("norm"), "vec_id")
    buckets = checkpointed(in_arrow(sorted_rows, _packed(BUCKET), _BLOCKS))
    asked = own.where(is_query).repartitionByRange(max(1, parts // 4), "dims", F.desc("norm"), "vec_id").sortWithinPartitions("dims", F.desc("norm"), "vec_id")
    blocks = in_arrow(asked, _packed(QUERIES), _BLOCKS).select(
        F.col("dims").alias("q_dims"), F.xxhash64("ids").alias("q_number"), F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"), F.col("longest").alias("q_longest"),
        F.lit(None).cast("binary").alias("beat"), F.lit(None).cast("double").alias("lowest"),
    )

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(x, "<i8").tolist() for x in batch.column("query_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int64()))], names=[*batch.schema.names, "members"])

    blocks = checkpointed(in_arrow(blocks, members, "q_dims int, q_number long, query_ids binary, queries binary, q_longest double, beat binary, lowest double, members array<long>"))
    slots = max(1, buckets.count())
    first = _ranked(_scored(blocks, first_buckets(buckets), k, max(1, slots // FIRST_ROUND)), k)
    again = checkpointed(_with_beat(blocks, first, k))
    return _ranked(_scored(again, buckets, k, slots), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % QUERY_STEP == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
