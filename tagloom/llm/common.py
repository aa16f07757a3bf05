"""Small helpers that the training-data operators share: array views, hashes of token ranges, checkpoints."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows whose doc_id is null count as one document that comes before all others.
NULL_ID = -(2**63)

#: Words are runs of anything but these bytes (space, tab, line feed, vertical tab, form feed, carriage return).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Texts are handled in pieces of about so many bytes, so that the working arrays stay in the processor's cache.
CHUNK_BYTES = 1 << 18

U64 = np.uint64
BYTE_VALUES = np.random.default_rng(20240117).integers(1, 2**63, 256, dtype=np.int64).view(U64) * U64(2) + U64(1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """doc_id, key (doc_id or the stand-in for null) and text (null: empty); other columns are left behind."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("key"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def distinct_documents(docs: DataFrame) -> DataFrame:
    """ids_and_texts with a key of its own for each document, in the order of doc_id.

    Rows with equal id and text are one document. If an id has several texts (or several texts have none), each of them is a document, in the order of their hashes; then keys
    are numbers that rise in that order.
    """
    held = ids_and_texts(docs)
    if held.groupBy("key").count().where("count > 1").isEmpty():
        return held
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = held.withColumn("mark", F.xxhash64("text"))
    ordered = marked.select("key", "mark").distinct().repartitionByRange(parts, "key", "mark").sortWithinPartitions("key", "mark")
    places = checkpointed(ordered.withColumn("place", F.monotonically_increasing_id()))  # ranges come in order, so these numbers do
    return marked.join(places, ["key", "mark"]).select("doc_id", F.col("place").alias("key"), "text")


def checkpointed(df: DataFrame) -> DataFrame:
    """df from the reliable folder named in spark.checkpoint.dir; a temporary folder only where none is set and all runs on one machine, as in tests."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return df.checkpoint()


#: A table of a few numbers a row is sent to every task if it has so many rows at most (some tens of megabytes).
SENT_ROWS = 500_000


def sent(rows: DataFrame) -> DataFrame:
    """rows (checkpointed, numbers only) for a join with texts: if they are few by count they go to every task and the texts stay where they are, else both are shuffled."""
    return F.broadcast(rows) if rows.count() <= SENT_ROWS else rows


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # other C libraries give freed memory back by themselves
    _trim = None


def give_back() -> None:
    """Gives freed memory that this process's allocators hold back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow(run, schema), where a worker gives back after each partition what its allocators hold: workers live on for later stages, beside the executor's own memory."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(released, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over all output bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(32))
        x = x * U64(0xD6E8FEB86659FD93)
        x = x ^ (x >> U64(32))
        x = x * U64(0xD6E8FEB86659FD93)
        return x ^ (x >> U64(32))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A value for two neighbouring ranges from theirs. It isn't linear, so sequences don't collide by their structure, as they would under a polynomial modulo 2**64."""
    x = left * U64(0x9E3779B97F4A7C15)
    x += right
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    return x


class RangeHash:
    """64-bit hashes of any ranges (not empty) of a token sequence, each from two ranges whose length is a power of two.

    Ranges over `LONG` tokens are read from end to end instead, so that few tables are held.
    """

    LONG = 1024

    def __init__(self, values: np.ndarray):
        self.values, self.levels = values, [values]

    def _level(self, j: int) -> np.ndarray:
        """Of every range of 2**j tokens, by start."""
        while len(self.levels) <= j:
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(_joined(last[: max(0, len(last) - step)], last[step:]))
        return self.levels[j]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = end - start
        out = np.empty(len(start), U64)
        level = np.frexp(length.astype(np.float64))[1] - 1
        for j in np.unique(level).tolist():
            at = np.flatnonzero(level == j)
            if 1 << j >= self.LONG:
                out[at] = [xxhash.xxh64_intdigest(self.values[a:b].tobytes()) for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            else:
                held = self._level(j)
                out[at] = _joined(held[start[at]], held[end[at] - (1 << j)])
        return mix(out + length.astype(U64))

    def each(self, length: int) -> np.ndarray:
        """Of every range of that length, by start; as `of` has them."""
        count = len(self.values) - length + 1
        if count <= 0:
            return np.zeros(0, U64)
        if length >= self.LONG:
            return self.of(np.arange(count), np.arange(count) + length)
        j = length.bit_length() - 1
        held = self._level(j)
        return mix(_joined(held[:count], held[length - (1 << j) : length - (1 << j) + count]) + U64(length))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary column without copying, and the offsets of its values; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows of about that many bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in data, and for each text (whose bytes begin at offsets) the number of words before it."""
    word = ~SEPARATORS[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    first[cut] = word[cut]
    last[cut - 1] = word[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit value for each word. Words are hashed in pieces of CHUNK_BYTES, since the hash's tables take 8 bytes or more a level for each byte; a longer word is a piece of its own."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK_BYTES, "right")))
        piece = slice(starts[i], ends[j - 1])
        out[i:j] = RangeHash(BYTE_VALUES[data[piece]]).of(starts[i:j] - piece.start, ends[i:j] - piece.start)
        i = j
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of all ranges, one range after the other."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(np.asarray(starts, np.int64) - before, lengths)
