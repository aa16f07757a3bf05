"""Suffix-array dedup: bytes covered by a long byte string that also starts earlier are removed.

The suffixes that can matter (see repeats) are sorted in shards by induced sorting with queues on disk (see induced); windows whose
suffixes are neighbours in that order and share `width` bytes are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import distinct_documents, documents, in_arrow
from tagloom.llm.induced import Work, suffix_order
from tagloom.llm.repeats import Windows, covered, gone_arrays, repeated_windows

WIDTH = 100
#: A shard's bytes; queue entries that its sort keeps in memory (more go to disk); names over which they are sorted by recursion.
SHARD_BYTES, QUEUE_ENTRIES, SHORT = 8 << 20, 1 << 17, 1 << 18


def _resolve(width: int, work: Work | None = None):
    def run(data: np.ndarray, offsets: np.ndarray, windows: np.ndarray, owner: np.ndarray) -> np.ndarray:
        count = len(offsets) - 1
        text = np.ones(len(data) + count + 1, np.uint16)  # 0 ends the shard, 1 ends a segment, a byte b is b + 2
        text[-1] = 0
        shift = np.repeat(np.arange(count), np.diff(offsets))
        text[np.arange(len(data)) + shift] = data.astype(np.uint16) + 2
        order, shared = suffix_order(text, width, QUEUE_ENTRIES, SHORT, work)
        number = np.empty(len(text), np.int64)
        number[order] = np.cumsum(shared < width)
        return number[windows + owner]

    return run


def with_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """key, doc_id, text and gone: the windows of `width` bytes that also start earlier."""
    spec = Windows(width=width, gram=max(1, width // 3), words=False, within=True, shard_bytes=SHARD_BYTES)
    return repeated_windows(distinct_documents(docs), spec, _resolve(width))


def _applied(width: int, contents: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, starts, counts = gone_arrays(batch.column("gone"))
            sizes, removed, spans, kept = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                data = text.as_buffer().to_pybytes()
                a, b = offsets[i], offsets[i + 1]
                n = m = 0
                rest = data
                if b > a:
                    off = covered(starts[a:b], counts[a:b], len(data), width)
                    n = int(off.sum())
                    m = int(off[0]) + int((off[1:] & ~off[:-1]).sum())
                    rest = np.frombuffer(data, np.uint8)[~off].tobytes()
                sizes.append(len(data))
                removed.append(n)
                spans.append(m)
                kept.append(rest if contents else hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary() if contents else pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def suffix_array_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """For each row doc_id, n_bytes, n_removed, n_spans and kept: the remaining bytes (which may no longer be whole characters).

    A null text is empty. Null doc_ids come before all others. Rows with equal id and text are one document; if an id has several texts, each is a document, in the order
    of their hashes. Texts shorter than `width` bytes are left alone. Other columns of docs are ignored.
    """
    return in_arrow(with_repeats(docs, width), _applied(width, contents=True), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = in_arrow(with_repeats(documents(spark, sf_dir)), _applied(WIDTH, contents=False), "doc_id long, n_bytes long, n_removed long, n_spans long, kept string")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))

