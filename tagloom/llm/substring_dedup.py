"""Substring dedup: words covered by a long passage that also occurs in an earlier document are removed.

Suffixes (at the words where a window may begin) are split by prefix: first by the anchor of their window (see repeats), and a
prefix that too many suffixes share is split further, in the end by the whole window. Each group fits into memory; its suffix
tree is built there, and its nodes at least `width` words deep are the repeated passages.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import NULL_ID, distinct_documents, documents, free_name, in_arrow
from tagloom.llm.repeats import Windows, covered, gone_arrays, repeated_windows
from tagloom.llm.subtrees import subtree

WIDTH = 50


def _resolve(width: int):
    def run(tokens: np.ndarray, offsets: np.ndarray, windows: np.ndarray, owner: np.ndarray) -> np.ndarray:
        tree = subtree(tokens, windows, offsets[1:][owner] - windows, width)
        by_start = np.empty(len(tokens) + 1, np.int64)
        by_start[tree.leaves] = tree.nodes(width)
        return by_start[windows]

    return run


def with_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """key, doc_id, text and gone: the windows of `width` words that also start in an earlier document."""
    spec = Windows(width=width, gram=max(1, min(16, width // 3)), words=True, within=False)
    return repeated_windows(distinct_documents(docs), spec, _resolve(width))


def _applied(width: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, starts, counts = gone_arrays(batch.column("gone"))
            n_words, n_removed, kept_texts = [], [], []
            for i, text in enumerate(batch.column("text")):
                words = text.as_buffer().to_pybytes().split()
                a, b = offsets[i], offsets[i + 1]
                removed = 0
                if b > a:
                    off = covered(starts[a:b], counts[a:b], len(words), width)
                    removed = int(off.sum())
                    kept = b" ".join(compress(words, (~off).tolist()))
                else:
                    kept = b" ".join(words)
                n_words.append(len(words))
                n_removed.append(removed)
                kept_texts.append(kept.decode() if texts else hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_texts, pa.string())],
                names=["doc_id", "mark", "n_words", "n_removed", "kept"],
            )

    return run


def _removed(docs: DataFrame, width: int, texts: bool) -> DataFrame:
    """doc_id, mark (the hash of the text), n_words, n_removed, kept."""
    marked = with_repeats(docs, width).withColumn("mark", F.xxhash64("text"))
    return in_arrow(marked, _applied(width, texts), "doc_id long, mark long, n_words long, n_removed long, kept string")


def substring_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """For each row doc_id, n_words, n_removed and kept: the remaining words joined by one space.

    A null text has no words. Null doc_ids come before all others. Rows with equal id and text are one document; if an id has several texts, each is a document, in the order of their
    hashes. Texts shorter than `width` words are left alone. Other columns of docs are ignored.
    """
    return _removed(docs, width, texts=True).drop("mark")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _removed(documents(spark, sf_dir), WIDTH, texts=False).select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def cleaned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with repeated passages removed; one that lost all its words goes. A text that loses nothing stays byte for byte.

    A null or empty text has no words and stays. Null doc_ids come before all others; of several texts of one id each is a document, and all rows of equal id and text lose the same.
    All columns stay, whatever their names, with n_chars made to fit. An empty table gives an empty one.
    """
    own = free_name(docs, "substring_dedup")
    place = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    changed = _removed(docs, WIDTH, texts=True).where("n_removed > 0").select(F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("key"), "mark").alias("place"), "n_removed", "n_words", "kept")
    changed = changed.dropDuplicates(["place"]).select("place", F.struct("n_removed", "n_words", "kept").alias("change"))
    held = docs.select(F.struct(place.alias("place"), F.struct(*docs.columns).alias("row")).alias(own))
    joined = held.join(changed, F.col(f"{own}.place") == F.col("place"), "left").where("change is null or change.n_removed < change.n_words")
    row, text = F.col(f"{own}.row"), F.coalesce(F.col("change.kept"), F.col(f"{own}.row")["text"])
    return joined.select(*[(text if c == "text" else F.length(text).cast("long") if c == "n_chars" else row[c]).alias(c) for c in docs.columns])


ORACLE = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), w AS MATERIALIZED (
  SELECT doc_id, i, md5(array_to_string(words[i:i + {WIDTH - 1}], ' ')) AS win FROM d, unnest(range(1, len(words) - {WIDTH - 2})) AS u(i)
), gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + {WIDTH})))) AS places
  FROM w JOIN (SELECT win, min(doc_id) AS first FROM w GROUP BY win HAVING min(doc_id) < max(doc_id)) f USING (win) WHERE first < doc_id GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN places IS NULL THEN words ELSE list_where(words, list_transform(range(1, len(words) + 1), lambda k: NOT list_contains(places, k))) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone g ON g.doc_id = d.doc_id
"""
