"""SimHash near-dedup by multi-index hashing.

Each document has a 64-bit fingerprint; two documents are linked if at most `DISTANCE` of its bits differ. Equal fingerprints become
one node. The fingerprint is cut into two segments, so that of a linked pair one segment differs in one bit at most: the Hamming
ball of radius one around each segment is looked up in the table of segments, and matches are verified on all bits.

A table entry keeps its count and its first and last fingerprint. If more than two fingerprints share a segment (a cluster
of near copies), their pairs aren't formed. Instead every fingerprint whose balls touch such an entry joins the exact second
way: it is listed under all 65 values that its whole fingerprint has within one bit. Two fingerprints share such a value
exactly if at most two bits differ, and no more than 65 fingerprints can share one, so each is linked to the first of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.llm.common import checkpointed, documents, ids_and_texts, in_arrow
from tagloom.llm.components import components

DISTANCE = 2
SEED = 42


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each shingle of lower-cased (A-Z) words joined by a space; one for the whole sequence if it is shorter."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit number; none: zero."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """key, doc_id, fingerprint (long) of each row of docs (doc_id, text). Null texts and texts without words: zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [majority(shingle_hashes(x.as_buffer().to_pybytes(), shingle)) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(out, pa.int64())], names=["key", "doc_id", "fingerprint"])

    return in_arrow(ids_and_texts(docs), run, "key long, doc_id long, fingerprint long")


def _segment(k: int) -> Column:
    """The segment's number and its 32 bits in one number."""
    return F.shiftrightunsigned("fingerprint", 32 * k).bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(k << 32)


def _flips(value: Column, bits: int) -> Column:
    """value and what it becomes if one of its lower bits is flipped."""
    return F.concat(F.array(value), F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes that connect all fingerprints which differ in two bits at most, given (node, fingerprint), one row for each fingerprint."""
    entry = F.struct("fingerprint", "node")
    table = (
        nodes.select("fingerprint", "node", F.explode(F.array(_segment(0), _segment(1))).alias("segment"))
        .groupBy("segment")
        .agg(F.count(F.lit(1)).alias("n"), F.min(entry).alias("low"), F.max(entry).alias("high"))
    )
    probes = nodes.select("fingerprint", "node", F.explode(F.concat(_flips(_segment(0), 32), _flips(_segment(1), 32))).alias("segment"))
    met = probes.join(table, "segment").where("n > 1 or low.fingerprint != fingerprint")
    found = met.select("fingerprint", "node", (F.col("n") > 2).alias("crowded"), F.explode(F.array("low", "high")).alias("other"))
    found = checkpointed(found.where("crowded or other.fingerprint != fingerprint and bit_count(fingerprint ^ other.fingerprint) <= 2").distinct())
    near = found.where("bit_count(fingerprint ^ other.fingerprint) <= 2").select(F.col("node").alias("a"), F.col("other.node").alias("b"))
    crowd = found.where("crowded").select("fingerprint", "node").distinct()
    listed = crowd.select("node", F.explode(_flips(F.col("fingerprint"), 64)).alias("value"))
    starred = listed.select(F.col("node").alias("a"), F.min("node").over(Window.partitionBy("value")).alias("b"))
    return near.unionByName(starred).where("a != b")


def simhash_components(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """key, doc_id, fingerprint (long), component: the smallest key that can be reached over links of at most two differing bits.

    One row for each row of docs; rows with a null doc_id share the key NULL_ID and so come before all others. Null texts and texts without words have the fingerprint zero, which links
    like any other. Equal rows share a fingerprint and so a component. Other columns of docs are ignored.
    """
    prints = checkpointed(fingerprints(docs, shingle))
    nodes = checkpointed(prints.groupBy("fingerprint").agg(F.min("key").alias("node")))
    found = components(links(nodes))
    named = nodes.join(found, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("component"))
    return prints.join(named, "fingerprint").select("key", "doc_id", "fingerprint", "component")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
