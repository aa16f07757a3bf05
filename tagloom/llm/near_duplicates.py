"""Near duplicates by similarity: SimHash with wide fingerprints and multi-index hashing, then the texts' shingles.

Two documents whose five-word shingles have a Jaccard similarity of 0.8 differ in some 15% of the bits of their SimHash
fingerprints. No two segments of a 64-bit fingerprint are then likely to agree, so the fingerprint is made 384 bits wide and each of 16
segments of 21 bits is a table of its own, in which the Hamming ball of radius one around each segment is looked up. Fingerprints that
differ in 31 bits at most meet in one of the tables; at a similarity of 0.8 some 93% do by the binomial law, against 41% by equal segments.

Before that, entries that follow each other in a table are compared if they share their segment: 16 pairs for each fingerprint at most, however large its group. Those that are similar hold most groups together,
and the balls then only give pairs of fingerprints that aren't in one group yet; another pair couldn't change a group. So near copies aren't expanded into the many pairs that they have in balls.

No ball is written out. Each table is sorted twice, by the segment and by the segment with its two parts exchanged, followed by the
bits behind it: segments that differ in one bit agree in one of the parts, so they are in one block of one of the two orders, and the ball is looked up there.
Segments with few fingerprints give all pairs. In a crowded one a fingerprint is compared with the next `NEIGHBOURS` of its own segment, one of a segment with few with the two that are nearest
in the order, and two crowded segments by one of theirs, so a table gives a bounded number of pairs however many copies share a segment. What crowds, and blocks that are cut between two
tasks, leave open is left to the second way below, which finds every pair.

Pairs are then held to all bits of their fingerprints: only those that let expect a similarity of `LOOSE` at least stay. Before texts are fetched, pairs that can't be similar enough go by their parity sketches: sets that differ in
d hashes have sketches that differ in d bits at most, so no pair is lost by that. What decides is the Jaccard similarity of the sets of shingle hashes. Pairs are dealt by their
first text, those of a text with many pairs in several units, so that no task has to hold a group.

Tables miss pairs, so a second, exact way follows for texts that aren't in one group yet: prefix filtering. A text's hashes are put in one order for all texts, and two texts that are similar
enough share one of the first `n - ceil(similarity * n) + 1`, at places that leave room for the rest of what they have to share. Any order is right; hashes that are frequent in a sample go last,
so that texts which share a long template or passage don't meet by it, unless they can still be similar enough.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import NULL_ID, U64, RangeHash, checkpointed, chunks, distinct_documents, free_name, ids_and_texts, in_arrow, mix, ranges, sent, text_bytes, word_spans, word_values
from tagloom.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
LANES, TABLES, SEGMENT, NEIGHBOURS = 6, 16, 21, 3
BITS = 64 * LANES
#: The bits of a segment that come first in the first order of its table; the others do in the second.
FRONT = 11
#: Entries are first held to so many bits from their segment on. Of those, a pair at similarity 0.8 differs in 18 with a standard error of 3.9; beyond this many the tables don't propose it.
CARRIED, LIKELY = 128, 36
#: A parity sketch has at least four bits for each hash of its set, within these bounds (powers of two).
SKETCH_LEAST, SKETCH_MOST = 512, 1 << 14

#: Pairs of the tables with a lower estimate aren't verified. Sets of any size that differ in more bits have a lower one.
LOOSE = 0.7
LOOSE_BITS = math.floor(BITS / math.pi * math.acos(2 * LOOSE / (1 + LOOSE)))
#: A unit has about so many pairs of one text at most.
BLOCK = 256
#: Frequent hashes are those of so many texts of a sample of one text in SAMPLE; so many of them at most are kept. As the sample grows with the texts, groups of texts that share a rarer hash don't. This only
#: decides how much work there is.
FREQUENT, SAMPLE, KEPT = 4, 8, 1_000_000

#: Rows of an Arrow batch that a text's hashes go out in.
ROWS = 50_000

_SALTS = mix(np.arange(1, LANES + 1, dtype=U64))


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """One bit for each position: whether it is set in over half of the distinct hashes. No hash: all zero."""
    n = len(hashes)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 255):
        with np.errstate(over="ignore"):
            wide = mix(hashes[i : i + 255, None] + _SALTS)
        bits = np.unpackbits(wide.view(np.uint8), axis=1)
        ones += bits.view(U64).sum(0, dtype=U64).view(np.uint8)
    return np.packbits(ones * 2 > n).tobytes()


def parity_sketch(hashes: np.ndarray) -> bytes:
    """For each bit, whether an odd number of the distinct hashes has its place."""
    width = min(max(SKETCH_LEAST, 1 << (4 * len(hashes)).bit_length()), SKETCH_MOST)
    odd = np.bincount((hashes & U64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """In how many bits two sketches differ, at the width of the shorter: halves of the longer are laid over each other."""
    if len(x) < len(y):
        x, y = y, x
    bits, size = int.from_bytes(x, "big"), len(x)
    while size > len(y):
        size //= 2
        bits = (bits >> 8 * size) ^ (bits & ((1 << 8 * size) - 1))
    return (bits ^ int.from_bytes(y, "big")).bit_count()


def _sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """For each text (null: empty) the sorted distinct hashes of its shingles of lower-cased (A-Z) words; fewer words: one of the whole sequence; none: none."""
    data, offsets = text_bytes(texts)
    out: list[np.ndarray] = []
    for i, j in chunks(offsets):
        piece, cuts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        piece = piece + ((piece >= 0x41) & (piece <= 0x5A)).astype(np.uint8) * np.uint8(0x20)
        starts, ends, before = word_spans(piece, cuts)
        hashed = RangeHash(word_values(piece, starts, ends))
        every = hashed.each(shingle)
        few = np.flatnonzero((np.diff(before) > 0) & (np.diff(before) < shingle))
        whole = dict(zip(few.tolist(), hashed.of(before[few], before[few + 1]), strict=True)) if len(few) else {}
        for t, (a, b) in enumerate(zip(before[:-1].tolist(), before[1:].tolist(), strict=True)):
            out.append(np.array([whole[t]], U64) if t in whole else np.unique(every[a : max(a, b - shingle + 1)]))
    return out


def _prints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(wide_fingerprint(h), parity_sketch(h), len(h), xxhash.xxh64_intdigest(h.tobytes()) - 2**63) for h in _sets(batch.column("text"), shingle)]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.binary(), pa.binary(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], names=["key", "fingerprint", "sketch", "n", "digest"])

    return run


def _entries(batches: Iterator[pa.RecordBatch], numbers: range = range(2 * TABLES)) -> Iterator[pa.RecordBatch]:
    """Two entries for each table: number is twice the table's, one more for the second order. Columns besides the fingerprint go along."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw = np.frombuffer(b"".join(batch.column("fingerprint").to_pylist()), np.uint8).reshape(-1, BITS // 8)
        bits = np.unpackbits(raw, axis=1)
        bits = np.concatenate([bits, bits], axis=1)
        rest = [c for c in batch.schema.names if c != "fingerprint"]
        for number in numbers:
            own = bits[:, number // 2 * SEGMENT :][:, :BITS]
            if number % 2:
                own = np.concatenate([own[:, FRONT:SEGMENT], own[:, :FRONT], own[:, SEGMENT:]], axis=1)
            order = np.packbits(own, axis=1).view(">u8").astype(U64) ^ U64(1 << 63)
            columns = [np.full(len(order), number, np.int32), *order.view(np.int64).T]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *map(batch.column, rest)], names=["number", *_PARTS, *rest])


#: The whole fingerprint from the segment on.
_PARTS = [f"part_{i}" for i in range(BITS // 64)]
#: An entry's number and its first bits make one key of 64 bits; below the segment it has so many.
_NUMBER = (2 * TABLES - 1).bit_length()
_BELOW = 64 - _NUMBER - SEGMENT
#: Entries that agree in so many bits of the segment, at least, are in one block, in either order.
_BLOCK = SEGMENT - FRONT


def _following(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes whose entries follow each other, share their segment and can be similar enough by their first bits."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [batch.column(c).to_numpy() for c in ("number", *_PARTS[: CARRIED // 64], "node")]
        if held is not None:
            own = [np.concatenate(x) for x in zip(held, own, strict=True)]
        number, *parts, node = own
        segment = parts[0] >> (64 - SEGMENT)
        keep = (number[1:] == number[:-1]) & (segment[1:] == segment[:-1])
        keep &= sum(np.bitwise_count(p[1:].view(U64) ^ p[:-1].view(U64)).astype(int) for p in parts) <= LIKELY
        a, b = node[:-1][keep], node[1:][keep]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
        held = [x[-1:] for x in own]


def _meeting(key: np.ndarray, crowd: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of entries whose segments are in each other's ball, given the sorted keys of whole blocks."""
    entry = key >> U64(_BELOW)
    start = np.flatnonzero(np.append(True, entry[1:] != entry[:-1]))
    size = np.diff(np.append(start, len(key)))
    value = entry[start]
    second = (value >> U64(SEGMENT)).astype(np.int64) % 2
    # equal segments, in the first order
    whole = np.repeat(size <= crowd, size)
    first = np.repeat(second == 0, size)
    for d in range(1, max(crowd, NEIGHBOURS + 1)):
        i = np.flatnonzero((entry[d:] == entry[:-d]) & first[d:] & (whole[d:] | (d <= NEIGHBOURS)))
        yield i, i + d
    # segments that differ in one of the bits that don't come first
    last = np.where(second == 0, SEGMENT - FRONT, FRONT)
    for bit in range(max(FRONT, SEGMENT - FRONT)):
        s = np.flatnonzero((value >> U64(bit) & U64(1) == 0) & (bit < last))
        t = np.minimum(np.searchsorted(value, value[s] | U64(1 << bit)), len(value) - 1)
        there = value[t] == value[s] | U64(1 << bit)
        s, t = s[there], t[there]
        few = (size[s] <= crowd) & (size[t] <= crowd)
        x, y = s[few], t[few]
        places = ranges(np.zeros(len(x), np.int64), size[x] * size[y])
        x, y = np.repeat(x, size[x] * size[y]), np.repeat(y, size[x] * size[y])
        yield start[x] + places // size[y], start[y] + places % size[y]
        x, y = np.where(size[s] <= size[t], s, t)[~few], np.where(size[s] <= size[t], t, s)[~few]
        members = np.where(size[x] <= crowd, size[x], 1)
        i, y = ranges(start[x], members), np.repeat(y, members)
        near = np.searchsorted(key, key[i] ^ U64(1 << bit + _BELOW))
        for d in (0, 1):
            yield i, np.clip(near - d, start[y], start[y] + size[y] - 1)


def _balls(crowd: int):
    """Pairs of nodes, of different components where entries have one, that meet in a ball and can be similar enough by their first bits and by all. Entries come in order; a segment with more than `crowd` fingerprints
    is a crowd."""

    def pairs(number: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
        *parts, node, component = columns
        parts = [p.view(U64) for p in parts]
        key = number.astype(U64) << U64(64 - _NUMBER) | (parts[0] ^ U64(1 << 63)) >> U64(_NUMBER)
        found = [np.zeros((2, 0), np.int64)]
        for i, j in _meeting(key, crowd):
            apart = component[i] != component[j]
            i, j = i[apart], j[apart]
            first = sum(np.bitwise_count(p[i] ^ p[j]).astype(int) for p in parts[: CARRIED // 64])
            i, j, first = (x[first <= LIKELY] for x in (i, j, first))
            keep = first + sum(np.bitwise_count(p[i] ^ p[j]).astype(int) for p in parts[CARRIED // 64 :]) <= LOOSE_BITS
            found.append(np.stack([node[i[keep]], node[j[keep]]]))
        a, b = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None  # parts of the columns from the last block on
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(c).to_numpy() for c in ("number", *_PARTS, "node", "component" if "component" in batch.schema.names else "node")]
            block = own[0].astype(np.int64) << _BLOCK | (own[1] >> (64 - _BLOCK)) + (1 << _BLOCK - 1)
            cut = int(np.searchsorted(block, block[-1]))
            if held and (cut or last != block[0]):
                yield pairs(*(np.concatenate(x) for x in zip(*held, [c[:cut] for c in own], strict=True)))
                held = []
            elif cut:
                yield pairs(*(c[:cut] for c in own))
            held.append([c[cut:] for c in own])
            last = block[-1]
        if held:
            yield pairs(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _plausible(similarity: float, least: float):
    """Pairs that can have that similarity by their sketches, and whose fingerprints let expect at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            sketches = zip(*(batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b")), strict=True)
            off = np.array([differing(x, y) for x, y in sketches])
            keep = off <= (1 - similarity) / (1 + similarity) * (na + nb) + 1e-6
            if least:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), U64).reshape(-1, LANES) for c in ("left", "right"))
                both = np.cos(np.pi * np.bitwise_count(x ^ y).sum(1) / BITS) * np.sqrt(na * nb)
                keep &= both / np.maximum(na + nb - both, 1e-9) >= least
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    return run


def plausible(pairs: DataFrame, nodes: DataFrame, similarity: float, least: float = 0.0) -> DataFrame:
    """Of the pairs (a, b) of nodes (fingerprint, sketch, n, node) those that can have that similarity; with `least`, only those whose fingerprints let expect that much."""
    prints = ["fingerprint"] if least else []
    left = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"), F.col("n").alias("n_a"), *[F.col(c).alias("left") for c in prints])
    right = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"), F.col("n").alias("n_b"), *[F.col(c).alias("right") for c in prints])
    return in_arrow(pairs.join(left, "a").join(right, "b"), _plausible(similarity, least), "a long, b long").distinct()


def _similar(shingle: int, similarity: float):
    """The pairs with that similarity. Each unit has rows of its texts `a`, which have no b, then rows of the texts `b`. Rows that share a node may have several texts."""

    def alike(x: np.ndarray, y: np.ndarray) -> bool:
        if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-6:
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both / max(len(x) + len(y) - both, 1) >= similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, []
        for batch in batches:
            found = []
            sets_of = _sets(batch.column("text"), shingle)
            for own, *unit, b in zip(sets_of, *(batch.column(c).to_pylist() for c in ("unit", "a", "b")), strict=True):
                if unit != held:
                    held, first = unit, []
                if b is None:
                    if not any(np.array_equal(own, x) for x in first):
                        first.append(own)
                elif any(alike(x, own) for x in first):
                    found.append((unit[1], b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def verified(docs: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the distinct pairs (a, b; keys of docs) that have that Jaccard similarity. docs: key, text. Only texts in a pair are shuffled, if their keys are few enough to be sent to all tasks."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = checkpointed(pairs)
    paired = sent(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))))
    units = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("units"))
    dealt = checkpointed(pairs.join(units, "a").select("a", "b", F.pmod(F.xxhash64("b"), "units").alias("unit")))  # for both sides
    texts = docs.select("key", "text").join(paired, "key", "left_semi")
    left = texts.join(dealt.select("a", "unit").distinct(), F.col("key") == F.col("a")).select("unit", "a", F.lit(None).cast("long").alias("b"), "text")
    right = texts.join(dealt, F.col("key") == F.col("b")).select("unit", "a", "b", "text")
    rows = left.unionByName(right).repartition(parts, "a", "unit").sortWithinPartitions("a", "unit", F.col("b").isNotNull(), "b")
    return checkpointed(in_arrow(rows, _similar(shingle, similarity), "a long, b long").distinct())


def _tables(nodes: DataFrame, numbers: range, bits: int, *columns: str) -> DataFrame:
    """The entries with those numbers in order, each with so many bits and those columns of its node (fingerprint and numbers)."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = f"number int, {', '.join(f'{c} long' for c in (*_PARTS, *columns))}"
    entries = in_arrow(nodes.select("fingerprint", *columns), partial(_entries, numbers=numbers), schema)
    order = ("number", *_PARTS[:2], "node")
    return entries.select("number", *_PARTS[: bits // 64], *columns).repartitionByRange(parts, *order).sortWithinPartitions(*order)


def chained(nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs of nodes (checkpointed: fingerprint, sketch, n, node) that follow each other in one of the tables, share its segment and are plausible by all bits: TABLES for each node at most."""
    pairs = in_arrow(_tables(nodes, range(0, 2 * TABLES, 2), CARRIED, "node"), _following, "a long, b long").where("a != b").distinct()
    return plausible(pairs, nodes, similarity, LOOSE)


def proposed(nodes: DataFrame, similarity: float = SIMILARITY, grouped: DataFrame | None = None) -> DataFrame:
    """Pairs of nodes (checkpointed: fingerprint, sketch, n, node) that meet in a ball of one of the tables and are plausible by all bits.

    grouped (checkpointed): node and component of nodes that aren't their own component; if given, pairs of one component, which can't change it, are left out.
    """
    crowd = NEIGHBOURS + 1 + (2 * nodes.count() >> SEGMENT)  # more than chance brings together
    own, columns = nodes, ["node"]
    if grouped is not None:
        own, columns = nodes.join(sent(grouped), "node", "left").withColumn("component", F.coalesce("component", "node")), ["node", "component"]
    pairs = in_arrow(_tables(own, range(2 * TABLES), BITS, *columns), _balls(crowd), "a long, b long").where("a != b").distinct()
    return plausible(pairs, nodes, similarity, LOOSE)


def _sampled(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.concatenate([np.zeros(0, U64), *_sets(batch.column("text"), shingle)]).view(np.int64)
            for i in range(0, len(hashes), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(hashes[i : i + ROWS])], names=["hash"])

    return run


def _frequent(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that are frequent in a sample of docs (in order), and in how many of its texts they are."""
    sample = docs.where(F.pmod(F.xxhash64("key", F.lit("frequent")), F.lit(SAMPLE)) == 0)
    counts = in_arrow(sample, _sampled(shingle), "hash long").groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    found = counts.orderBy(F.desc("n"), "hash").limit(KEPT).toArrow()
    hashes, n = found.column("hash").to_numpy().view(U64), found.column("n").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


def _prefixes(shingle: int, similarity: float, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, often = frequent.value
        for batch in batches:
            found = []
            for hashes in _sets(batch.column("text"), shingle):
                n = len(hashes)
                if n and len(common):
                    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
                    hashes = hashes[np.lexsort((hashes, np.where(common[at] == hashes, often[at], 0)))]
                found.append((n, hashes[: n - math.ceil(similarity * n - 1e-6) + 1 if n else 0].view(np.int64)))
            if not found:
                continue
            sizes = np.array([n for n, _ in found], np.int32)
            counts = np.array([len(h) for _, h in found], np.int64)
            own = [np.repeat(batch.column(c).to_numpy(), counts) for c in ("component", "key")]
            places = ranges(np.zeros(len(counts), np.int64), counts).astype(np.int32)
            columns = [np.concatenate([h for _, h in found]), *own, np.repeat(sizes, counts), places]
            for i in range(0, len(places), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + ROWS]) for c in columns], names=["hash", "component", "node", "n", "place"])

    return run


def _meetings(similarity: float):
    """Pairs of different components that share a hash at places where they can still be similar enough. Entries come by hash, then by component; only pairs across components are formed."""

    def pairs(hashes: np.ndarray, component: np.ndarray, node: np.ndarray, n: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        change = hashes[1:] != hashes[:-1]
        group = np.append(np.flatnonzero(change), len(hashes) - 1) + 1
        run = np.append(np.flatnonzero(change | (component[1:] != component[:-1])), len(hashes) - 1) + 1
        every = np.arange(len(hashes))
        i, j, end = every, run[np.searchsorted(run, every, "right")], group[np.searchsorted(group, every, "right")]
        while len(i := i[alive := j < end]):
            j, end = j[alive], end[alive]
            low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            room = np.minimum(n[i] - place[i], n[j] - place[j])  # of this hash and what follows
            fits = (low >= similarity * high - 1e-6) & (room >= similarity / (1 + similarity) * (n[i] + n[j]) - 1e-6) & (node[i] != node[j])
            if fits.any():
                a, b = node[i[fits]], node[j[fits]]
                a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            j = j + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # parts of the columns from the last hash on
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(c).to_numpy() for c in ("hash", "component", "node", "n", "place")]
            cut = int(np.searchsorted(own[0], own[0][-1]))
            if cut or (held and held[-1][0][-1] != own[0][0]):
                ready = [np.concatenate(x) for x in zip(*held, [c[:cut] for c in own], strict=True)]
                held = []
                if len(ready[0]):
                    yield from pairs(*ready)
            held.append([c[cut:] for c in own])
        if held:
            yield from pairs(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def met(docs: DataFrame, copies: DataFrame, grouped: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes of different components; all pairs of that similarity are among them.

    docs: key, text. copies: the keys that aren't nodes. grouped: node and component of each node that isn't its own component.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = docs.join(sent(copies), "key", "left_anti").join(sent(grouped.withColumnRenamed("node", "key")), "key", "left")
    own = nodes.select("key", F.coalesce("component", "key").alias("component"), "text")
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(own, shingle))  # KEPT numbers at most
    entries = in_arrow(own, _prefixes(shingle, similarity, frequent), "hash long, component long, node long, n int, place int")
    return in_arrow(entries.repartition(parts, "hash").sortWithinPartitions("hash", "component"), _meetings(similarity), "a long, b long").distinct()


def near_duplicate_components(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """key and component (the smallest key of a group) of each distinct key of docs (doc_id, text).

    Texts belong to a group if a chain of pairs with at least that similarity links them. Equal sets of shingles always do; so do all texts without words. Null texts have no words; rows
    without doc_id share one key, and rows that share a key are one document. All links between groups are found, up to collisions of 64-bit hashes: first by the tables, then by prefixes.
    """
    held = ids_and_texts(docs).select("key", "text")
    found = _members(held, shingle, similarity)
    return held.select("key").distinct().join(found, "key", "left").select("key", F.coalesce("component", "key").alias("component"))


def _stars(grouped: DataFrame) -> DataFrame:
    """One link of each grouped node to its smallest stands for all pairs of its group, which needn't be joined again."""
    return grouped.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _members(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Of docs (key, text) each key that isn't the smallest of its group, and component, the smallest."""
    prints = checkpointed(in_arrow(docs, _prints(shingle), "key long, fingerprint binary, sketch binary, n int, digest long"))
    nodes = checkpointed(prints.groupBy("fingerprint", "sketch", "n", "digest").agg(F.min("key").alias("node")))
    same = prints.drop("sketch").join(nodes.drop("sketch"), ["fingerprint", "n", "digest"]).where("key != node").select(F.col("key").alias("a"), F.col("node").alias("b"))
    same = checkpointed(same)
    copies = checkpointed(same.select(F.col("a").alias("key")).join(nodes.select(F.col("node").alias("key")), "key", "left_anti"))
    grouped = components(verified(docs, chained(nodes, similarity), shingle, similarity))
    near = verified(docs, proposed(nodes, similarity, grouped), shingle, similarity)
    grouped = components(_stars(grouped).unionByName(near))
    missed = plausible(met(docs, copies, grouped, shingle, similarity), nodes, similarity)
    # a copy with one node and no other link goes where its node, a smaller key, goes: it needn't take part in the rounds
    ends = same.groupBy("a").agg(F.min("b").alias("b"), F.count(F.lit(1)).alias("links")).where("links = 1").drop("links")
    ends = checkpointed(ends.join(copies.withColumnRenamed("key", "a"), "a", "left_semi"))
    others = same.join(ends, "a", "left_anti")
    found = components(_stars(grouped).unionByName(verified(docs, missed, shingle, similarity)).unionByName(others))
    follow = ends.join(found.withColumnRenamed("node", "b"), "b", "left").select(F.col("a").alias("node"), F.coalesce("component", "b").alias("component"))
    return found.unionByName(follow).withColumnRenamed("node", "key")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates, the row with the smallest doc_id.

    Several texts of one id, or without one, are documents of their own; of equal rows one stays. Null and empty texts have no words and are one group. All columns stay, whatever
    their names. An empty table gives an empty one.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    own = free_name(docs, "near_duplicates")
    held = ids_and_texts(docs).select("key", "text")
    if held.groupBy("key").count().where("count > 1").isEmpty():
        gone = sent(_members(held).select(F.col("key").alias(own)))
        return docs.join(gone, key == F.col(own), "left_anti")
    held = checkpointed(distinct_documents(docs))
    gone = sent(_members(held.select("key", "text")).select("key"))
    kept = held.join(gone, "key", "left_anti").select(F.struct(key.alias("key"), F.xxhash64("text").alias("mark")).alias(own)).distinct()
    marked = docs.withColumn(own, F.struct(key.alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")))
    return marked.join(kept, own, "left_semi").dropDuplicates([own]).select(*docs.columns)
