"""Windows of a fixed length that occur in several places: what substring dedup and suffix-array dedup share.

Comparing every window of every text would shuffle many times the input. Instead each window chooses an anchor, the
smallest hash among its k-grams. Equal windows choose equal anchors at equal places, so windows can only be equal if
the suffixes at their anchors begin with the same k tokens. Consecutive windows with one anchor form a segment, about one row for w - k tokens:

1. Every text is cut into segments, one row each (prefix: hash of the anchor's k tokens; run: hash of the whole segment; document, start, windows).
   Equal segments are the labels of one leaf: in a batch only the first goes on, and for the others it is settled that all of their
   windows occur earlier. A text that a third of all rows repeat so gives few rows for each task.
2. Segments meet by prefix. If one is alone, nothing repeats. Of equal segments the first goes on. If different
   segments share a prefix, these are compared in full.
3. A prefix that over `group_limit` different segments share is made longer. Each segment is halved for that: every window holds, besides the anchor's k tokens, either
   so many tokens after them or so many before them, and each half's windows have these in common. A half is a segment with a longer prefix, so it goes through step 2 again.
4. For what must be compared the words or bytes are brought together by prefix; `resolve` orders the suffixes of
   such groups and tells which windows occur earlier. If a longer prefix still has too many different segments, they are dealt out to several tasks by document; each task settles
   what it can, and hands on what is first there, which meets by the hash of the window.
5. Windows to remove come together by document and are joined to the texts once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import BYTE_VALUES, U64, RangeHash, chunks, in_arrow, mix, ranges, text_bytes, word_spans, word_values

SEGMENTS = "prefix long, run long, key long, start int"
HALVES = SEGMENTS + ", content binary"
REQUESTS = "prefix long, salt int, key long, start int, windows int, content binary"
FINDINGS = "window_a long, window_b long, key long, start int, windows int"


@dataclass(frozen=True)
class Windows:
    """width: tokens in a window; gram: tokens in an anchor; words: tokens are words, else bytes; within: whether a window that
    starts earlier in the same document counts as an earlier one, not only one in an earlier document; group_limit: different segments that one task compares
    for one prefix; shard_bytes: whole groups are put together to shards of about so many bytes."""

    width: int
    gram: int
    words: bool
    within: bool
    group_limit: int = 1000
    shard_bytes: int = 3 << 20

    @property
    def half(self) -> int:
        """Windows of half a segment."""
        return (self.width - self.gram + 2) // 2

    @property
    def count_bits(self) -> int:
        """Bits of a segment's hash that hold its number of windows."""
        return (self.width - self.gram + 1).bit_length()

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A value for each token, and where each text's tokens begin."""
        if not self.words:
            return BYTE_VALUES[data], offsets
        starts, ends, before = word_spans(data, offsets)
        return word_values(data, starts, ends), before


#: A segment's place lies in so many bits of what chooses anchors; texts are cut into pieces of so many windows at most.
PLACES, PIECE = U64((1 << 32) - 1), 1 << 20


def _run(hashes: np.ndarray, count: np.ndarray, spec: Windows) -> np.ndarray:
    """The hash of a segment with its number of windows in the lowest bits."""
    return (hashes << U64(spec.count_bits) | count.astype(U64)).view(np.int64)


def segments(values: np.ndarray, offsets: np.ndarray, spec: Windows) -> dict[str, np.ndarray]:
    """The segments of the texts whose tokens lie between offsets: text, start (in the text), prefix, run (hash and number of windows)."""
    w, k = spec.width, spec.gram
    first, lengths = offsets[:-1], np.maximum(np.diff(offsets) - w + 1, 0)
    if not lengths.sum():
        return {n: np.zeros(0, np.int64) for n in ("text", "start", "prefix", "run")}
    if len(values) > PIECE + w:  # a few windows at a time, each with all of its tokens; a segment that is cut is two segments
        parts = []
        for text, (begin, count) in enumerate(zip(first.tolist(), lengths.tolist(), strict=True)):
            for i in range(0, count, PIECE):
                n = min(PIECE, count - i)
                part = segments(values[begin + i : begin + i + n + w - 1], np.array([0, n + w - 1]), spec)
                parts.append(part | {"text": part["text"] + text, "start": part["start"] + i})
        return {n: np.concatenate([part[n] for part in parts]) for n in parts[0]}
    hashed = RangeHash(values)
    grams = hashed.each(k)
    least = (grams & ~PLACES) | np.arange(len(grams), dtype=U64)  # as many bits of the hash everywhere, then the leftmost
    covered, size = 1, w - k + 1
    while covered * 2 <= size:
        least = np.minimum(least[:-covered], least[covered:])
        covered *= 2
    if covered < size:
        least = np.minimum(least[: len(least) - (size - covered)], least[size - covered :])
    starts = ranges(first, lengths)
    at = (least[starts] & PLACES).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    where = np.flatnonzero(new)
    count = np.diff(np.append(where, len(starts)))
    begin = starts[where]
    text = np.repeat(np.arange(len(lengths)), lengths)[where]
    return {
        "text": text,
        "start": begin - first[text],
        "prefix": grams[at[where]].view(np.int64),
        "run": _run(hashed.of(begin, begin + count + w - 1), count, spec),
    }


def _settled(rows: dict[str, np.ndarray], spec: Windows) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Rows of a batch, in their order, and which of them need not be compared: of equal segments all but the first. Those get a start below 0 and a prefix that spreads them."""
    order = np.lexsort((rows["start"], rows["key"], rows["run"], rows["prefix"]))
    prefix, run, key, start = (rows[n][order] for n in ("prefix", "run", "key", "start"))
    new = np.ones(len(order), bool)
    new[1:] = (prefix[1:] != prefix[:-1]) | (run[1:] != run[:-1])
    leader = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    later = key != key[leader]
    if spec.within:
        later |= start != start[leader]
    settled = np.empty(len(order), bool)
    settled[order] = later
    anywhere = mix(rows["prefix"].view(U64) ^ mix(rows["key"].view(U64) + rows["start"].astype(U64))).view(np.int64)
    changed = {"prefix": np.where(settled, anywhere, rows["prefix"]), "start": np.where(settled, -1 - rows["start"], rows["start"]).astype(np.int32)}
    return rows | changed, settled


def _segment_rows(spec: Windows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            parts = []
            for i, j in chunks(offsets):
                piece = data[offsets[i] : offsets[j]]
                found = segments(*spec.tokens(piece, offsets[i : j + 1] - offsets[i]), spec)
                found["key"] = keys[i:j][found.pop("text")]
                parts.append(found)
            if not parts:
                continue
            rows = {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}
            rows, _ = _settled(rows, spec)
            out = pa.RecordBatch.from_arrays([pa.array(rows[n]) for n in ("prefix", "run", "key", "start")], names=["prefix", "run", "key", "start"])
            for at in range(0, out.num_rows, 50_000):
                yield out.slice(at, 50_000)

    return run


def _compared(rows: DataFrame, spec: Windows, *carried: str) -> DataFrame:
    """key, start, windows, prefix (null: all of these windows occur earlier), salt: number of the task among those that compare a prefix which too many segments share, from 1, else 0."""
    group = Window.partitionBy("prefix")
    kind = Window.partitionBy("prefix", "run")
    place = F.struct("key", "start") if spec.within else F.struct("key")
    met = rows.withColumns({
        "n": F.count(F.lit(1)).over(group),
        "mixed": F.min("run").over(group) != F.max("run").over(group),
    }).where("start < 0 or n > 1")
    met = met.withColumn("first", (F.col("start") >= 0) & (place == F.min(F.when(F.col("start") >= 0, place)).over(kind)))
    kept = met.where("start < 0 or mixed or not first").withColumn("full", F.expr("start >= 0 and first"))
    asks = F.count_if("full").over(group)
    chunk = 1 + F.pmod(F.xxhash64("key", "start"), F.ceil(asks / F.lit(spec.group_limit)))
    return kept.select(
        "key",
        F.when(F.col("start") < 0, -1 - F.col("start")).otherwise(F.col("start")).alias("start"),
        F.col("run").bitwiseAND(F.lit((1 << spec.count_bits) - 1)).cast("int").alias("windows"),
        F.when(F.col("full"), F.col("prefix")).alias("prefix"),
        F.when(F.col("full") & (asks > spec.group_limit), chunk).otherwise(0).cast("int").alias("salt"),
        *carried,
    )


def _contents(spec: Windows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The words or bytes of the segments that must be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            out: dict[str, list] = {n: [] for n in _REQUEST_SCHEMA.names}
            size = 0
            for key, text, asked in zip(keys, batch.column("text"), batch.column("asked"), strict=True):
                if not asked.is_valid or not len(asked):
                    continue
                tokens = text.as_buffer().to_pybytes()
                tokens = tokens.split() if spec.words else tokens
                for x in asked.as_py():
                    part = tokens[x["start"] : x["start"] + x["windows"] + spec.width - 1]
                    out["prefix"].append(x["prefix"])
                    out["salt"].append(x["salt"])
                    out["key"].append(key)
                    out["start"].append(x["start"])
                    out["windows"].append(x["windows"])
                    out["content"].append(b" ".join(part) if spec.words else part)
                    size += len(out["content"][-1])
                    if size > REQUEST_BYTES:
                        yield pa.RecordBatch.from_pydict(out, schema=_REQUEST_SCHEMA)
                        out, size = {n: [] for n in out}, 0
            if out["key"]:
                yield pa.RecordBatch.from_pydict(out, schema=_REQUEST_SCHEMA)

    return run


def halves(values: np.ndarray, offsets: np.ndarray, prefix: np.ndarray, count: np.ndarray, spec: Windows) -> dict[str, np.ndarray]:
    """The halves of segments whose tokens lie between offsets: segment, start (first window in it), windows, prefix, run.

    An anchor lies so many tokens behind a window's start. Windows where these are fewer than `half` have the tokens from the anchor on in common, the others those that begin `half` before it.
    """
    w, k, half = spec.width, spec.gram, spec.half
    n = len(count)
    hashed = RangeHash(values)
    grams = hashed.each(k).view(np.int64)
    # the anchor lies in all windows: it is the leftmost such k-gram from the last window's start on
    free = w - k - count + 2
    places, owner = ranges(offsets[:-1] + count - 1, free), np.repeat(np.arange(n), free)
    hit = np.flatnonzero(grams[places] == prefix[owner])
    segment, at = np.unique(owner[hit], return_index=True)
    assert len(segment) == n
    anchor = places[hit[at]] - offsets[:-1]
    parts = []
    for low, high in ((0, half - 1), (half, w - k)):  # tokens between a window's start and the anchor
        begin, end = np.maximum(anchor - high, 0), np.minimum(anchor - low + 1, count)
        some = np.flatnonzero(end > begin)
        own = offsets[:-1][some]
        core = own + anchor[some] - low
        shared = hashed.of(core, core + w - (high - low)) + U64(low)
        first, windows = begin[some], (end - begin)[some]
        parts.append({
            "segment": some,
            "start": first,
            "windows": windows,
            "prefix": mix(shared).view(np.int64),
            "run": _run(hashed.of(own + first, own + first + windows + w - 1), windows, spec),
        })
    return {name: np.concatenate([x[name] for x in parts]) for name in parts[0]}


def _halved(spec: Windows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _contents(spec)(batches):
            data, byte_offsets = text_bytes(batch.column("content"))
            values, offsets = spec.tokens(data, byte_offsets)
            prefix, key, begin, count = (batch.column(n).to_numpy() for n in ("prefix", "key", "start", "windows"))
            found = halves(values, offsets, prefix, count, spec)
            of = found["segment"]
            rows, settled = _settled({"prefix": found["prefix"], "run": found["run"], "key": key[of], "start": begin[of] + found["start"]}, spec)
            first, last = offsets[of] + found["start"], offsets[of] + found["start"] + found["windows"] + spec.width - 1
            if spec.words:
                starts, ends, _ = word_spans(data, byte_offsets)
                first, last = starts[first], ends[last - 1]
            raw = data.tobytes()
            contents = [None if s else raw[a:b] for s, a, b in zip(settled.tolist(), first.tolist(), last.tolist(), strict=True)]
            columns = [pa.array(rows[n], t) for n, t in (("prefix", pa.int64()), ("run", pa.int64()), ("key", pa.int64()), ("start", pa.int32()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(contents, pa.binary())], names=["prefix", "run", "key", "start", "content"])

    return run


_REQUEST_SCHEMA = pa.schema([("prefix", pa.int64()), ("salt", pa.int32()), ("key", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("content", pa.binary())])
REQUEST_BYTES = 1 << 20

Resolver = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _resolved(spec: Windows, resolve: Resolver) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        data, offsets = text_bytes(table.column("content"))
        base = offsets[0]
        data, offsets = data[base : offsets[-1]], offsets - base
        values, offsets = spec.tokens(data, offsets)
        key, begin, count = (table.column(n).to_numpy() for n in ("key", "start", "windows"))
        windows = ranges(offsets[:-1], count)
        owner = np.repeat(np.arange(len(count)), count)
        place = begin[owner] + windows - offsets[:-1][owner]
        classes = resolve(data if not spec.words else values, offsets, windows, owner)
        order = np.lexsort((place, key[owner], classes))
        c, k, p, o = classes[order], key[owner][order], place[order].astype(np.int64), owner[order]
        new = np.ones(len(order), bool)
        new[1:] = c[1:] != c[:-1]
        leader = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        later = k != k[leader]
        if spec.within:
            later |= p != p[leader]
        yield from _findings(k[later], p[later])
        spread = (table.column("salt").to_numpy() > 0)[o] & ~later
        if spread.any():
            at = windows[order][spread]
            one = RangeHash(values).of(at, at + spec.width)
            two = RangeHash(mix(values ^ U64(0x2545F4914F6CDD1D))).of(at, at + spec.width)
            yield from _candidates(one.view(np.int64), two.view(np.int64) | 1, k[spread], p[spread])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            known = batch.column("content").is_null()
            if pc.any(known).as_py():  # halves for which it is settled that all of their windows occur earlier
                of = batch.filter(known)
                key, start, count = (of.column(n).to_numpy().astype(np.int64) for n in ("key", "start", "windows"))
                yield from _findings(np.repeat(key, count), ranges(start, count))
                batch = batch.filter(pc.invert(known))
            while batch.num_rows:
                if size >= spec.shard_bytes:  # the shard ends where the group does
                    last = (held[-1].column("prefix")[-1], held[-1].column("salt")[-1])
                    same = np.asarray(batch.column("prefix")) == last[0].as_py()
                    same &= np.asarray(batch.column("salt")) == last[1].as_py()
                    n = int(np.argmin(same)) if not same.all() else batch.num_rows
                    if n:
                        held.append(batch.slice(0, n))
                        batch = batch.slice(n)
                    if batch.num_rows:
                        yield from settle(pa.Table.from_batches(held))
                        held, size = [], 0
                else:
                    piece = batch.slice(0, 2000)
                    held.append(piece)
                    size += pc.sum(pc.binary_length(piece.column("content"))).as_py()
                    batch = batch.slice(piece.num_rows)
        if held:
            yield from settle(pa.Table.from_batches(held))

    return run


def _findings(key: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Windows that occur earlier as rows of FINDINGS, one for neighbouring starts."""
    if not len(key):
        return
    order = np.lexsort((start, key))
    key, start = key[order], start[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (start[1:] > start[:-1] + 1)
    at = np.flatnonzero(new)
    ends = start[np.append(at[1:] - 1, len(start) - 1)]
    key, start = key[at], start[at]
    anywhere = mix(key.view(U64) ^ mix(start.view(U64))).view(np.int64)
    yield from _candidates(anywhere, np.zeros(len(key), np.int64), key, start, ends - start + 1)


def _candidates(a: np.ndarray, b: np.ndarray, key: np.ndarray, start: np.ndarray, count: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    count = np.ones(len(key), np.int64) if count is None else count
    for i in range(0, len(key), 50_000):
        j = slice(i, i + 50_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a[j]), pa.array(b[j]), pa.array(key[j]), pa.array(start[j].astype(np.int32)), pa.array(count[j].astype(np.int32))],
            names=["window_a", "window_b", "key", "start", "windows"],
        )


def repeated_windows(texts: DataFrame, spec: Windows, resolve: Resolver) -> DataFrame:
    """texts (key, doc_id, text) with `gone`: the windows of each text that occur earlier, as an array of (start, windows); `asked` is what was compared for that.

    texts has key (not null; smaller keys are earlier), doc_id and text (not null). Rows that share a key are one document.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = in_arrow(texts.select("key", "text"), _segment_rows(spec), SEGMENTS)
    by_text = (
        _compared(rows, spec)
        .groupBy("key")
        .agg(
            F.collect_list(F.when(F.col("prefix").isNull(), F.struct("start", "windows"))).alias("gone"),
            F.collect_list(F.when(F.col("prefix").isNotNull(), F.struct("prefix", "salt", "start", "windows"))).alias("asked"),
        )
    )
    # All uses of `held` take all of its columns: so the texts are shuffled once and the exchange is used again.
    held = texts.join(by_text, "key", "left").select("key", "doc_id", "text", "gone", "asked")
    of = lambda crowded: held.withColumn("asked", F.filter("asked", lambda x: (x["salt"] > 0) == F.lit(crowded))).where(F.size("asked") > 0)
    whole = in_arrow(of(False), _contents(spec), REQUESTS)
    longer = _compared(in_arrow(of(True), _halved(spec), HALVES), spec, "content")
    longer = longer.select(
        F.coalesce("prefix", F.xxhash64("key", "start")).alias("prefix"), "salt", "key", "start", "windows", F.when(F.col("prefix").isNotNull(), F.col("content")).alias("content")
    )
    groups = whole.unionByName(longer).repartition(parts, "prefix", "salt").sortWithinPartitions("prefix", "salt", "key", "start")
    found = in_arrow(groups, _resolved(spec, resolve), FINDINGS)
    place = F.struct("key", "start") if spec.within else F.struct("key")
    met = found.withColumn("first", F.min(place).over(Window.partitionBy("window_a", "window_b")))
    late = met.where((F.col("window_b") == 0) | (place != F.col("first")))
    more = late.groupBy("key").agg(F.collect_list(F.struct("start", "windows")).alias("more"))
    none = F.array().cast("array<struct<start:int,windows:int>>")
    gone = F.concat(F.coalesce("gone", none), F.coalesce("more", none)).alias("gone")
    return held.join(more, "key", "left").select("key", "doc_id", "text", gone, "asked")


def covered(gone: np.ndarray, counts: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of n tokens a window covers, given first starts and numbers of consecutive windows."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, gone, 1)
    np.add.at(edges, np.minimum(gone + counts + width - 1, n), -1)
    return np.cumsum(edges[:-1]) > 0


def gone_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, starts and window counts of an Arrow column of arrays of (start, windows)."""
    flat = column.flatten()
    lengths = np.diff(column.offsets.to_numpy())
    starts, counts = (np.asarray(flat.field(i)) for i in (0, 1))
    return np.concatenate([[0], np.cumsum(lengths)]), starts, counts
