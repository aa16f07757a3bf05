"""Media columns: Ogg. Pages with checksums, packets over lacing values, several logical streams, times from granule positions."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import documents, in_arrow, text_bytes

# Fixed values of the container format: capture pattern, header fields, flags, and the limit of lacing values in a page.
CAPTURE = b"OggS"
HEADER = struct.Struct("<4sBBqIIIB")  # capture, version, flags, granule position, serial, page number, checksum, lacing values
CONTINUED, FIRST_PAGE, LAST_PAGE = 1, 2, 4
LACINGS = 255

#: What the streams here carry: one header packet each, then packets of 8-bit samples.
MAGIC = b"SAMPLES8"
STREAM_HEADER = struct.Struct("<8sIHH")  # magic, samples a second, number of streams, number of this stream
RATE, STREAMS, PACKET = 8000, 2, 1024
BLOCK = 64

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """The format's CRC (polynomial 04c11db7, most significant bit first, from zero): zlib's with all bits in the other order."""
    value = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(value.to_bytes(4, "little").translate(_REVERSED), "big")


class OggError(ValueError):
    """The bytes aren't a whole, undamaged Ogg stream."""


def pages_of(packets: list[bytes], serial: int, granules: list[int]) -> list[bytes]:
    """The pages of one logical stream; the first packet has a page of its own. granules: the position after each packet."""
    lacings: list[tuple[int, bytes, int]] = []  # value, bytes, granule position if the packet ends here or -1
    out: list[bytes] = []

    def page(part: list[tuple[int, bytes, int]], flags: int) -> None:
        granule = max((g for v, _, g in part if v < 255), default=-1)
        values = bytes(v for v, _, _ in part)
        head = HEADER.pack(CAPTURE, 0, flags, granule, serial, len(out), 0, len(part)) + values
        body = head + b"".join(b for _, b, _ in part)
        out.append(body[:22] + checksum(body).to_bytes(4, "little") + body[26:])

    for packet, granule in zip(packets, granules, strict=True):
        whole = len(packet) // 255
        lacings += [(255, packet[i * 255 : i * 255 + 255], -1) for i in range(whole)]
        lacings.append((len(packet) % 255, packet[whole * 255 :], granule))
    first = len(packets[0]) // 255 + 1
    page(lacings[:first], FIRST_PAGE | (LAST_PAGE if first == len(lacings) else 0))
    for i in range(first, len(lacings), LACINGS):
        goes_on = CONTINUED if lacings[i - 1][0] == 255 else 0
        page(lacings[i : i + LACINGS], goes_on | (LAST_PAGE if i + LACINGS >= len(lacings) else 0))
    return out


def write(samples: bytes, streams: int = STREAMS, rate: int = RATE, packet: int = PACKET) -> bytes:
    """Samples as packets that go to `streams` logical streams in turn; the streams' pages are interleaved, first pages first."""
    pieces = [samples[i : i + packet] for i in range(0, len(samples), packet)]
    laid = []
    for k in range(streams):
        own = pieces[k::streams]
        granules, total = [0], 0
        for x in own:
            total += len(x)
            granules.append(total)
        laid.append(pages_of([STREAM_HEADER.pack(MAGIC, rate, streams, k), *own], k + 1, granules))
    deepest = max(map(len, laid))
    return b"".join(pages[i] for i in range(deepest) for pages in laid if i < len(pages))


@dataclass
class Packet:
    serial: int
    number: int
    granule: int | None
    data: bytes


def read_packets(media: bytes) -> tuple[list[Packet], int]:
    """The packets of all logical streams and the number of pages. Damage, gaps and unfinished packets raise OggError.

    A packet's granule position is the page's for the last packet that ends in a page, else None.
    """
    found: list[Packet] = []
    parts: dict[int, list[bytes]] = {}
    seen: dict[int, int] = {}
    numbers: dict[int, int] = {}
    ended: set[int] = set()
    at = pages = 0
    while at < len(media):
        if at + HEADER.size > len(media):
            raise OggError("a page header is cut off")
        capture, version, flags, granule, serial, number, crc, count = HEADER.unpack_from(media, at)
        values = media[at + HEADER.size : at + HEADER.size + count]
        end = at + HEADER.size + count + sum(values)
        if capture != CAPTURE or version or len(values) < count or end > len(media):
            raise OggError("not a page")
        page = media[at:end]
        if checksum(page[:22] + bytes(4) + page[26:]) != crc:
            raise OggError("a page's checksum is wrong")
        if bool(flags & FIRST_PAGE) != (serial not in seen) or seen.get(serial, -1) + 1 != number or serial in ended:
            raise OggError("pages are missing or out of order")
        if bool(flags & CONTINUED) != bool(parts.get(serial)):
            raise OggError("a packet is not continued")
        seen[serial] = number
        if flags & LAST_PAGE:
            ended.add(serial)
        place, own = HEADER.size + count, parts.pop(serial, [])
        last = None
        for value in values:
            own.append(page[place : place + value])
            place += value
            if value < 255:
                last = Packet(serial, numbers.get(serial, 0), None, b"".join(own))
                numbers[serial] = last.number + 1
                found.append(last)
                own = []
        if own:
            parts[serial] = own
        if last is not None:
            last.granule = granule
        at, pages = end, pages + 1
    if parts or ended != set(seen):
        raise OggError("a stream has no end")
    return found, pages


def read(media: bytes) -> tuple[bytes, list[tuple[int, int, float, bytes]], int]:
    """The samples, (serial, number, second at which it ends, data) of each packet of samples, and the number of pages."""
    packets, pages = read_packets(media)
    streams: dict[int, list[Packet]] = {}
    for p in packets:
        streams.setdefault(p.serial, []).append(p)
    heads = {s: STREAM_HEADER.unpack(own[0].data) for s, own in streams.items()}
    if any(h[0] != MAGIC for h in heads.values()):
        raise OggError("a stream holds something else")
    order = sorted(streams, key=lambda s: heads[s][3])
    timed = []
    for s in order:
        own, position = streams[s][1:], 0
        for p in own:
            position += len(p.data)
            if p.granule is not None and p.granule != position:
                raise OggError("a granule position doesn't fit the samples")
            timed.append((s, p.number - 1, position / heads[s][1], p.data))
    rank = {s: i for i, s in enumerate(order)}
    timed.sort(key=lambda x: (x[1], rank[x[0]]))
    return b"".join(x[3] for x in timed), timed, pages


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % BLOCK if text else BLOCK)


def write_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media (binary) for each row of docs; a null text is empty. Equal texts give equal media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_buffer().to_pybytes() for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), pa.array([write(padded(x)) for x in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), run, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """doc_id, serial, packet, seconds (its end in its stream), data (binary) of each packet of samples and error (null, or what is wrong with the file; then the rest is null). Null media give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "serial", "packet", "seconds", "data", "error"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.string()]
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                if data is None:
                    continue
                try:
                    rows += [(doc_id, *x, None) for x in read(data)[1]]
                except (OggError, struct.error, IndexError) as e:
                    rows.append((doc_id, None, None, None, None, str(e) or type(e).__name__))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return in_arrow(media.select(F.col("doc_id").cast("long").alias("doc_id"), "media"), run, "doc_id long, serial long, packet long, seconds double, data binary, error string")


def digests(docs: DataFrame) -> DataFrame:
    """The stored form of each text and what reading it back gives; a null text is empty. feature: streams, packets, pages, milliseconds and mean sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            rows = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                media = write(padded(data[a:b].tobytes()))
                samples, timed, pages = read(media)
                ends: dict[int, float] = {}
                for serial, _, seconds, _ in timed:
                    ends[serial] = seconds
                mean = int(np.frombuffer(samples, np.uint8).sum(dtype=np.int64)) / len(samples)
                feature = f"streams={len(ends)};packets={len(timed)};pages={pages};ms={1000 * max(ends.values()):.3f};mean={mean:.6f}"
                rows.append((b - a, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            columns = [pa.array(c) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return in_arrow(rows, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
