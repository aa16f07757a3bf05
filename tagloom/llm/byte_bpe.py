"""Byte-level BPE: pre-tokenisation without regex, cached merging of the pieces, decoding.

The split pattern is a finite automaton over classes of code points. Every class is a function from state to state; such functions
compose associatively, and the automaton has few distinct compositions. So texts are cut into blocks, each block's function
is found for all blocks side by side, the functions are combined across blocks by a doubling scan, and a second
pass over the blocks from their entry states marks where pieces begin. What the pattern decides by looking ahead
(contractions, the last white space before a word) goes into the class of a code point.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import BYTE_VALUES, U64, RangeHash, chunks, documents, in_arrow, ranges, text_bytes

# Unicode's White_Space, and the contractions of the split pattern by their length.
WHITE_SPACE = [9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")
# Letters and numbers that Unicode 16 added; Python's own table may be older.
LETTERS_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NUMBERS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

LETTER, NUMBER, OTHER, QUOTE_1, QUOTE_2, SPACES, LAST_BLANK, LAST_SPACE = range(8)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACES, PREFIX, ONE_MORE, TWO_MORE = range(8)
FIRST = 8  # added to the class of a text's first code point
PAD = 16

BLOCK = 256
#: Pieces up to so many bytes are merged side by side, longer ones with a heap each.
SHORT_PIECE = 32
#: A worker forgets its pieces once it knows so many, or so many bytes of them.
CACHE_PIECES, CACHE_BYTES = 100_000, 8 << 20
NONE = np.int32(2**31 - 1)


@lru_cache
def _classes() -> np.ndarray:
    """By code point: LETTER, NUMBER, OTHER or SPACES (LAST_BLANK for the blank)."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for kind, added in ((LETTER, LETTERS_16), (NUMBER, NUMBERS_16)):
        for first, last in added:
            out[first : last + 1] = kind
    out[WHITE_SPACE] = SPACES
    out[0x20] = LAST_BLANK
    return out


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether a piece begins."""
    if kind == PAD:
        return state, False
    if kind >= FIRST:
        state, kind = FRESH, kind - FIRST
    if state in (ONE_MORE, TWO_MORE):
        return (FRESH if state == ONE_MORE else ONE_MORE), False
    if kind in (LETTER, NUMBER):
        into = IN_LETTERS if kind == LETTER else IN_NUMBERS
        return into, state not in (into, PREFIX)
    if kind in (OTHER, QUOTE_1, QUOTE_2):
        if state in (IN_OTHER, PREFIX):
            return IN_OTHER, False
        return {OTHER: IN_OTHER, QUOTE_1: ONE_MORE, QUOTE_2: TWO_MORE}[kind], True
    if kind == SPACES:
        return IN_SPACES, state != IN_SPACES
    return (PREFIX if kind == LAST_BLANK else FRESH), True


@lru_cache
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """next state and piece start by state and class; all compositions by number: of one with a class, of two, and their value at FRESH."""
    steps = [[_step(s, k) for k in range(PAD + 1)] for s in range(8)]
    then = np.array([[x[0] for x in row] for row in steps], np.uint8)
    begins = np.array([[x[1] for x in row] for row in steps], bool)
    found = {tuple(range(8)): 0}
    todo = list(found)
    for f in todo:
        for k in range(PAD + 1):
            g = tuple(int(then[s, k]) for s in f)
            if g not in found:
                found[g] = len(found)
                todo.append(g)
    maps = np.array(todo, np.uint8)
    append = np.array([[found[tuple(then[f, k].tolist())] for k in range(PAD + 1)] for f in maps], np.int32)
    compose = np.array([[found[tuple(g[f].tolist())] for g in maps] for f in maps], np.int32)
    return then, begins, append, compose, maps[:, FRESH]


def code_point_kinds(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The automaton's classes of the code points of some texts, which begin at firsts."""
    kinds = _classes()[points]
    space = kinds >= SPACES
    n = len(points)
    end = np.zeros(n + 2, bool)
    end[firsts] = True
    end[n:] = True
    after = np.append(points[1:], [0, 0])[: n + 1]
    after[:n][end[1 : n + 1]] = 0
    free = np.append(space[1:], True) | end[1 : n + 1]
    kinds = np.where(space, np.where(free, SPACES, np.where(points == 0x20, LAST_BLANK, LAST_SPACE)), kinds).astype(np.uint8)
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        one = after[quotes]
        two = np.where(one > 0, after[np.minimum(quotes + 1, n)], 0)
        kinds[quotes[np.isin(one, [ord(c) for c in ONE_LETTER])]] = QUOTE_1
        kinds[quotes[np.isin(one.astype(np.int64) << 32 | two, [ord(a) << 32 | ord(b) for a, b in TWO_LETTERS])]] = QUOTE_2
    kinds[firsts[firsts < n]] += FIRST
    return kinds


def piece_starts(kinds: np.ndarray) -> np.ndarray:
    """The places where pieces begin."""
    then, begins, append, compose, at_fresh = _automaton()
    n = len(kinds)
    count = -(-n // BLOCK)
    columns = np.full(count * BLOCK, PAD, np.uint8)
    columns[:n] = kinds
    columns = np.ascontiguousarray(columns.reshape(count, BLOCK).T)
    function = np.zeros(count, np.int32)
    flat, width = append.ravel(), append.shape[1]
    for column in columns:
        function = flat[function * width + column]
    step = 1
    while step < count:
        function[step:] = compose[function[:-step], function[step:]]
        step *= 2
    state = np.append(np.uint8(FRESH), at_fresh[function[:-1]])
    marks = np.empty((BLOCK, count), bool)
    flat, starts, width = then.ravel(), begins.ravel(), then.shape[1]
    for column, mark in zip(columns, marks, strict=True):
        at = state.astype(np.int32) * width + column
        mark[:] = starts[at]
        state = flat[at]
    return np.flatnonzero(marks.T.ravel()[:n])


class Vocabulary:
    """Ranks of byte strings, the merges they imply, and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        texts = [b""] * size
        for text, rank in self.ranks.items():
            texts[rank] = text
        self.lengths = np.fromiter(map(len, texts), np.int64, size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        get = self.ranks.get
        left, right, merged = [], [], []
        for text, rank in self.ranks.items():
            for i in range(1, len(text)):
                a, b = get(text[:i]), get(text[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full((1 << self.bits) + 64, -1, np.int64)
        self.merged = np.full(len(self.keys), NONE, np.int32)
        waiting = np.arange(len(keys))
        slots = self._slots(keys)
        while len(waiting):  # open addressing: of those that want one free slot, one gets it
            free = self.keys[slots[waiting]] < 0
            taker = waiting[free]
            self.keys[slots[taker]] = keys[taker]
            won = self.keys[slots[waiting]] == keys[waiting]
            self.merged[slots[waiting[won]]] = np.array(merged, np.int32)[waiting[won]]
            waiting = waiting[~won]
            slots[waiting] += 1
            if len(waiting) and slots[waiting].max() >= len(self.keys):
                raise ValueError("the table of merges is too small")

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def merge_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that two neighbours become, NONE if they don't; it is also the rank of the merge."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        slots = self._slots(keys)
        out = np.full(len(keys), NONE, np.int32)
        waiting = np.arange(len(keys))
        while len(waiting):
            there = self.keys[slots[waiting]]
            hit = there == keys[waiting]
            out[waiting[hit]] = self.merged[slots[waiting[hit]]]
            waiting = waiting[~hit & (there >= 0)]
            slots[waiting] += 1
        return out

    def merge_short(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of pieces of similar, small length; all pieces take a merge at a time."""
        rows, width = len(pieces), max(map(len, pieces))
        ids = np.full((rows, width), -1, np.int32)
        lengths = np.fromiter(map(len, pieces), np.int64, rows)
        ids[np.arange(width) < lengths[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        out = ids.copy()
        live = np.arange(rows)
        ranks = np.full((rows, width), NONE, np.int32)
        if width > 1:
            ranks[:, :-1] = self.merge_of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(rows, width - 1)
        columns = np.arange(width)
        while len(live):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(live)), at]
            done = best == NONE
            if done.any():
                out[live[done]] = ids[done]
                live, ids, ranks, at, best = live[~done], ids[~done], ranks[~done], at[~done], best[~done]
                if not len(live):
                    break
            row = np.arange(len(live))
            behind = columns >= at[:, None] + 1
            shifted = np.append(ids[:, 1:], np.full((len(live), 1), -1, np.int32), axis=1)
            ids = np.where(behind, shifted, ids)
            ids[row, at] = best
            ranks = np.where(behind, np.append(ranks[:, 1:], np.full((len(live), 1), NONE, np.int32), axis=1), ranks)
            following = np.where(at + 1 < width, ids[row, np.minimum(at + 1, width - 1)], -1)
            ranks[row, at] = self.merge_of(best, following)
            inner = np.flatnonzero(at > 0)
            ranks[inner, at[inner] - 1] = self.merge_of(ids[inner, at[inner] - 1], best[inner])
        return [x[x >= 0] for x in out]

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The ids of one piece: the lowest merge first, the leftmost of equals."""
        n = len(piece)
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        first = self.merge_of(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(r), i) for i, r in enumerate(first) if r != NONE]
        rank = {i: r for r, i in heap}
        heapq.heapify(heap)
        texts = self.text_of
        while heap:
            r, i = heapq.heappop(heap)
            if rank.get(i) != r:
                continue
            j = after[i]
            ids[i], after[i] = r, after[j]
            ids[j] = -1
            rank.pop(j, None)
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                rank.pop(a, None)
                if a >= 0 and after[a] < n:
                    pair = self.ranks.get(texts(ids[a]) + texts(ids[after[a]]))
                    if pair is not None:
                        rank[a] = pair
                        heapq.heappush(heap, (pair, a))
        return np.array([x for x in ids if x >= 0], np.int32)

    def text_of(self, token: int) -> bytes:
        start = self.starts[token]
        return self.bytes[start : start + self.lengths[token]].tobytes()


class Codec:
    """Encodes and decodes batches of texts, and remembers the ids of the pieces it has met."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.forget()

    def forget(self) -> None:
        self.entries: dict[bytes, int] = {}
        self.size = 0
        self.starts, self.lengths = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool, self.used = np.zeros(4096, np.int32), 0

    def _learn(self, pieces: list[bytes]) -> None:
        known, rest = [], []
        for piece in pieces:
            whole = self.vocabulary.ranks.get(piece)
            if whole is not None:
                known.append((piece, np.array([whole], np.int32)))
            else:
                rest.append(piece)
        rest.sort(key=len)
        short = [p for p in rest if len(p) <= SHORT_PIECE]
        for i in range(0, len(short), 4096):
            part = short[i : i + 4096]
            known += zip(part, self.vocabulary.merge_short(part), strict=True)
        known += [(p, self.vocabulary.merge_long(p)) for p in rest[len(short) :]]
        first = len(self.entries)
        sizes = np.fromiter((len(ids) for _, ids in known), np.int64, len(known))
        while len(self.starts) < first + len(known):
            self.starts, self.lengths = (np.append(x, np.zeros_like(x)) for x in (self.starts, self.lengths))
        while len(self.pool) < self.used + sizes.sum():
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        self.lengths[first : first + len(known)] = sizes
        self.starts[first : first + len(known)] = self.used + np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        if total:
            self.pool[self.used : self.used + total] = np.concatenate([ids for _, ids in known])
        self.used += total
        for i, (piece, _) in enumerate(known):
            self.entries[piece] = first + i
            self.size += len(piece)

    @staticmethod
    def _alike(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, others: np.ndarray) -> bool:
        """Whether all pieces, which follow one another, have the bytes of the pieces numbered in others."""
        return bool((lengths[others] == lengths).all() and (data[ranges(starts[others], lengths)] == data[starts[0] :]).all())

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of all texts, the byte (in data) where each token begins, and where each text's ids begin."""
        if len(self.entries) > CACHE_PIECES or self.size > CACHE_BYTES:
            self.forget()
        raw = data.tobytes()
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        sizes = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).astype(np.int64)
        places = np.append(0, np.cumsum(sizes))
        firsts = np.unique(np.searchsorted(places, offsets[:-1][np.diff(offsets) > 0]))
        starts = places[piece_starts(code_point_kinds(points, firsts))]
        ends = np.append(starts[1:], len(data))
        _, sample, inverse = np.unique(RangeHash(BYTE_VALUES[data]).of(starts, ends), return_index=True, return_inverse=True)
        if not self._alike(data, starts, ends - starts, sample[inverse]):  # two pieces share a hash: number them by what they are
            numbers: dict[bytes, int] = {}
            inverse = np.array([numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
            sample = np.unique(inverse, return_index=True)[1]
        pieces = [raw[a:b] for a, b in zip(starts[sample].tolist(), ends[sample].tolist(), strict=True)]
        if new := [p for p in pieces if p not in self.entries]:
            self._learn(new)
        entry = np.fromiter(map(self.entries.__getitem__, pieces), np.int64, len(pieces))[inverse]
        counts = self.lengths[entry]
        ids = self.pool[ranges(self.starts[entry], counts)]
        before = np.append(0, np.cumsum(counts))[np.searchsorted(starts, offsets)]
        spans = self.vocabulary.lengths[ids]
        return ids, np.cumsum(spans) - spans, before

    def decode(self, ids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts and where each begins, given ids and where each text's ids begin."""
        v = self.vocabulary
        lengths = v.lengths[ids]
        return v.bytes[ranges(v.starts[ids], lengths)], np.append(0, np.cumsum(lengths))[before]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each worker process and vocabulary file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, offsets array<int> (the byte of the text where each token begins), one row for each row of docs.

    A null or empty text has no tokens. Repeated rows and ids each have their row, and a null doc_id stays null. Other columns are ignored; an empty table gives an empty one.

    path: a rank file (base64 of a token's bytes, a blank, the rank in each line) that every executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in chunks(offsets):
                ids, starts, before = own.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                starts = starts - np.repeat(offsets[i:j] - offsets[i], np.diff(before))
                lists = [pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (ids, starts)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *lists], names=["doc_id", "ids", "offsets"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), run, "doc_id long, ids array<int>, offsets array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text (binary) of rows with doc_id and ids; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            column = batch.column("ids")
            lengths = np.array([len(x) if x.is_valid else 0 for x in column], np.int64)
            data, offsets = own.decode(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.append(0, np.cumsum(lengths)))
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "text"])

    return in_arrow(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")), run, "doc_id long, text binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and n_bytes of each row: encoded, and decoded from the ids again.

    A null or empty text has no tokens. Repeated rows and ids each have their row, and a null doc_id stays null. Texts of any length are encoded whole. Other columns are ignored; an empty
    table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in chunks(offsets):
                ids, _, before = own.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                decoded, ends = own.decode(ids, before)
                raw, text = memoryview(ids.astype("<u4").tobytes()), memoryview(decoded.tobytes())
                cuts, ends = (before * 4).tolist(), ends.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        pa.array(np.diff(before)),
                        pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:])]),
                        pa.array([hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(ends, ends[1:])]),
                        pa.array(np.diff(ends)),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return in_arrow(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), default_path())


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: doc_id, n_tokens, ids_sha256, decoded_sha256 and n_bytes of every document."""
    return digests(docs, default_path())
