"""Token counts without tokens: merges of a piece vocabulary, applied to many pre-tokens at once.

Texts become arrays of code points, with a mark for each blank and one before each text. Neighbours that stand together in no piece can't be merged, whatever
is merged around them: so pre-tokens, the longest ranges without such a border, are merged independently. Distinct pre-tokens lie in one ragged array of symbols. In a round, every
sequence finds its lowest rank and takes it; a rank's places are all taken at once where what it makes only merges at higher ranks, else the leftmost alone. What is left in the end is counted.

Blanks are merged last, among themselves, and of a run of blanks only the last can belong to a word. So a run's pieces are those of its length modulo the widest
piece of blanks, which are merged once, and one for each time that piece fits.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import RangeHash, U64, chunks, documents, in_arrow, mix, ranges, text_bytes

BLANK = 0x2581
NEVER = np.int32(2**31 - 1)
LIMIT = 4096
#: Distinct pre-tokens that a worker remembers at most, and symbols that are merged at a time.
REMEMBERED, TOGETHER = 500_000, 200_000


def _utf8_lengths(points: np.ndarray) -> np.ndarray:
    return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)


class Pieces:
    """The pieces of a vocabulary file, what pairs of symbols become, and which code points may stand together."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(" Ａ\t b ") != "▁▁Ａ\t▁b▁":
            raise ValueError("a vocabulary that changes texts isn't handled")
        usable = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        scores = {model.id_to_piece(i): model.get_score(i) for i in usable}
        order = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
        chars = sorted({c for piece in scores for c in piece})
        # symbol 0 is any code point that no piece has; then come code points, then longer pieces
        names = ["", *chars, *[p for p in scores if len(p) > 1]]
        symbol = {name: i for i, name in enumerate(names)}
        self.code = np.zeros(0x110000, np.int32)
        self.code[list(map(ord, chars))] = np.arange(1, len(chars) + 1)
        self.blank = symbol[chr(BLANK)]
        points = np.array([0, *map(ord, chars)])
        self.tokens = np.ones(len(names), np.int64)
        lone = np.array([False, *[c not in scores for c in chars]])
        self.tokens[np.flatnonzero(lone)] = _utf8_lengths(points)[lone]
        rank = np.full(len(names), NEVER, np.int32)
        for piece, score in scores.items():
            rank[symbol[piece]] = order[score]
        left, right, made = [], [], []
        for piece in scores:
            for i in range(1, len(piece)):
                a, b = symbol.get(piece[:i]), symbol.get(piece[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(symbol[piece])
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        by_key = np.argsort(keys)
        self.keys, self.made = np.append(keys[by_key], 2**62), np.append(np.array(made, np.int32)[by_key], 0)
        self.rank = rank
        # where no merge with what is made has a rank as low, all places of a rank are taken before any other
        lowest = np.full(len(names), NEVER, np.int32)
        for part in (left, right):
            np.minimum.at(lowest, np.array(part, np.int64), rank[np.array(made, np.int64)])
        shared = np.bincount(rank[rank < NEVER])
        self.at_once = (lowest > rank) & (rank < NEVER)
        self.at_once[self.at_once] = shared[rank[self.at_once]] == 1
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for piece in scores:
            codes = [symbol[c] for c in piece]
            self.beside[codes[:-1], codes[1:]] = True
        self.runs = self._runs(scores)
        self.beside[self.blank, self.blank] = False
        self.known: dict[bytes, int] = {}

    def _runs(self, scores: dict[str, float]) -> np.ndarray:
        """Into how many pieces runs of 0, 1, ... blanks are merged, up to the widest piece; each widest piece more is one more. Raises unless blanks are merged last and among themselves, as the module says."""
        blank = chr(BLANK)
        runs = {p for p in scores if set(p) == {blank} and len(p) > 1}
        mixed = {p for p in scores if blank in p[1:]}
        later = {p for p, score in scores.items() if score <= max((scores[x] for x in runs), default=-np.inf)}
        widest = max(map(len, runs), default=1)
        lengths = np.arange(2, 3 * widest + 1)
        symbols = np.full(lengths.sum(), self.blank, np.int32)
        found = np.append([0, 1], self.merged(symbols, np.cumsum(lengths) - lengths) // 2)
        if mixed != runs or later - {blank} != runs or (found[widest:] != found[:-widest] + 1).any():
            raise ValueError("a vocabulary in which blanks are merged with others isn't handled")
        return found[:widest]

    def merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol that two neighbours make, 0 for none."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.made[at], 0).astype(np.int32)

    def merged(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each sequence of symbols (at least two, beginning at starts) twice its tokens, and one more if it begins with a blank of its own."""
        out = np.zeros(len(starts), np.int64)
        live = np.arange(len(starts))
        made, ranks = np.zeros(len(symbols), np.int32), np.full(len(symbols), NEVER, np.int32)
        last = np.zeros(len(symbols), bool)
        last[np.append(starts[1:], len(symbols)) - 1] = True
        self._pair(symbols, made, ranks, last, np.arange(len(symbols)))
        while len(live):
            least = np.minimum.reduceat(ranks, starts)
            lengths = np.diff(np.append(starts, len(symbols)))
            ended = least == NEVER
            if ended.any():
                sums = np.add.reduceat(self.tokens[symbols], starts)
                out[live[ended]] = (2 * sums + (symbols[starts] == self.blank))[ended]
                stays = np.repeat(~ended, lengths)
                symbols, made, ranks, last = symbols[stays], made[stays], ranks[stays], last[stays]
                live, lengths, least = live[~ended], lengths[~ended], least[~ended]
                starts = np.cumsum(lengths) - lengths
                if not len(live):
                    break
            taken = self._taken(made, ranks, least, lengths)
            symbols[taken] = made[taken]
            last[taken] = last[taken + 1]
            stays = np.ones(len(symbols), bool)
            stays[taken + 1] = False
            symbols, made, ranks, last = symbols[stays], made[stays], ranks[stays], last[stays]
            before = np.cumsum(stays) - stays
            starts = before[starts]
            taken = before[taken]
            first = np.zeros(len(symbols), bool)
            first[starts] = True
            self._pair(symbols, made, ranks, last, np.union1d(taken, taken[~first[taken]] - 1))
        return out

    def _pair(self, symbols: np.ndarray, made: np.ndarray, ranks: np.ndarray, last: np.ndarray, at: np.ndarray) -> None:
        """Writes what the symbols at these places make with the next, and its rank."""
        made[at], ranks[at] = 0, NEVER
        at = at[~last[at]]
        made[at] = self.merges(symbols[at], symbols[at + 1])
        ranks[at] = np.where(made[at] > 0, self.rank[made[at]], NEVER)

    def _taken(self, made: np.ndarray, ranks: np.ndarray, least: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The places at which every sequence takes its lowest rank in this round; none of them overlap."""
        at = np.flatnonzero(ranks == np.repeat(least, lengths))
        row = np.repeat(np.arange(len(lengths)), lengths)[at]
        leftmost = np.ones(len(at), bool)
        leftmost[1:] = row[1:] != row[:-1]
        # of neighbouring places every second one is free, from the left
        broken = np.ones(len(at), bool)
        broken[1:] = at[1:] != at[:-1] + 1
        run = np.maximum.accumulate(np.where(broken, np.arange(len(at)), 0))
        free = (np.arange(len(at)) - run) % 2 == 0
        return at[np.where(self.at_once[made[at]], free, leftmost)]

    def _learn(self, texts: list[bytes]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        texts.sort(key=len)  # sequences of one array end after about as many rounds
        sizes = np.fromiter((len(t) // 4 for t in texts), np.int64, len(texts))
        group = (np.cumsum(sizes) - sizes) // TOGETHER
        cuts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(texts)], strict=True):
            symbols = self.code[np.frombuffer(b"".join(texts[a:b]), np.uint32)]
            starts = np.cumsum(sizes[a:b]) - sizes[a:b]
            self.known.update(zip(texts[a:b], self.merged(symbols, starts).tolist(), strict=True))

    def _of_each(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """What `merged` gives for each of these ranges of code points; equal ranges are merged once."""
        lengths = ends - starts
        hashes = RangeHash(mix(points.astype(U64))).of(starts, ends)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        alike = lengths[first][which] == lengths
        if alike.all():
            alike = points[ranges(starts, lengths)] == points[ranges(starts[first][which], lengths)]
        if not alike.all():  # two that differ share a hash
            first = which = np.arange(len(starts))
        raw = points.tobytes()
        texts = [raw[4 * a : 4 * b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if new := list({t for t in texts if t not in self.known}):
            self._learn(new)
        return np.array([self.known[t] for t in texts], np.int64)[which]

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of tokens of each text; the texts' bytes begin at offsets."""
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        bounds = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
        filled = np.flatnonzero(np.diff(bounds))
        if not len(filled):
            return np.zeros(len(offsets) - 1, np.int64)
        begins = bounds[filled]
        points = np.insert(points, begins, BLANK)
        points[points == 0x20] = BLANK
        begins = begins + np.arange(len(begins))
        codes = self.code[points]
        border = np.ones(len(points), bool)
        border[1:] = ~self.beside[codes[:-1], codes[1:]]
        border[begins] = True
        starts = np.flatnonzero(border)
        ends = np.append(starts[1:], len(points))
        # twice the tokens, and whether a blank is left at the start
        found = np.where(codes[starts] > 0, 2 * self.tokens[codes[starts]], 2 * _utf8_lengths(points[starts])) + (codes[starts] == self.blank)
        longer = np.flatnonzero(ends - starts > 1)
        if len(longer):
            found[longer] = self._of_each(points, starts[longer], ends[longer])
        lone = (found & 1).astype(np.int64)
        sums = np.add.reduceat(found // 2 - lone, np.searchsorted(starts, begins))
        # lone blanks that follow one another, each a pre-token's first symbol
        blanks = starts[lone > 0]
        if len(blanks):
            new = np.ones(len(blanks), bool)
            new[1:] = blanks[1:] != blanks[:-1] + 1
            at = np.searchsorted(begins, blanks, "right") - 1
            new[1:] |= at[1:] != at[:-1]
            lead = np.flatnonzero(new)
            whole, rest = np.divmod(np.diff(np.append(lead, len(blanks))), len(self.runs))
            np.add.at(sums, at[lead], whole + self.runs[rest])
        out = np.zeros(len(offsets) - 1, np.int64)
        out[filled] = sums
        return out


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more tokens than limit) of each row of docs (doc_id, text), as the library counts them without begin or end.

    A null or empty text has no tokens; names of special tokens in a text are ordinary text. Repeated rows and ids each have their row, a null doc_id stays null. Texts of any length are counted whole.
    Other columns are ignored; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in chunks(offsets):
                tokens = own.count(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids, sizes = batch.column("doc_id").slice(i, j - i), np.diff(offsets[i : j + 1])
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return in_arrow(rows, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(documents(spark, sf_dir), default_path())
