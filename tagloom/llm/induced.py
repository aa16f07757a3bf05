"""Suffix order with common-prefix lengths by induced sorting, with queues that go to disk.

The order of all suffixes follows from the order of a third of them at most: those that start where the text turns from
falling to rising. Scanning suffixes in ascending order, each one tells the place of the suffix one symbol longer, if that
one falls (L); scanning in descending order does the same for the ones that rise (S). The suffixes waiting for their turn
lie in a priority queue. Its key is (first symbol, rank of the rest), and the ranks come in order, so it is a row of
first-in-first-out lists by symbol; each list holds tuples (suffix, length of the prefix shared with the tuple before) and
moves to a file when the queue as a whole outgrows its memory budget. A whole list is taken out at a time with numpy.

The turning suffixes are ordered by naming the pieces between them (the same induction orders the pieces) and sorting the
string of names, by recursion while that string is long and has few enough names for a list each, else by doubling in memory. Whether pieces are equal, and what
turning suffixes share, is found by looking at the symbols.
"""

from __future__ import annotations

import os
import tempfile
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np

#: More than any common prefix.
FAR = np.iinfo(np.int32).max
#: Names are sorted by recursion up to so many different ones; more would make lists of a few entries each.
LISTS = 1 << 12


@dataclass
class Work:
    """What a sort did: times that lists moved to files, entries in them, and depth of the recursion."""

    spills: int = 0
    spilled: int = 0
    depth: int = 0


class SymbolQueue:
    """First-in-first-out lists of (suffix, common prefix) by symbol; over `budget` held entries, lists move to files."""

    def __init__(self, budget: int, work: Work):
        self.budget, self.held, self.work = budget, 0, work
        self.lists: dict[int, list[np.ndarray]] = {}
        self.files: dict[int, str] = {}
        self.folder: tempfile.TemporaryDirectory | None = None

    def put(self, symbol: int, entries: np.ndarray) -> None:
        self.lists.setdefault(symbol, []).append(entries)
        self.held += len(entries)
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="queue-")  # of this task alone: nobody else reads it
        self.work.spills += 1
        self.work.spilled += self.held
        for symbol, parts in self.lists.items():
            path = self.files.setdefault(symbol, os.path.join(self.folder.name, str(symbol)))
            with open(path, "ab") as f:
                for part in parts:
                    part.tofile(f)
        self.lists, self.held = {}, 0

    def take(self, symbol: int) -> np.ndarray:
        parts = self.lists.pop(symbol, [])
        self.held -= sum(map(len, parts))
        if path := self.files.pop(symbol, None):
            parts.insert(0, np.fromfile(path, np.int32).reshape(-1, 2))
            os.unlink(path)
        return np.concatenate(parts) if parts else np.zeros((0, 2), np.int32)

    def close(self) -> None:
        if self.folder is not None:
            self.folder.cleanup()


def _rising(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is smaller than the one after it; the length of the run of equal symbols at each place. The last symbol is the unique smallest one."""
    n = len(text)
    last = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    up = np.empty(len(last), bool)
    up[:-1] = text[last[:-1] + 1] > text[last[:-1]]
    up[-1] = True
    lengths = np.diff(last, prepend=-1)
    return np.repeat(up, lengths), np.repeat(last, lengths) - np.arange(n) + 1


class _Scan:
    """One pass of the induction. Entries come in the order of the pass with the prefix they share with the entry before."""

    def __init__(self, text: np.ndarray, budget: int, work: Work):
        self.text, self.queue = text, SymbolQueue(budget, work)
        self.since: dict[int, tuple[int, int]] = {}  # by symbol: the batch that put its last entry, and the least common prefix behind that in the batch
        self.batches, self.numbers, self.least = 0, [], []  # batches whose least common prefix is below that of all later ones

    def _since(self, symbol: int) -> int:
        """Least common prefix since the last entry put under a symbol."""
        batch, rest = self.since[symbol]
        i = bisect_right(self.numbers, batch)
        return min(rest, self.least[i]) if i < len(self.least) else rest

    def _seen(self, least: int) -> None:
        while self.least and self.least[-1] >= least:
            self.numbers.pop()
            self.least.pop()
        self.numbers.append(self.batches)
        self.least.append(least)
        self.batches += 1

    def induce(self, suffixes: np.ndarray, shared: np.ndarray, wanted: np.ndarray) -> None:
        """Put what each suffix induces; wanted: whether the suffix one longer belongs to this pass."""
        if not len(suffixes):
            return
        at = np.flatnonzero(wanted)
        if len(at):
            before = suffixes[at] - 1
            symbols = self.text[before]
            order = np.argsort(symbols, kind="stable")
            cuts = np.flatnonzero(np.diff(symbols[order])) + 1
            padded = np.append(shared, np.int32(FAR))
            for group in np.split(order, cuts):
                symbol = int(symbols[group[0]])
                where = at[group]
                least = np.zeros(0, np.int32)
                if len(where) > 1:  # each range runs from behind the last entry to this one
                    steps = np.empty(2 * (len(where) - 1), np.int64)
                    steps[0::2], steps[1::2] = where[:-1] + 1, where[1:] + 1
                    least = np.minimum.reduceat(padded, steps)[0::2]
                head = min(self._since(symbol), int(shared[: where[0] + 1].min())) if symbol in self.since else -1
                lcp = np.append(np.int32(head), least) + np.int32(1)
                self.queue.put(symbol, np.column_stack([before[group], lcp]))
                tail = shared[where[-1] + 1 :]
                self.since[symbol] = self.batches, int(tail.min()) if len(tail) else FAR
        self._seen(int(shared.min()))


def _induced(text: np.ndarray, up: np.ndarray, runs: np.ndarray, seeds: np.ndarray, seed_shared: np.ndarray, budget: int, work: Work) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, with the prefix each shares with the one before, from ordered seeds."""
    n = len(text)
    seeds, seed_shared, runs = (x.astype(np.int32) for x in (seeds, seed_shared, runs))
    symbols = np.flatnonzero(np.bincount(text))
    seed_symbols = text[seeds]
    bounds = np.searchsorted(seed_symbols, symbols), np.searchsorted(seed_symbols, symbols, "right")
    falling = ~up
    before_falls = np.append(False, falling[:-1])
    before_rises = np.append(False, up[:-1])
    lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    scan = _Scan(text, budget, work)
    try:
        for c, lo, hi in zip(symbols.tolist(), *map(np.ndarray.tolist, bounds), strict=True):
            taken, shares, first = [], [], True
            while len(entries := scan.queue.take(c)):
                entries = entries.copy()
                if first:
                    entries[0, 1] = 0
                    first = False
                taken.append(entries[:, 0])
                shares.append(entries[:, 1])
                scan.induce(entries[:, 0], entries[:, 1], before_falls[entries[:, 0]])
            own = np.concatenate(taken) if taken else np.zeros(0, np.int32)
            lists[c] = own, (np.concatenate(shares) if shares else own)
            if hi > lo:
                shared = seed_shared[lo:hi].copy()
                shared[0] = min(runs[own[-1]], runs[seeds[lo]]) if len(own) else 0
                scan.induce(seeds[lo:hi], shared, before_falls[seeds[lo:hi]])
    finally:
        scan.queue.close()
    # Downwards; each entry's value is the prefix it shares with the one before it in this pass, its upper neighbour.
    scan = _Scan(text, budget, work)
    out, common = np.empty(n, np.int32), np.zeros(n, np.int32)
    end = n
    try:
        for c in symbols[::-1].tolist():
            taken, shares, first = [], [], True
            if c == symbols[0]:  # the last symbol of all is a seed by itself
                scan.queue.put(c, np.array([[n - 1, 0]], np.int32))
            while len(entries := scan.queue.take(c)):
                entries = entries.copy()
                if first:
                    entries[0, 1] = 0
                    first = False
                taken.append(entries[:, 0])
                shares.append(entries[:, 1])
                scan.induce(entries[:, 0], entries[:, 1], before_rises[entries[:, 0]])
            rise = np.concatenate(taken) if taken else np.zeros(0, np.int32)
            rise_shared = np.concatenate(shares) if shares else rise
            fall, fall_shared = lists.pop(c)
            if len(fall):
                shared = np.append(np.int32(0), fall_shared[:0:-1])
                shared[0] = min(runs[fall[-1]], runs[rise[-1]]) if len(rise) else 0
                scan.induce(fall[::-1], shared, before_rises[fall[::-1]])
            k = len(rise)
            out[end - k : end] = rise[::-1]
            common[end - k + 1 : end] = rise_shared[:0:-1]
            if k and len(fall):
                common[end - k] = min(runs[fall[-1]], runs[rise[-1]])
            end -= k
            k = len(fall)
            out[end - k : end] = fall
            common[end - k + 1 : end] = fall_shared[1:]
            end -= k
    finally:
        scan.queue.close()
    return out, common


def doubled_order(names: np.ndarray) -> np.ndarray:
    """Suffixes of a short string in order, by sorting on prefixes of doubling length; the last name is the unique smallest one."""
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64)
    n, h = len(rank), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - h] = rank[h:] + 1 if h < n else 0
        pair = rank * (n + 2) + after
        order = np.argsort(pair, kind="stable")
        new = np.append(False, pair[order][1:] != pair[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == n - 1:
            return order
        h *= 2


def _common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray | int) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at a and b, up to limit."""
    room = np.minimum(len(text) - np.maximum(a, b), limit)
    same = np.zeros(len(a), np.int64)
    if text.dtype == np.uint16 and len(text) > 4:  # four symbols at a time
        four = text[:-3].astype(np.uint64)
        for i in (1, 2, 3):
            four |= text[i : len(text) - 3 + i].astype(np.uint64) << np.uint64(16 * i)
        live = np.flatnonzero(room >= 4)
        while len(live):
            live = live[four[a[live] + same[live]] == four[b[live] + same[live]]]
            same[live] += 4
            live = live[same[live] + 4 <= room[live]]
    live = np.flatnonzero(same < room)
    while len(live):
        live = live[text[a[live] + same[live]] == text[b[live] + same[live]]]
        same[live] += 1
        live = live[same[live] < room[live]]
    return same


def suffix_order(text: np.ndarray, limit: int, budget: int = 1 << 20, short: int = 1 << 21, work: Work | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes of an integer string whose last symbol is the unique smallest one, and the prefix each shares with the one before it, exact up to `limit` and
    at least that beyond. budget: queue entries in memory; short: length from which names are sorted by recursion; work: counts what was done."""
    work = Work() if work is None else work
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32), np.zeros(1, np.int32)
    up, runs = _rising(text)
    turning = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    if len(turning) < 2:
        seeds = turning
    else:
        by_symbol = turning[np.argsort(text[turning], kind="stable")]
        order, _ = _induced(text, up, runs, by_symbol, np.zeros(len(by_symbol), np.int64), budget, work)
        marks = np.zeros(n, bool)
        marks[turning] = True
        pieces = order[marks[order]].astype(np.int64)
        following = np.empty(n, np.int64)
        following[turning] = np.append(turning[1:], n - 1) + 1
        length = np.minimum(following[pieces], n) - pieces
        new = np.ones(len(pieces), bool)
        new[0] = False
        alike = np.flatnonzero(length[1:] == length[:-1])
        same = _common_prefix(text, pieces[alike], pieces[alike + 1], length[alike])
        new[1 + alike[same == length[alike]]] = False
        name = np.empty(n, np.int64)
        name[pieces] = np.cumsum(new)
        names = name[turning]
        kinds = int(new.sum()) + 1
        if kinds == len(turning):
            seeds = pieces
        elif len(names) > short and kinds <= LISTS:
            work.depth += 1
            seeds = turning[suffix_order(names, 1, budget, short, work)[0]]
        else:
            seeds = turning[doubled_order(names)]
    shared = np.zeros(len(seeds), np.int64)
    if len(seeds) > 1:
        shared[1:] = _common_prefix(text, seeds[:-1], seeds[1:], limit)
    return _induced(text, up, runs, seeds, shared, budget, work)
