"""Suffix order of many short texts by external induced sorting, with the length of the prefix that neighbours share.

A text is a row of whole numbers in which zeros end its parts; a suffix ends with its
part, and nothing is shared across an end. As in induced sorting, a suffix is of type
S if it comes before the one that follows it in the text, else of type L:

1. S suffixes after an L suffix are the seeds. The pieces between them are sorted and
   named, and the order of the seeds is that of the suffixes of the text of names,
   found by recursion, or by doubling once that text fits in memory.
2. In rising order of the suffixes, each one brings up the L suffix before it in the
   text; in falling order, each brings up the S suffix before it. Suffixes that wait
   are tuples in a priority queue, a first-in first-out queue for each first symbol:
   they are brought up in order, so within a symbol the queue is already sorted.
3. The prefix that two suffixes share is one symbol more than what the suffixes that
   brought them up share, the least value between these in the order. It travels in
   the tuples, cut off at ``cap``; only seeds are compared symbol by symbol.

Queues keep at most ``memory`` tuples, more are written to a file without a name in
the task's own temporary folder, which ends with the task, as Spark's own spills do.
All work is on whole arrays: a step takes all tuples that wait at a symbol.
"""

from __future__ import annotations

import heapq
import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

#: Tuples held by the queues of one order, and names ordered by doubling instead of recursion.
MEMORY, NAMES = 32 << 20, 16 << 20


def changes(*keys: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it in any key; the first row counts."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


class Queue:
    """Suffix tuples by first symbol, popped from the least symbol on (or the greatest)."""

    def __init__(self, memory: int, falling: bool, kind: np.dtype):
        self.memory, self.sign, self.kind = memory, -1 if falling else 1, kind
        self.chunks: dict[int, deque] = {}
        self.heap: list[int] = []
        self.held, self.file, self.end, self.spilled = 0, None, 0, 0

    def push(self, symbols: np.ndarray, places: np.ndarray, common: np.ndarray) -> None:
        """Append tuples, which are grouped by symbol."""
        if not len(symbols):
            return
        starts = changes(symbols)
        for symbol, low, high in zip(symbols[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(symbols)], strict=True):
            if symbol not in self.chunks:
                self.chunks[symbol] = deque()
                heapq.heappush(self.heap, self.sign * symbol)
            self.chunks[symbol].append((places[low:high], common[low:high]))
        self.held += len(symbols)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        """Write all that waits behind the first symbol; chunks become ``(offset, length)``."""
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # noqa: SIM115  lives as long as the queue
        first = self.sign * self.heap[0]
        for symbol, chunks in self.chunks.items():
            if symbol == first:
                continue
            mine = [c for c in chunks if isinstance(c[0], np.ndarray)]
            if not mine:
                continue
            places, common = (np.concatenate([c[i] for c in mine]) for i in (0, 1))
            kept = [c for c in chunks if not isinstance(c[0], np.ndarray)]
            self.file.seek(self.end)
            self.file.write(places.astype(self.kind).tobytes() + common.astype(np.int16).tobytes())
            self.chunks[symbol] = deque([*kept, (self.end, len(places))])  # older chunks were written before: the order holds
            self.end += len(places) * (self.kind.itemsize + 2)
            self.spilled += len(places)
            self.held -= len(places)

    def first(self) -> int | None:
        """The symbol that is popped next."""
        return self.sign * self.heap[0] if self.heap else None

    def pop(self) -> tuple[np.ndarray, np.ndarray]:
        """All tuples in memory that wait at the first symbol, or the next of its written chunks."""
        symbol = self.sign * self.heap[0]
        chunks = self.chunks[symbol]
        if isinstance(chunks[0][0], np.ndarray):
            taken = []
            while chunks and isinstance(chunks[0][0], np.ndarray):
                taken.append(chunks.popleft())
            places, common = (np.concatenate([c[i] for c in taken]) for i in (0, 1))
            self.held -= len(places)
        else:
            offset, n = chunks.popleft()
            self.file.seek(offset)
            places = np.frombuffer(self.file.read(n * self.kind.itemsize), self.kind)
            common = np.frombuffer(self.file.read(2 * n), np.int16)
        if not chunks:
            del self.chunks[symbol]
            heapq.heappop(self.heap)
        return places, common

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least value of each range, both ends included, by tables of doubling widths."""
    width = (high - low + 1).astype(np.int64)
    level = np.frexp(width.astype(np.float64))[1] - 1
    out = np.empty(len(low), values.dtype)
    table, step = values, 1
    for lv in range(int(level.max()) + 1 if len(level) else 0):
        at = np.flatnonzero(level == lv)
        if len(at):
            out[at] = np.minimum(table[low[at]], table[high[at] - step + 1])
        if len(table) > step:
            table = np.minimum(table[:-step], table[step:])
        step *= 2
    return out


class Text:
    """A text with its types, seeds and distances to the ends of its parts."""

    def __init__(self, symbols: np.ndarray):
        self.symbols = symbols
        n = len(symbols)
        differs = np.flatnonzero(symbols[:-1] != symbols[1:])
        rises = np.ones(n, bool)
        if len(differs):
            rises[:differs[-1] + 1] = np.repeat(symbols[differs] < symbols[differs + 1], np.diff(differs, prepend=-1))
        ends = symbols == 0
        self.small = rises | ends
        seed = self.small.copy()
        seed[0] = ends[0]
        seed[1:] &= ~self.small[:-1]
        self.seeds = np.flatnonzero(seed | ends)
        self.left = to_end(ends)


def to_end(ends: np.ndarray) -> np.ndarray:
    """Symbols from each place to the end of its part."""
    at = np.flatnonzero(ends)
    kind = np.int32 if len(ends) < 1 << 31 else np.int64
    return np.repeat(at.astype(kind), np.diff(at, prepend=-1)) - np.arange(len(ends), dtype=kind)


def refined(rank: np.ndarray, active: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Ties of ``rank`` among the active rows broken by ``key``; the rows that still tie, in order.

    A rank is the place of the first row of its group in sorted order.
    """
    top = int(key.max()).bit_length()
    if top + int(rank.max()).bit_length() < 63:
        order = np.argsort((rank[active].astype(np.int64) << top) | key)
    else:
        order = np.lexsort([key, rank[active]])
    active, key = active[order], key[order]
    old = rank[active]
    whole, part = changes(old), changes(old, key)
    base = np.repeat(whole, np.diff(np.append(whole, len(active))))
    size = np.diff(np.append(part, len(active)))
    rank[active] = old + np.repeat(part, size) - base
    return active[np.repeat(size > 1, size)]


def shared(text: Text, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Symbols that the suffixes at ``a`` and ``b`` share, up to ``cap``."""
    padded = np.concatenate([text.symbols.astype(np.uint16), np.zeros(cap + 8, np.uint16)])
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view(np.uint64), (len(padded) - 4,), (2,))
    out = np.zeros(len(a), np.int64)
    alive = np.arange(len(a))
    for at in range(0, cap, 4):
        differ = words[a[alive] + at] ^ words[b[alive] + at]
        same = differ == 0
        out[alive] += np.where(same, 4, np.bitwise_count((differ & -differ) - np.uint64(1)) >> 4)
        alive = alive[same]
        if not len(alive):
            break
    return np.minimum(np.minimum(out, cap), np.minimum(text.left[a], text.left[b])).astype(np.int16)


def names(text: Text) -> np.ndarray:
    """For each seed, a number that orders the pieces of text up to the next seed; equal pieces get one number.

    A piece is compared by symbols and types, so that no piece is the beginning of
    another. Numbers are the places of the pieces in sorted order.
    """
    seeds, n = text.seeds, len(text.seeds)
    typed = text.symbols.astype(np.int32 if text.symbols.dtype == np.uint16 else np.int64) * 2 + text.small
    length = np.append(np.diff(seeds) + 1, 1)
    length[text.symbols[seeds] == 0] = 1
    bits = int(typed.max()).bit_length()
    per = max(1, 63 // bits)
    typed = np.concatenate([typed, np.zeros(per, typed.dtype)])
    rank = np.zeros(n, np.int64)
    active, depth = np.arange(n), 0
    while len(active):
        key = np.zeros(len(active), np.int64)
        start, limit = seeds[active], length[active]
        for j in range(depth, depth + per):
            key <<= bits
            inside = j < limit
            key[inside] |= typed[start[inside] + j]
        active = refined(rank, active, key)
        depth += per
        active = active[length[active] > depth]
    return rank


def doubled(rank: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a text of names that fits in memory; zeros end its parts.

    Names that are places in sorted order are refined by the names twice as far on, only where they tie.
    """
    rank = rank.copy()
    left = to_end(rank == 0)
    active = np.flatnonzero(left >= 1)
    active = active[np.bincount(rank[active])[rank[active]] > 1] if len(active) else active
    step = 1
    while True:
        active = active[left[active] >= step]
        if not len(active):
            break
        active = refined(rank, active, rank[active + step])
        step *= 2
    return np.argsort(rank, kind="stable")


def seed_order(text: Text, memory: int, in_memory: int) -> np.ndarray:
    """The seeds' places in the order of their suffixes."""
    rank = names(text)
    ends = text.symbols[text.seeds] == 0
    rank[ends] = 0
    _, dense = np.unique(rank, return_inverse=True)
    if int(dense.max()) + int(ends.sum()) == len(rank):
        order = np.argsort(rank, kind="stable")
    elif len(rank) <= in_memory:
        order = doubled(rank)
    else:
        order = np.concatenate([places for places, _ in ordered(dense, None, memory, in_memory)])[::-1]
        order = np.concatenate([np.flatnonzero(ends), order])
    return text.seeds[order]


def induced(text: Text, wanted: np.ndarray, fixed: dict[int, tuple[np.ndarray, np.ndarray]], falling: bool, cap: int | None, memory: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(symbol, places, common)`` of the suffixes that are brought up, in order, by those in ``fixed`` and each other.

    ``fixed`` holds suffixes by first symbol, which come after those brought up at the symbol.
    """
    symbols = text.symbols
    queue = Queue(memory, falling, np.dtype(np.int32 if len(symbols) < 1 << 31 else np.int64))
    since = np.full(int(symbols.max()) + 1, -1, np.int16) if cap else None  # least value since the last push at a symbol

    def bring_up(places: np.ndarray, common: np.ndarray) -> None:
        before = places - 1
        symbol = symbols[before]
        at = np.flatnonzero((symbol != 0) & wanted[before] & (places > 0))
        symbol, before = symbol[at], before[at]
        order = np.argsort(symbol, kind="stable")
        symbol, before, at = symbol[order], before[order], at[order]
        if cap is None:
            queue.push(symbol, before, np.zeros(len(before), np.int16))
            return
        least = common.min() if len(common) else np.int16(cap)
        if len(at):
            starts = changes(symbol)
            low = np.empty(len(at), np.int64)
            low[1:] = at[:-1] + 1
            low[starts] = 0
            value = least_between(common, low, at)
            value[starts] = np.minimum(value[starts], since[symbol[starts]])
            queue.push(symbol, before, np.minimum(value + 1, cap).astype(np.int16))
            last = np.append(starts[1:], len(at)) - 1
            behind = at[last] + 1
            inside = behind < len(common)
            after = np.full(len(last), cap, np.int16)
            after[inside] = least_between(common, behind[inside], np.full(int(inside.sum()), len(common) - 1))
            np.minimum(since, least, out=since)
            since[symbol[starts]] = after
        else:
            np.minimum(since, least, out=since)

    waiting = sorted(fixed, reverse=not falling)
    while True:
        symbol = queue.first()
        if waiting and (symbol is None or (waiting[-1] > symbol if falling else waiting[-1] < symbol)):
            symbol = waiting[-1]
        if symbol is None:
            break
        last = None
        while queue.first() == symbol:
            places, common = queue.pop()
            bring_up(places, common)
            yield symbol, places, common
            last = places[-1:]
        if waiting and waiting[-1] == symbol:
            waiting.pop()
            places, common = fixed[symbol]
            if cap:
                common = common.copy()
                common[0] = 0 if last is None else shared_one(text, int(last[0]), int(places[0]), cap)
            bring_up(places, common)
    queue.close()


def shared_one(text: Text, a: int, b: int, cap: int) -> int:
    """Symbols that two suffixes share, up to ``cap``."""
    x, y = text.symbols[a:a + cap], text.symbols[b:b + cap]
    n = min(len(x), len(y))
    stop = np.flatnonzero((x[:n] != y[:n]) | (x[:n] == 0))
    return int(stop[0]) if len(stop) else n


def by_symbol(symbols: np.ndarray, places: np.ndarray, common: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ordered suffixes cut where the first symbol changes."""
    first = symbols[places]
    starts = changes(first)
    return {s: (places[a:b], common[a:b]) for s, a, b in zip(first[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(places)], strict=True)}


def ordered(symbols: np.ndarray, cap: int | None = None, memory: int = MEMORY, in_memory: int = NAMES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(places, common)`` of all suffixes but the empty ones, from the last in order to the first.

    ``common`` is what a suffix shares with the one after it in order, the one given
    before it here, up to ``cap``; without a ``cap`` it has no meaning.
    """
    if not len(symbols):
        return
    text = Text(symbols)
    seeds = seed_order(text, memory, in_memory)
    common = np.zeros(len(seeds), np.int16)
    if cap:
        common[1:] = shared(text, seeds[:-1], seeds[1:], cap)
    large: dict[int, list] = {}
    for symbol, places, shares in induced(text, ~text.small, by_symbol(symbols, seeds, common), False, cap, memory):
        large.setdefault(symbol, []).append((places, shares))
    fixed = {}
    for symbol in list(large):
        places, shares = (np.concatenate([c[i] for c in large[symbol]]) for i in (0, 1))
        large[symbol] = None
        falling = np.zeros(len(places), np.int16)
        falling[1:] = shares[:0:-1]
        fixed[symbol] = places[::-1], falling
    # what is brought up at a symbol comes before the fixed suffixes of it here, so these are given as their symbol ends
    previous, last = None, None
    given = sorted(fixed)
    for symbol, places, shares in induced(text, text.small & (symbols != 0), fixed, True, cap, memory):
        if symbol != previous:
            yield from _fixed_above(text, fixed, given, symbol, previous, last, cap)
            previous = symbol
        yield places, shares
        last = int(places[-1])
    yield from _fixed_above(text, fixed, given, 0, previous, last, cap)


def _fixed_above(text: Text, fixed: dict, given: list[int], symbol: int, previous: int | None, last: int | None, cap: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The fixed suffixes of the symbols above ``symbol``, highest first; at ``previous`` they follow the suffix ``last``."""
    while given and given[-1] > symbol:
        at = given.pop()
        places, shares = fixed[at]
        if cap and at == previous:
            shares = shares.copy()
            shares[0] = shared_one(text, last, int(places[0]), cap)
        yield places, shares
