"""Best-fit packing: bin completion with branch and bound over the counts of piece lengths.

Documents become token pieces; how many pieces have each length is all that packing
needs, and is at most ``length`` numbers whatever the input's size. The driver packs
those counts. Best-fit decreasing gives the incumbent. Where the bound leaves room
for a better one, bin completion enumerates undominated fillings around the longest
piece left, and branch and bound repacks the last sequences, pruned by the waste
that the incumbent allows. Every piece then finds its place from its number among
the pieces of its length.

Defined cases: a null text is an empty one, which gives one piece of the end token;
rows without a doc_id and rows alike are packed as rows of their own; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordbook.llm import words as W
from fjordbook.llm.common import running_sum, table
from fjordbook.llm.tokens import encoder, vocabulary_path
from fjordbook.session import durable

#: Tokens of a sequence, and the id that ends a document.
LENGTH, END = 2048, 0
#: Fillings looked at around one piece, steps of the final search, and sequences it may repack at once.
LOOKS, STEPS, TAIL = 400, 20_000, 40

Pattern = tuple[tuple[tuple[int, int], ...], int]


def cutter(path: str, length: int = LENGTH, ids: bool = False):
    """A function from batches of ``(doc_id, text)`` to batches of pieces, for tasks."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids

    def run(batches):
        encode = encoder(path).encode
        for batch in batches:
            data, offsets = W.buffer(batch.column(1))
            for low, high in W.slices(offsets, 32 << 20):
                found, ends = encode(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                n = np.diff(ends) + 1
                full = np.zeros(int(n.sum()), np.uint32) + np.uint32(END)
                at = np.concatenate([[0], np.cumsum(n)])
                inside = np.ones(len(full), bool)
                inside[at[1:] - 1] = False
                full[inside] = found
                count = -(-n // length)
                owner = np.repeat(np.arange(high - low), count)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                head = n - (count - 1) * length
                start = np.where(piece == 0, 0, head[owner] + (piece - 1) * length)
                size = np.where(piece == 0, head[owner], length)
                begin = at[owner] + start
                crc = [zlib.crc32(full[a:b]) for a, b in zip(begin.tolist(), (begin + size).tolist(), strict=True)]
                columns = [
                    batch.column(0).slice(low, high - low).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)),
                    pa.array(size.astype(np.int64)), pa.array(crc, pa.int64()),
                ]
                if ids:  # pieces are in order, so they are the buffer itself
                    columns.append(W.lengths(pa.array(full.astype(np.int32)), np.concatenate([[0], np.cumsum(size)])))
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pieces(docs: DataFrame, path: str, length: int = LENGTH, ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` per piece of every document, with its ``ids`` if asked.

    A document is its tokens and the end token. Longer ones are cut into pieces of
    ``length`` tokens; the first may be shorter.
    """
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(W.lean(cutter(path, length, ids)), kind)


class Lengths:
    """How many pieces of each length are left, with the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.order = sorted(self.left)

    def take(self, filling: tuple[tuple[int, int], ...], times: int) -> None:
        for n, k in filling:
            self.left[n] -= k * times
            if not self.left[n]:
                del self.left[n]
                self.order.remove(n)

    def give(self, filling: tuple[tuple[int, int], ...], times: int) -> None:
        for n, k in filling:
            if n not in self.left:
                self.order.insert(bisect_right(self.order, n), n)
            self.left[n] = self.left.get(n, 0) + k * times

    def most(self, filling: tuple[tuple[int, int], ...]) -> int:
        return min(self.left[n] // k for n, k in filling)


def dominated(filling: list[tuple[int, int]], waste: int, free: Lengths, used: dict[int, int]) -> bool:
    """Whether a longer piece that is left could stand in for one or two pieces of the filling."""
    if not waste:
        return False
    sizes = [n for n, _ in filling]
    sums = sizes + [a + b for i, a in enumerate(sizes) for b in sizes[i + 1:]] + [2 * n for n, k in filling if k > 1]
    for i, s in enumerate(sums):
        at = bisect_right(free.order, s + waste) - 1
        while at >= 0 and free.order[at] >= (s + 1 if i < len(sizes) else s):
            n = free.order[at]
            if free.left[n] > used.get(n, 0):
                return True
            at -= 1
    return False


def fillings(free: Lengths, length: int, looks: int = LOOKS, want: int = 3) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Undominated fillings of a sequence around the longest piece left, least waste and longest pieces first."""
    longest = free.order[-1]
    found: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    used = {longest: 1}
    state = {"looks": looks, "least": length}

    def search(space: int, top: int, chosen: list[tuple[int, int]]) -> None:
        at = bisect_right(free.order, min(space, top)) - 1
        fits = False
        while at >= 0 and state["looks"] > 0:
            n = free.order[at]
            at -= 1
            spare = free.left[n] - used.get(n, 0)
            if spare <= 0:
                continue
            fits = True
            many = min(spare, space // n)
            for k in {many, 1} if many > 1 and n * many != space else {many}:
                used[n] = used.get(n, 0) + k
                chosen.append((n, k))
                search(space - n * k, n - 1, chosen)
                chosen.pop()
                used[n] -= k
                if len(found) >= want and found[0][0] == 0:
                    return
        if not fits and state["looks"] > 0:
            state["looks"] -= 1
            if space <= state["least"] or len(found) < want:
                if not dominated(chosen, space, free, used):
                    state["least"] = min(state["least"], space)
                    merged: dict[int, int] = {longest: 1}
                    for n, k in chosen:
                        merged[n] = merged.get(n, 0) + k
                    found.append((space, tuple(sorted(merged.items(), reverse=True))))
                    found.sort(key=lambda f: (f[0], [-n for n, _ in f[1]]))
                    del found[want:]

    search(length - longest, longest, [])
    return found or [(length - longest, ((longest, 1),))]


def best_fit(counts: dict[int, int], length: int) -> list[Pattern]:
    """Best-fit decreasing on counts: the incumbent.

    Equal sequences are kept together as one filling and a number. A piece goes to
    the sequence with the least space that takes it, and its like follow into the
    same sequence while they fit, so a length either uses up a group of sequences
    or splits off a part of one. The groups stay few for any number of pieces. The
    fullest come first, so that the tail is what wastes most.
    """
    groups: dict[int, list[Pattern]] = {}
    spaces: list[int] = []

    def put(space: int, filling: tuple[tuple[int, int], ...], times: int) -> None:
        if times:
            if space not in groups:
                groups[space] = []
                spaces.insert(bisect_right(spaces, space), space)
            groups[space].append((filling, times))

    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            at = bisect_right(spaces, n - 1)
            if at == len(spaces):
                space, filling, times = length, (), left  # new sequences, as many as may be needed
            else:
                space = spaces[at]
                filling, times = groups[space].pop()
                if not groups[space]:
                    del groups[space], spaces[at]
            many = space // n
            whole = min(times, left // many)
            put(space - many * n, (*filling, (n, many)), whole)
            left -= whole * many
            if left and whole < times:  # fewer than fill one more
                put(space - left * n, (*filling, (n, left)), 1)
                left, whole = 0, whole + 1
            if filling:
                put(space, filling, times - whole)
    return [pattern for space in spaces for pattern in groups[space]]


def complete(counts: dict[int, int], length: int) -> list[Pattern]:
    """The first packing: the best filling around the longest piece, as often as it goes."""
    free, out = Lengths(counts), []
    while free.order:
        waste, filling = fillings(free, length)[0]
        times = free.most(filling)
        if waste and times > 1:  # a wasteful filling is repeated only while nothing else changes
            times = max(1, times // 2)
        free.take(filling, times)
        out.append((filling, times))
    return out


def improve(tail: list[Pattern], length: int, steps: int = STEPS) -> list[Pattern]:
    """Search for a packing of the tail in fewer sequences; the tail itself is the incumbent."""
    counts: dict[int, int] = {}
    for filling, times in tail:
        for n, k in filling:
            counts[n] = counts.get(n, 0) + k * times
    total = sum(n * c for n, c in counts.items())
    best, best_bins = tail, sum(t for _, t in tail)
    least = -(-total // length)
    free, path, budget = Lengths(counts), [], [steps]

    def search(wasted: int) -> bool:
        nonlocal best, best_bins
        if not free.order:
            best, best_bins = list(path), len(path)
            return best_bins <= least
        for waste, filling in fillings(free, length, 60, 4):
            budget[0] -= 1
            if budget[0] <= 0:
                return True
            # with this much waste at least so many sequences are needed
            if -(-(total + wasted + waste) // length) >= best_bins:
                continue
            free.take(filling, 1)
            path.append((filling, 1))
            if search(wasted + waste):
                return True
            path.pop()
            free.give(filling, 1)
        return False

    if best_bins > least:
        search(0)
    return best


def pack_counts(counts: dict[int, int], length: int = LENGTH) -> list[Pattern]:
    """Fillings and how often each is used, so that every counted piece is used once.

    Full pieces are sequences by themselves. The tail that is searched again grows
    from the last sequences on, as long as the bound says one may be saved.
    """
    counts = {int(n): int(c) for n, c in counts.items() if c > 0}
    part = {n: c for n, c in counts.items() if n < length}
    least = -(-sum(n * c for n, c in part.items()) // length)
    patterns = best_fit(part, length)
    bins = lambda found: sum(t for _, t in found)
    if bins(patterns) > least:
        patterns = min(patterns, complete(part, length), key=bins)
    size = 5
    while patterns and bins(patterns) > least and size <= TAIL:
        head, tail, room = list(patterns), [], size
        while head and room:
            filling, times = head.pop()
            now = min(times, room)
            tail.insert(0, (filling, now))
            room -= now
            if times > now:
                head.append((filling, times - now))
        patterns = head + improve(tail, length)
        size *= 2
    if counts.get(length):
        patterns.append((((length, 1),), counts[length]))
    return patterns


def places(patterns: list[Pattern]) -> tuple[np.ndarray, ...]:
    """Per filling and length: ``(length, first number, first sequence, offset, pieces per sequence)``, in order."""
    rows, seen, sequence = [], {}, 0
    for filling, times in patterns:
        offset = 0
        for n, k in filling:
            rows.append((n, seen.get(n, 0), sequence, offset, k))
            seen[n] = seen.get(n, 0) + k * times
            offset += n * k
        sequence += times
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else tuple(np.empty(0, np.int64) for _ in range(5))


def pack(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """``cut`` with ``sequence_id`` and ``offset`` of every piece. ``cut`` is a stored table of ``pieces``."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``length`` rows
    size, number, sequence, offset, per = places(pack_counts(counts, length))
    keys = size * (1 << 44) + number
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    numbered = running_sum(cut, ["length"], order, [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], F.lit(1), "_number")

    def run(batches):
        for batch in batches:
            n, i = (batch.column(c).to_numpy() for c in ("length", "_number"))
            at = np.searchsorted(keys, n * (1 << 44) + i, "right") - 1
            past = i - number[at]
            kept = [c for c in batch.schema.names if c != "_number"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequence[at] + past // per[at]), pa.array(offset[at] + past % per[at] * n)],
                [*kept, "sequence_id", "offset"])

    schema = type(cut.schema)([*cut.schema.fields]).add("sequence_id", "long").add("offset", "long")
    return numbered.select(*cut.columns, "_number").mapInArrow(W.lean(run), schema)


def sequences(packed: DataFrame, fill: int = 0, length: int = LENGTH) -> DataFrame:
    """``(sequence_id, ids)``: whole sequences of ``length`` ids, from packed pieces with their ``ids``."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(F.flatten(ordered["ids"]).alias("ids"))
    padding = F.array_repeat(F.lit(fill), length - F.size("ids"))
    return joined.select("sequence_id", F.concat("ids", padding).alias("ids"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = durable(pieces(table(spark, sf_dir, "documents"), vocabulary_path()))
    return pack(cut)
