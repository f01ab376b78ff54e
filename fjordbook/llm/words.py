"""Words of whole texts as arrays: spans, word hashes, shingle hashes, one buffer per batch.

A word is a run of bytes that are not ASCII white space (space, tab to carriage
return); texts are UTF-8. All functions take one buffer that holds many texts and
the texts' offsets in it, so their cost is per byte and not per text or word.
"""

from __future__ import annotations

import ctypes
import time

import numpy as np
import pyarrow as pa

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Odd multipliers of the word and shingle polynomials.
BYTE_STEP, WORD_STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Bytes hashed at once; bounds the scratch arrays whatever a text's length.
SEGMENT = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:  # doubling: out[done:2*done] = out[:done] * base**done
        step = np.uint64(pow(base, done, 1 << 64))
        more = min(done, n - done)
        out[done:done + more] = out[:more] * step
        done += more
    return out


_TABLES: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    if not _TABLES:
        _TABLES["byte"] = mix(np.arange(1, 257, dtype=np.uint64))
        _TABLES["up"] = _powers(int(BYTE_STEP), SEGMENT + 1)
        _TABLES["down"] = _powers(pow(int(BYTE_STEP), -1, 1 << 64), SEGMENT + 1)
    return _TABLES


def buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of texts in memory."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def slices(offsets: np.ndarray, size: int = 4 << 20):
    """Row ranges of at most ``size`` bytes, or of one row that is longer."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end
        row = end


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, first)``: the words' byte spans, and each text's first word number, plus the total."""
    black = ~WHITE[data]
    starts, ends = black.copy(), black.copy()
    starts[1:] &= ~black[:-1]
    ends[:-1] &= ~black[1:]
    borders = offsets[(offsets > 0) & (offsets < len(data))]
    starts[borders] = black[borders]
    ends[borders - 1] = black[borders - 1]
    begins = np.flatnonzero(starts)
    return begins, np.flatnonzero(ends) + 1, np.searchsorted(begins, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, equal for equal bytes wherever they stand."""
    t = _tables()
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        low = starts[i]
        j = int(np.searchsorted(starts, low + SEGMENT, "left"))
        while j > i + 1 and ends[j - 1] - low > SEGMENT:
            j -= 1
        high = ends[j - 1]
        up, down = t["up"], t["down"]
        if high - low > SEGMENT:  # one word longer than a segment
            up = _powers(int(BYTE_STEP), int(high - low))
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(t["byte"][data[low:high]] * up[:high - low], out=sums[1:])
        at = starts[i:j] - low
        out[i:j] = mix((sums[ends[i:j] - low] - sums[at]) * down[at] + (ends[i:j] - starts[i:j]).astype(np.uint64))
        i = j
    return out


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive words of the array, borders between texts ignored."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = words[:n].copy()
    for j in range(1, k):
        acc *= WORD_STEP
        acc += words[j:n + j]
    return mix(acc)


def release() -> None:
    """Give memory that is free again back to the machine: a worker outlives its tasks, and its peak would stay with it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library keeps its own house
        pass


def lean(run):
    """A function over batches that gives memory back now and then, and at its end."""
    def wrapped(batches):
        last = time.monotonic()
        for out in run(batches):
            yield out
            if time.monotonic() - last > 0.5:
                release()
                last = time.monotonic()
        release()

    return wrapped


def lengths(values, offsets) -> pa.Array:
    """A list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
