"""Token ids of whole texts by a public byte-level BPE tokenizer, each distinct piece of text encoded once.

The tokenizer never joins text across a step from a non-space to a white-space
character, so a text may be cut there and the parts encoded alone. Parts repeat:
each task keeps the ids of those it has met, up to a bound, and copies them in.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from fjordbook.llm import words as W

#: Where the public tokenizers' files are; a parameter of every function that encodes.
VOCABULARY = "byte_bpe_50k.json"
#: Parts kept per task before starting afresh, and the longest part kept.
KEPT, LONGEST = 2_000_000, 64
#: A letter and a full stop or comma after it are never one token either.
LETTER, STOP = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
STOP[[33, 44, 46, 58, 59, 63]] = True
#: Bytes of text encoded at once, and parts given to the tokenizer at once.
AT_ONCE, ENCODED = 4 << 20, 4096


def vocabulary_path(name: str = VOCABULARY) -> str:
    """The file of a public tokenizer that is installed beside this package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where parts begin: at texts' starts, and at white space after a character that is surely none.

    Only ASCII white space starts a part. A character before it counts as no space
    if it is visible ASCII or its first byte belongs to no Unicode space. A part
    also begins at a stop after an ASCII letter, where letters end for certain.
    """
    white = W.WHITE[data]
    begin = white.copy()
    begin[0] = False
    begin[1:] &= ~white[:-1]
    tail = (data & 0xC0) == 0x80
    ascii_visible = (data > 0x20) & (data < 0x7F)
    two = (data >= 0xC3) & (data <= 0xDF)
    three = (data == 0xE0) | ((data >= 0xE4) & (data <= 0xEF))
    four = data >= 0xF0
    sure = ascii_visible
    sure[1:] |= tail[1:] & two[:-1]
    sure[2:] |= tail[2:] & tail[1:-1] & three[:-2]
    sure[3:] |= tail[3:] & tail[2:-1] & tail[1:-2] & four[:-3]
    begin[1:] &= sure[:-1]
    begin[1:] |= LETTER[data[:-1]] & STOP[data[1:]]
    begin[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(begin)


class Encoder:
    """Encodes buffers of texts; one per task."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self._forget()

    def _forget(self) -> None:
        self.keys, self.starts, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool = np.empty(0, np.uint32)

    def _encode(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each part, end to end, and their numbers."""
        ids, counts = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for i in range(0, len(parts), ENCODED):
            found = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in parts[i:i + ENCODED]], add_special_tokens=False)]
            counts.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32, int(counts[-1].sum())))
        return np.concatenate(ids), np.concatenate(counts)

    def _learn(self, keys: np.ndarray, parts: list[bytes]) -> None:
        ids, counts = self._encode(parts)
        if len(self.keys) + len(keys) > KEPT:
            self._forget()
        starts = len(self.pool) + np.cumsum(counts) - counts
        self.pool = np.concatenate([self.pool, ids])
        at = np.searchsorted(self.keys, keys)  # both in order
        self.keys, self.starts, self.counts = np.insert(self.keys, at, keys), np.insert(self.starts, at, starts), np.insert(self.counts, at, counts)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, ends)``: ids of all texts end to end, and the offsets of each text's ids."""
        out, ends = [], [np.zeros(1, np.int64)]
        done = 0
        for low, high in W.slices(offsets, AT_ONCE):
            ids, at = self._slice(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
            out.append(ids)
            ends.append(at[1:] + done)
            done += len(ids)
        return np.concatenate(out) if out else np.empty(0, np.uint32), np.concatenate(ends)

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        begins = _cuts(data, offsets)
        stops = np.append(begins[1:], len(data))
        text = data.tobytes()
        long = np.flatnonzero(stops - begins > LONGEST)
        short = np.flatnonzero(stops - begins <= LONGEST)
        keys = W.hashes(data, begins[short], stops[short])
        known, first, which = np.unique(keys, return_index=True, return_inverse=True)
        for again in (False, True):  # learning may have dropped what was known before
            at = np.minimum(np.searchsorted(self.keys, known), max(len(self.keys) - 1, 0))
            new = self.keys[at] != known if len(self.keys) else np.ones(len(known), bool)
            if not new.any():
                break
            if again or len(self.keys) + new.sum() > KEPT:
                self._forget()
                new[:] = True
            spot = short[first[new]]
            self._learn(known[new], [text[a:b] for a, b in zip(begins[spot].tolist(), stops[spot].tolist(), strict=True)])
        at = np.searchsorted(self.keys, known)
        counts, starts = np.zeros(len(begins), np.int64), np.zeros(len(begins), np.int64)
        counts[short], starts[short] = self.counts[at][which], self.starts[at][which]
        pool = self.pool
        if len(long):
            ids, n = self._encode([text[a:b] for a, b in zip(begins[long].tolist(), stops[long].tolist(), strict=True)])
            counts[long], starts[long] = n, len(pool) + np.cumsum(n) - n
            pool = np.concatenate([pool, ids])
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = pool[np.repeat(starts - total[:-1], counts) + np.arange(total[-1])]
        return ids, total[np.searchsorted(begins, offsets)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, loaded once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
