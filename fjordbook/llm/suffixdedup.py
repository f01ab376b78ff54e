"""Suffix-array dedup: bytes in strings that an earlier document has, by external induced sorting of shards.

Every string of ``k`` bytes (a window) is dealt by its least-hashed group of
bytes in it, so equal windows meet in one shard and neighbours mostly go together:
the windows in a row with one least hash are a passage.

1. Least hashes are dealt; those of one document only are dropped. What is left are
   the passages that may be repeated.
2. These are dealt as text, equal ones of a batch once with all their places. A shard
   joins its different passages, but for those that are alone with their hash, to one
   text and brings its suffixes into order by induced sorting (``induced``), with the prefix that neighbours share. Suffixes in a
   row that share ``k`` bytes are one window; its least document is its source, and all
   other documents lose it. Hashes decide nothing here: bytes are compared.
3. A document's windows are joined to its text, and what they cover is removed.

Documents are joined by doc_id and a checksum of the text. Rows sent by a batch of
text are at most one for every shard, however many documents share a passage.

Defined cases: a null text has no bytes; texts of fewer than ``k`` bytes lose nothing;
documents of one doc_id never count as sources of each other, and rows alike give rows
alike; documents without a doc_id come after all others and not before each other;
removed bytes may leave broken characters, so what is kept is bytes; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordbook.llm import words as W
from fjordbook.llm.common import table
from fjordbook.llm.induced import MEMORY, NAMES, changes, ordered, to_end
from fjordbook.session import durable, shuffles_freed

#: Bytes of a window, of the groups whose hashes find what may be repeated, and of those whose hashes deal it to shards:
#: long groups are seldom the same by chance, short ones keep more windows together.
WINDOW, GROUP, DEALT = 50, 24, 12
#: Bytes of text per shard and the fewest shards; bytes of text that a task looks at together, and that it hashes at once.
PART_BYTES, LEAST_PARTS, CHUNK, SLICE = 24 << 20, 64, 12 << 20, 1 << 19
#: Windows of a passage at most; a longer row of one least hash is several passages.
LONGEST = 256
KEYS = "doc long, text_key long"


def keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, doc, text_key, text)``; the last bit of ``text_key`` is set where there is no doc_id."""
    missing = F.col("doc_id").isNull()
    key = F.xxhash64("text").bitwiseAND(F.lit(-2)).bitwiseOR(missing.cast("long"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"), key.alias("text_key"), "text")


def codes(doc: np.ndarray, text_key: np.ndarray) -> np.ndarray:
    """Small numbers in the order of doc_id; rows without one have the highest."""
    known, where = np.unique(doc, return_inverse=True)
    return np.where(text_key & 1, len(known), where).astype(np.int64)


def group_hashes(data: np.ndarray, m: int) -> np.ndarray:
    """A hash of every ``m`` bytes in a row, by doubling their number."""
    step, width = int(W.BYTE_STEP), 1
    whole = W.mix(np.arange(1, 257, dtype=np.uint64))[data]
    out, done = None, 0
    while True:
        if m & width:  # the bits of m, from the right: what is done comes behind
            out = whole.copy() if out is None else whole[:len(out) - width] * np.uint64(pow(step, done, 1 << 64)) + out[width:]
            done += width
        if width * 2 > m:
            return W.mix(out)
        if len(whole) <= width:
            return np.empty(0, np.uint64)
        whole = whole[:-width] * np.uint64(pow(step, width, 1 << 64)) + whole[width:]
        width *= 2


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    step = 1
    while step < width and len(values):
        move = min(step, width - step)
        values = np.minimum(values[:-move], values[move:])
        step += move
    return values


def least_hashes(data: np.ndarray, k: int, m: int) -> np.ndarray:
    """The least hash of the groups in the window that begins at each byte."""
    return least_of(group_hashes(data, m), k - m + 1)


def inside_texts(offsets: np.ndarray, k: int) -> np.ndarray:
    """Whether the window that begins at each byte stays in its text, for all windows of the data."""
    n = max(0, int(offsets[-1]) - k + 1)
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, np.minimum(np.maximum(offsets[1:] - k + 1, offsets[:-1]), n), 1)
    np.add.at(change, np.minimum(offsets[1:], n), -1)
    return np.cumsum(change[:-1]) == 0


def passages(offsets: np.ndarray, least: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(text, start, windows, hash)`` of the ``kept`` windows in a row that have one least hash, in order.

    Starts count from the text's own beginning.
    """
    new = kept.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~kept[:-1]
    begins = offsets[:-1][(np.diff(offsets) > 0) & (offsets[:-1] < len(kept))]
    new[begins] = kept[begins]
    first = np.flatnonzero(new)
    # a row ends where the next one begins, or where windows are not kept
    stop = np.flatnonzero(np.diff(kept.astype(np.int8), append=0) == -1) + 1
    end = np.minimum(np.append(first[1:], len(kept)), stop[np.searchsorted(stop, first, "right")] if len(first) else first)
    length = end - first
    pieces = -(-length // LONGEST)
    number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.repeat(first, pieces) + number * LONGEST
    length = np.minimum(np.repeat(length, pieces) - number * LONGEST, LONGEST)
    text = np.searchsorted(offsets, first, "right") - 1
    return text, first - offsets[text], length, W.mix(least[first].astype(np.uint64) + np.uint64(1))  # least hashes are small, so mixed again


def chunks(batches):
    """``(bytes, offsets, rows)`` of each part of the batches that holds ``CHUNK`` bytes of text."""
    for batch in batches:
        data, offsets = W.buffer(batch.column("text"))
        for low, high in W.slices(offsets, CHUNK):
            yield data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], batch.slice(low, high - low)


def keys_of(rows) -> tuple[np.ndarray, np.ndarray]:
    return rows.column("doc").to_numpy(), rows.column("text_key").to_numpy()


def first_of_each(doc: np.ndarray, text_key: np.ndarray) -> np.ndarray:
    """True for the first row of each key; rows alike are looked at once."""
    order = np.lexsort([text_key, doc])
    out = np.zeros(len(doc), bool)
    if len(doc):
        starts = changes(doc[order], text_key[order])
        out[np.minimum.reduceat(order, starts)] = True
    return out


def lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def flat(rows, *names: str) -> list[np.ndarray]:
    """List columns of one group as flat arrays."""
    return [rows.column(c).combine_chunks().flatten().to_numpy() for c in names]


def shared_passages(docs: DataFrame, parts: int, k: int, m: int) -> DataFrame:
    """``(doc, text_key, places)``: starts of the passages whose least hash more than one document has."""
    bits = np.uint64(int(log2(parts)))

    def deal(batches):
        for data, offsets, rows in chunks(batches):
            doc, key = keys_of(rows)
            fresh = first_of_each(doc, key)
            found = []
            for low, high in W.slices(offsets, SLICE):
                part, at = data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
                text, start, _, h = passages(at, least_hashes(part, k, m), inside_texts(at, k))
                kept = fresh[low + text]
                found.append((low + text[kept], start[kept], h[kept]))
            text, start, h = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(h):
                continue
            order = np.argsort(h)
            text, start, h = text[order], start[order], h[order]
            code = codes(doc, key)[text]
            opens = changes(h)
            many = np.minimum.reduceat(code, opens) != np.maximum.reduceat(code, opens)
            settled = np.repeat(many, np.diff(np.append(opens, len(h))))
            part = (h >> (np.uint64(64) - bits)).astype(np.int64)
            # what is settled here goes on by document; its hash is announced once, with start -1
            side = parts + (W.mix((doc ^ key).astype(np.uint64)).astype(np.int64) & (parts - 1))
            told = opens[many]
            part = np.concatenate([np.where(settled, side[text], part), part[told]])
            h, text = np.concatenate([h, h[told]]), np.concatenate([text, text[told]])
            start = np.concatenate([start, np.full(len(told), -1)])
            short = ((h << bits) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            order = np.lexsort([start, text, part])
            part, text, start, short = part[order], text[order], start[order], short[order]
            at = np.append(changes(part), len(part))
            runs = np.append(changes(part, text), len(part))
            run_at = np.searchsorted(runs, at)
            of = text[runs[:-1]]
            yield pa.RecordBatch.from_arrays([
                pa.array(part[at[:-1]].astype(np.int32)), lists(doc[of], run_at, pa.int64()), lists(key[of], run_at, pa.int64()),
                lists(np.diff(runs), run_at, pa.int32()), lists(short, at, pa.int32()), lists(start, at, pa.int32()),
            ], ["part", "docs", "keys", "counts", "hash", "start"])

    def meet(rows: pa.Table) -> pa.Table:
        docs, keys, counts, h, start = flat(rows, "docs", "keys", "counts", "hash", "start")
        number = np.repeat(np.arange(len(docs)), counts)
        if rows.column("part")[0].as_py() < parts:
            code = codes(docs, keys)[number]
            order = np.argsort(h, kind="stable")
            opens = changes(h[order])
            shared = (np.minimum.reduceat(code[order], opens) != np.maximum.reduceat(code[order], opens)) | (np.minimum.reduceat(start[order], opens) < 0)
            kept = order[np.repeat(shared, np.diff(np.append(opens, len(h))))]
            kept = kept[start[kept] >= 0]
            number, start = number[kept], start[kept]
        return by_document(docs[number], keys[number], start)

    dealt = docs.mapInArrow(W.lean(deal), "part int, docs array<long>, keys array<long>, counts array<int>, hash array<int>, start array<int>")
    met = dealt.groupBy("part").applyInArrow(meet, f"{KEYS}, start array<int>")
    return met.groupBy("doc", "text_key").agg(F.flatten(F.collect_list("start")).alias("places"))


def by_document(doc: np.ndarray, key: np.ndarray, *values: np.ndarray) -> pa.Table:
    """One row for each document, its values as lists, each combination once."""
    names = ["start", "count"][:len(values)]
    order = np.lexsort([*values[::-1], key, doc])
    doc, key, values = doc[order], key[order], [v[order] for v in values]
    if len(doc):
        once = changes(doc, key, *values)
        doc, key, values = doc[once], key[once], [v[once] for v in values]
        at = np.append(changes(doc, key), len(doc))
    else:
        at = np.zeros(1, np.int64)
    return pa.table({"doc": doc[at[:-1]], "text_key": key[at[:-1]], **{n: lists(v, at, pa.int32()) for n, v in zip(names, values, strict=True)}})


def marked(docs: DataFrame, places: DataFrame, k: int, m: int) -> DataFrame:
    """Documents with the passages that may be repeated, cut anew by the groups that deal them.

    Documents without any are done, and come without their text.
    """
    def run(batches):
        for data, offsets, rows in chunks(batches):
            n = len(rows)
            starts = rows.column("places")
            number = np.repeat(np.arange(n), np.nan_to_num(starts.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
            wanted = np.unique(number << 32 | starts.flatten().to_numpy().astype(np.int64)) if len(number) else np.empty(0, np.int64)
            found = []
            for low, high in W.slices(offsets, SLICE):
                if not len(wanted) or not (np.searchsorted(wanted, high << 32) - np.searchsorted(wanted, low << 32)):
                    continue
                part, at = data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
                inside = inside_texts(at, k)
                text, start, count, _ = passages(at, least_hashes(part, k, m), inside)
                may = np.isin((text + low) << 32 | start, wanted)
                change = np.zeros(len(inside) + 1, np.int8)
                change[at[text[may]] + start[may]] += 1
                np.subtract.at(change, at[text[may]] + start[may] + count[may], 1)
                text, start, count, h = passages(at, least_hashes(part, k, min(m, DEALT)), np.cumsum(change[:-1]) > 0)
                found.append((text + low, start, count, h.view(np.int64)))
            text, start, count, h = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 4
            at = np.searchsorted(text, np.arange(n + 1))
            open_ = np.diff(at) > 0
            shas = [None if o else hashlib.sha256(data[a:b]).hexdigest() for o, a, b in zip(open_.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            body = pc.if_else(pa.array(open_), rows.column("text"), pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([
                *(rows.column(c) for c in ("doc_id", "doc", "text_key")), pa.array(np.diff(offsets)), pa.array(shas, pa.string()), body,
                lists(start, at, pa.int32()), lists(count, at, pa.int32()), lists(h, at, pa.int64()),
            ], ["doc_id", "doc", "text_key", "n_bytes", "kept_sha256", "text", "start", "count", "hash"])

    joined = docs.join(places, ["doc", "text_key"], "left").select("doc_id", "doc", "text_key", "text", "places")
    return joined.mapInArrow(W.lean(run), f"doc_id long, {KEYS}, n_bytes long, kept_sha256 string, text string, start array<int>, count array<int>, hash array<long>")


def gathered(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, ends)`` of pieces of ``data``, put one after another."""
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=ends[1:])
    at = np.repeat(start - ends[:-1], length)
    at += np.arange(ends[-1])
    return data[at], ends


def taken(data: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, ends)`` of some of the pieces."""
    return gathered(data, ends[which], ends[which + 1] - ends[which])


def cut(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """Pieces of ``data`` as binary values."""
    pieces, ends = gathered(data, start, length)
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(pieces)])


def repeated_windows(docs: DataFrame, parts: int, k: int, memory: int, names: int) -> DataFrame:
    """``(doc, text_key, start, count)``: the windows that an earlier document has, as runs by first byte."""
    bits = np.uint64(int(log2(parts)))

    def deal(batches):
        for data, offsets, rows in chunks(batches):
            doc, key = keys_of(rows)
            fresh = first_of_each(doc, key)
            columns = [rows.column(c) for c in ("start", "count", "hash")]
            text = np.repeat(np.arange(len(rows)), columns[0].value_lengths().to_numpy())
            start, count, h = (c.flatten().to_numpy().astype(np.int64) for c in columns)
            kept = fresh[text]
            text, start, count, h = text[kept], start[kept], count[kept], h[kept]
            if not len(text):
                continue
            part = (h.view(np.uint64) >> (np.uint64(64) - bits)).astype(np.int64)
            encoded = cut(data, offsets[text] + start, count + k - 1).dictionary_encode()
            piece = encoded.indices.to_numpy().astype(np.int64)
            order = np.lexsort([start, text, piece, part])  # equal pieces have equal parts
            text, start, part, piece, h = text[order], start[order], part[order], piece[order], h[order]
            at = np.append(changes(part), len(part))
            own = np.append(changes(piece), len(piece))
            pieces = encoded.dictionary.take(pa.array(piece[own[:-1]]))
            own_at = np.searchsorted(own, at)
            yield pa.RecordBatch.from_arrays([
                pa.array(part[at[:-1]].astype(np.int32)), pa.LargeListArray.from_arrays(pa.array(own_at, pa.int64()), pieces).cast(pa.list_(pa.binary())),
                lists(h[own[:-1]].astype(np.int32), own_at, pa.int32()), lists(np.diff(own), own_at, pa.int32()),
                lists(doc[text], at, pa.int64()), lists(key[text], at, pa.int64()), lists(start, at, pa.int32()),
            ], ["part", "pieces", "hash", "counts", "docs", "keys", "start"])

    def meet(rows: pa.Table) -> pa.Table:
        h, counts, docs, keys, start = flat(rows, "hash", "counts", "docs", "keys", "start")
        sent = rows.column("pieces").combine_chunks().flatten().cast(pa.large_binary()).dictionary_encode()
        piece = np.repeat(sent.indices.to_numpy().astype(np.int64), counts)
        pieces = sent.dictionary
        data, ends = np.frombuffer(pieces.buffers()[2], np.uint8), np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset:pieces.offset + len(pieces) + 1]
        code = codes(docs, keys)
        least = np.full(len(pieces), np.iinfo(np.int64).max)
        np.minimum.at(least, piece, code)
        held = np.diff(ends) - k + 1
        # equal windows have equal hashes: a piece that is the only one of its hash shares none with another
        of = np.empty(len(pieces), np.int32)
        of[sent.indices.to_numpy()] = h
        _, where, many = np.unique(of, return_inverse=True, return_counts=True)
        several = np.flatnonzero(many[where] > 1)
        owner, offset, length = later_windows(*taken(data, ends, several), least[several], k, memory, names)
        owner = several[owner]
        # a piece's later documents lose all of it, its first one what other pieces' documents have before it
        whole = np.flatnonzero(code > least[piece])
        first = np.flatnonzero(code == least[piece])
        low, high = np.searchsorted(owner, piece[first]), np.searchsorted(owner, piece[first], "right")
        some = np.repeat(first, high - low)
        run = np.arange(len(some)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
        at = np.concatenate([whole, some])
        lost = by_document(docs[at], keys[at], start[at] + np.concatenate([np.zeros(len(whole), np.int64), offset[run]]), np.concatenate([held[piece[whole]], length[run]]))
        W.release()
        return lost

    dealt = docs.mapInArrow(W.lean(deal), "part int, pieces array<binary>, hash array<int>, counts array<int>, docs array<long>, keys array<long>, start array<int>")
    return dealt.groupBy("part").applyInArrow(meet, f"{KEYS}, start array<int>, count array<int>")


def later_windows(data: np.ndarray, ends: np.ndarray, least: np.ndarray, k: int, memory: int = MEMORY, names: int = NAMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(piece, offset, windows)``: runs of windows of a piece that a piece of a smaller ``least`` has too, in order."""
    n = np.diff(ends)
    symbols = np.zeros(ends[-1] - ends[0] + len(n), np.uint16)
    owner = np.repeat(np.arange(len(n)), n)
    symbols[np.arange(len(owner)) + owner] = data[ends[0]:ends[-1]].astype(np.uint16) + 1
    starts = ends[:-1] - ends[0] + np.arange(len(n))
    begins = to_end(symbols == 0) >= k
    found, opens = [], []
    for places, common in ordered(symbols, k, memory, names):
        inside = begins[places]
        found.append(places[inside].astype(np.int64))
        opens.append(common[inside] < k)
    places, new = (np.concatenate(x) for x in (found, opens)) if found else (np.empty(0, np.int64),) * 2
    if not len(places):
        return places, places, places
    first = np.flatnonzero(new)
    of = least[np.searchsorted(starts, places, "right") - 1]
    source = np.repeat(np.minimum.reduceat(of, first), np.diff(np.append(first, len(of))))
    late = np.sort(places[of > source])
    piece = np.searchsorted(starts, late, "right") - 1
    if not len(late):
        return late, late, late
    new = np.ones(len(late), bool)
    new[1:] = (np.diff(late) != 1) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(new)
    return piece[first], (late - starts[piece])[first], np.diff(np.append(first, len(late)))


def deduplicated(docs: DataFrame, k: int = WINDOW, m: int = GROUP, memory: int = MEMORY, names: int = NAMES) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans)`` of every document of ``(doc_id, text)``.

    ``kept`` are the bytes left, null where nothing was removed; ``spans`` the removed
    runs as ``(start, length)`` in bytes.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 << ceil(log2(max(LEAST_PARTS, size / PART_BYTES)))
    known = keyed(docs)
    with shuffles_freed(docs.sparkSession):
        found = durable(marked(known, shared_passages(known, parts, k, m), k, m))
        candidates = found.filter("text is not null")
        runs = repeated_windows(candidates.select("doc", "text_key", "text", "start", "count", "hash"), parts, k, memory, names)
        lost = durable(runs.groupBy("doc", "text_key").agg(*[F.flatten(F.collect_list(c)).alias(f"lost_{c}") for c in ("start", "count")]))

    def remove(batches):
        for batch in batches:
            data, offsets = W.buffer(batch.column("text"))
            out = {c: [] for c in ("n_removed", "n_spans", "kept_sha256", "kept", "spans")}
            for i, (starts, counts) in enumerate(zip(batch.column("lost_start"), batch.column("lost_count"), strict=True)):
                text = data[offsets[i]:offsets[i + 1]]
                if not starts.is_valid:
                    spans, kept = [], None
                else:
                    low = starts.values.to_numpy().astype(np.int64)
                    change = np.zeros(len(text) + 1, np.int32)
                    np.add.at(change, low, 1)
                    np.add.at(change, low + counts.values.to_numpy() + k - 1, -1)
                    gone = np.cumsum(change)[:-1] > 0
                    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                    spans, kept = [{"start": a, "length": b - a} for a, b in edges.tolist()], text[~gone]
                left = text if kept is None else kept
                out["n_removed"].append(len(text) - len(left))
                out["n_spans"].append(len(spans))
                out["kept_sha256"].append(hashlib.sha256(left.tobytes()).hexdigest())
                out["kept"].append(None if kept is None else kept.tobytes())
                out["spans"].append(spans)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("n_bytes"), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()),
                pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.binary()), pa.array(out["spans"], SPANS),
            ], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:int,length:int>>"
    changed = candidates.select("doc_id", "doc", "text_key", "n_bytes", "text").join(lost, ["doc", "text_key"], "left")
    changed = changed.select("doc_id", "n_bytes", "text", "lost_start", "lost_count").mapInArrow(W.lean(remove), schema)
    zero = F.lit(0).cast("long")
    plain = found.filter("text is null").select(
        "doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), "kept_sha256", F.lit(None).cast("binary").alias("kept"),
        F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return plain.unionByName(changed)


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
