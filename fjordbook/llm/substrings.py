"""Substring dedup by De Bruijn compaction over token k-mers.

A window of ``k`` words is an edge from its first ``k - 1`` words to its last. Edges
are partitioned by minimizer, the least-hashed group of ``m`` words inside the
window, which equal windows share and neighbouring windows mostly keep:

1. Minimizers are dealt by hash. Those of one document only are dropped; windows
   around the others are the edges that may be repeated.
2. Those edges are dealt by the hash of their minimizer, so that equal ones meet and
   neighbours arrive together. An edge whose least document is another one is
   repeated and gets that document's coordinates. Edges in a row whose source
   coordinates are in a row too are one unbranched path and leave as one row.
3. A join on the document brings its paths together. Paths that continue each other
   at the source as well are compacted to one span, across the borders of the parts.

Windows are compared by a 96-bit hash. A word group that occurs in many documents of
one batch is settled there and sent once, so a passage of a third of all documents
is as many rows as there are batches.

Defined cases: a null text has no words; texts of fewer than ``k`` words lose
nothing; documents of one doc_id never count as sources of each other, and rows
alike give rows alike; documents without a doc_id come after all others and not before
each other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordbook.llm import words as W
from fjordbook.llm.common import table
from fjordbook.session import durable

#: Words of a window and of a minimizer; bytes of text per part of the hashes, and the fewest parts.
WINDOW, GROUP, PART_BYTES, LEAST_PARTS = 13, 6, 24 << 20, 64
#: Bytes of text whose windows a task holds at once.
CHUNK = 12 << 20
#: Stands for a missing doc_id: after all others.
LAST = (1 << 63) - 1
#: Places carry their text's checksum above these bits, so that unlike texts of one doc_id stay apart.
PLACE_BITS = 32
PATHS = "doc_id long, start array<long>, count array<int>, source array<long>, source_start array<long>"


def minima(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the first least value of every ``width`` values in a row."""
    at, step = np.arange(len(values)), 1
    while step < width and len(at) > 0:
        move = min(step, width - step)
        a, b = at[:-move], at[move:]
        at = np.where(values[b] < values[a], b, a)
        step += move
    return at


class Windows:
    """The windows of one slice of texts: where they begin, their minimizers and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, k: int, m: int):
        self.starts, self.ends, self.first = W.spans(data, offsets)
        self.words = W.hashes(data, self.starts, self.ends)
        self.owner = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.k = k
        self.groups = W.shingles(self.words, m)
        least = minima(self.groups, k - m + 1)
        begin = np.arange(len(least))
        self.begin = begin[begin + k <= self.first[self.owner[:len(least)] + 1]] if len(least) else begin
        self.minimizer = least[self.begin]

    def hashed(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of every window, by first word."""
        return W.shingles(self.words, self.k), W.shingles(W.mix(self.words + np.uint64(7)), self.k).astype(np.uint32)


def tag(text: bytes) -> int:
    """What a text's places are raised by."""
    return (zlib.crc32(text) & 0x7FFFFFFF) << PLACE_BITS


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. within each count."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def _changes(*keys: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before it in any key."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in keys])
    return new


def chunks(batches):
    """``(bytes, offsets, doc_ids, rows)`` of each part of the batches that holds ``CHUNK`` bytes of text."""
    for batch in batches:
        data, offsets = W.buffer(batch.column("text"))
        for low, high in W.slices(offsets, CHUNK):
            rows = batch.slice(low, high - low)
            yield data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], rows.column("doc_id").to_numpy(zero_copy_only=False), rows


def shared_groups(docs: DataFrame, parts: int, k: int, m: int) -> DataFrame:
    """``(doc_id, places)``: word numbers of the minimizers that more than one document has."""
    bits = np.uint64(int(log2(parts)))

    def deal(batches):
        for data, offsets, ids, _ in chunks(batches):
            hs, ds, ps = [], [], []
            for low, high in W.slices(offsets):
                w = Windows(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], k, m)
                at = w.minimizer[_changes(w.minimizer)] if len(w.minimizer) else w.minimizer
                hs.append(w.groups[at])
                ds.append(ids[low:high][w.owner[at]])
                ps.append(at - w.first[w.owner[at]])
            if not hs:
                continue
            h, doc, place = np.concatenate(hs), np.concatenate(ds), np.concatenate(ps)
            if not len(h):
                continue
            order = np.argsort(h)
            h, doc, place = h[order], doc[order], place[order]
            opens = np.flatnonzero(_changes(h))
            many = np.minimum.reduceat(doc, opens) != np.maximum.reduceat(doc, opens)
            settled = np.repeat(many, np.diff(np.append(opens, len(h))))
            part = (h >> (np.uint64(64) - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
            # what is settled here goes on by document; its hash is announced once, with place -1
            ann = opens[many]
            part = np.concatenate([np.where(settled, parts + W.mix(doc.astype(np.uint64)).astype(np.int64) % parts, part), part[ann]])
            h, doc, place = np.concatenate([h, h[ann]]), np.concatenate([doc, doc[ann]]), np.concatenate([place, np.full(len(ann), -1)])
            short = ((h << bits) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            order = np.lexsort([place, doc, part])
            part, doc, place, short = part[order], doc[order], place[order], short[order]
            at = np.append(np.flatnonzero(_changes(part)), len(part))
            runs = np.append(np.flatnonzero(_changes(part, doc)), len(part))
            run_at = np.searchsorted(runs, at)
            yield pa.RecordBatch.from_arrays([
                pa.array(part[at[:-1]].astype(np.int32)), _lists(doc[runs[:-1]], run_at, pa.int64()), _lists(np.diff(runs), run_at, pa.int32()),
                _lists(short, at, pa.int32()), _lists(place, at, pa.int32()),
            ], ["part", "docs", "counts", "hash", "place"])

    def meet(rows: pa.Table) -> pa.Table:
        flat = {c: rows.column(c).combine_chunks().flatten().to_numpy() for c in ("docs", "counts", "hash", "place")}
        doc, h, place = np.repeat(flat["docs"], flat["counts"]), flat["hash"], flat["place"]
        if rows.column("part")[0].as_py() < parts:
            order = np.argsort(h)
            doc, h, place = doc[order], h[order], place[order]
            opens = np.flatnonzero(_changes(h))
            shared = (np.minimum.reduceat(doc, opens) != np.maximum.reduceat(doc, opens)) | (np.minimum.reduceat(place, opens) < 0)
            keep = np.repeat(shared, np.diff(np.append(opens, len(h)))) & (place >= 0)
            doc, place = doc[keep], place[keep]
        order = np.lexsort([place, doc])
        doc, place = doc[order], place[order]
        at = np.append(np.flatnonzero(_changes(doc)), len(doc))
        return pa.table({"doc_id": doc[at[:-1]], "places": _lists(place, at, pa.int32())})

    dealt = docs.mapInArrow(W.lean(deal), "part int, docs array<long>, counts array<int>, hash array<int>, place array<int>")
    met = dealt.groupBy("part").applyInArrow(meet, "doc_id long, places array<int>")
    return met.groupBy("doc_id").agg(F.flatten(F.collect_list("places")).alias("places"))


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def marked(docs: DataFrame, places: DataFrame, k: int, m: int) -> DataFrame:
    """Documents with the windows that may be repeated, as runs ``(start, count)``; those without any are done.

    Texts are kept for documents with such windows only; the others get their result here.
    """
    def run(batches):
        for batch in batches:
            data, offsets = W.buffer(batch.column("text"))
            lists = batch.column("places").to_pylist()
            n = len(batch)
            n_words, shas, texts = np.zeros(n, np.int64), [None] * n, [None] * n
            starts, counts = [[] for _ in range(n)], [[] for _ in range(n)]
            for low, high in W.slices(offsets):
                part, at = data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
                w = Windows(part, at, k, m)
                n_words[low:high] = np.diff(w.first)
                mark = np.zeros(len(w.words) + 1, bool)
                for i in range(low, high):
                    if lists[i]:
                        spots = np.array(lists[i], np.int64) + w.first[i - low]
                        mark[spots[spots < w.first[i - low + 1]]] = True
                begin = w.begin[mark[w.minimizer]] if len(w.begin) else w.begin
                if len(begin):
                    owner = w.owner[begin]
                    opens = np.ones(len(begin), bool)
                    opens[1:] = (np.diff(begin) != 1) | (owner[1:] != owner[:-1])
                    first = np.flatnonzero(opens)
                    for o, s, c in zip(owner[first].tolist(), (begin - w.first[owner])[first].tolist(), np.diff(np.append(first, len(begin))).tolist(), strict=True):
                        starts[low + o].append(s)
                        counts[low + o].append(c)
                for i in range(low, high):
                    text = part[at[i - low]:at[i - low + 1]].tobytes()
                    if starts[i]:
                        texts[i] = text.decode("utf-8", "replace")
                    else:
                        shas[i] = digest(text.split())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n_words), pa.array(shas, pa.string()), pa.array(texts, pa.string()),
                pa.array(starts, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())),
            ], ["doc_id", "n_words", "kept_sha256", "text", "start", "count"])

    rows = docs.join(places, "doc_id", "left").select("doc_id", "text", "places")
    return rows.mapInArrow(W.lean(run), "doc_id long, n_words long, kept_sha256 string, text string, start array<int>, count array<int>")


def _paths(doc: np.ndarray, place: np.ndarray, source: np.ndarray, source_place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows in a row in the document and at the source, as ``(doc, start, count, source, source start)``."""
    order = np.lexsort([place, doc])
    doc, place, source, source_place = doc[order], place[order], source[order], source_place[order]
    new = _changes(doc, source, place - source_place)
    if len(new) > 1:
        new[1:] |= place[1:] != place[:-1] + 1
    first = np.flatnonzero(new)
    return doc[first], place[first], np.diff(np.append(first, len(doc))), source[first], source_place[first]


def _path_rows(doc, start, count, source, source_start) -> tuple[pa.Array, ...]:
    at = np.append(np.flatnonzero(_changes(doc)), len(doc))
    return (pa.array(doc[at[:-1]]), _lists(start, at, pa.int64()), _lists(count, at, pa.int32()), _lists(source, at, pa.int64()), _lists(source_start, at, pa.int64()))


PATH_NAMES = ["doc_id", "start", "count", "source", "source_start"]


def repeated_paths(runs: DataFrame, parts: int, k: int, m: int) -> DataFrame:
    """``(doc_id, start, count, source, source_start)``: the repeated windows as paths, with a smaller document that has them."""
    bits = np.uint64(int(log2(parts)))

    def deal(batches):
        for data, offsets, ids, batch in chunks(batches):
            lists = [(c.offsets.to_numpy(), c.flatten().to_numpy()) for c in (batch.column("start"), batch.column("count"))]
            found = []
            for low, high in W.slices(offsets):
                w = Windows(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], k, m)
                if not len(w.begin):
                    continue
                (at, start), (_, count) = lists
                s = slice(at[low] - at[0], at[high] - at[0])
                owner = np.repeat(np.arange(high - low), np.diff(at[low:high + 1]))
                place = np.repeat(start[s] + w.first[owner], count[s]) + _ranges(count[s])
                group = np.zeros(len(w.words), np.int64)
                group[w.begin] = w.minimizer
                one, two = w.hashed()
                tags = np.array([tag(data[a:b].tobytes()) for a, b in zip(offsets[low:high].tolist(), offsets[low + 1:high + 1].tolist(), strict=True)], np.int64)
                of = w.owner[place]
                found.append((one[place], two[place], w.groups[group[place]], ids[low:high][of], tags[of] + place - w.first[of]))
            if not found:
                continue
            one, two, group, doc, place = (np.concatenate(x) for x in zip(*found, strict=True))
            # equal windows of this batch: all but the least document's are settled by it
            order = np.lexsort([place, doc, two, one])
            one, two, group, doc, place = one[order], two[order], group[order], doc[order], place[order]
            opens = np.flatnonzero(_changes(one, two))
            size = np.diff(np.append(opens, len(one)))
            least, least_place = np.repeat(doc[opens], size), np.repeat(place[opens], size)
            settled = doc > least
            if settled.any():
                doc_p, *rest = _paths(doc[settled], place[settled], least[settled], least_place[settled])
                side = parts + W.mix(doc_p.astype(np.uint64)).astype(np.int64) % parts
                at = np.flatnonzero(_changes(doc_p))
                cols = _path_rows(doc_p, *rest)
                empty = pa.array([[]] * len(at), pa.list_(pa.int64()))
                empty_int = pa.array([[]] * len(at), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(side[at].astype(np.int32)), *cols, empty, empty_int], ["part", *PATH_NAMES, "one", "two"])
            own = ~settled
            one, two, doc, place = one[own], two[own], doc[own], place[own]
            part = (group[own] >> (np.uint64(64) - bits)).astype(np.int64) if bits else np.zeros(len(one), np.int64)
            order = np.lexsort([place, doc, part])
            one, two, doc, place, part = one[order], two[order], doc[order], place[order], part[order]
            new = _changes(part, doc)
            if len(new) > 1:
                new[1:] |= place[1:] != place[:-1] + 1
            runs_at = np.append(np.flatnonzero(new), len(part))
            at = np.append(np.flatnonzero(_changes(part)), len(part))
            run_at = np.searchsorted(runs_at, at)
            head = runs_at[:-1]
            yield pa.RecordBatch.from_arrays([
                pa.array(part[at[:-1]].astype(np.int32)), pa.nulls(len(at) - 1, pa.int64()), _lists(place[head], run_at, pa.int64()), _lists(np.diff(runs_at), run_at, pa.int32()),
                _lists(doc[head], run_at, pa.int64()), _lists(np.zeros(len(head), np.int64), run_at, pa.int64()),
                _lists(one.view(np.int64), at, pa.int64()), _lists(two.view(np.int32), at, pa.int32()),
            ], ["part", *PATH_NAMES, "one", "two"])

    def meet(rows: pa.Table) -> pa.Table:
        if rows.column("part")[0].as_py() >= parts:
            return rows.select(PATH_NAMES)
        flat = {c: rows.column(c).combine_chunks().flatten().to_numpy() for c in ("start", "count", "source", "one", "two")}
        count = flat["count"]
        doc, place = np.repeat(flat["source"], count), np.repeat(flat["start"], count) + _ranges(count)
        one, two = flat["one"].view(np.uint64), flat["two"]
        order = np.lexsort([place, doc, two, one])
        one, two, doc, place = one[order], two[order], doc[order], place[order]
        opens = np.flatnonzero(_changes(one, two))
        size = np.diff(np.append(opens, len(one)))
        least, least_place = np.repeat(doc[opens], size), np.repeat(place[opens], size)
        repeated = doc > least
        return pa.table(list(_path_rows(*_paths(doc[repeated], place[repeated], least[repeated], least_place[repeated]))), names=PATH_NAMES)

    dealt = runs.mapInArrow(W.lean(deal), f"part int, {PATHS}, one array<long>, two array<int>")
    return dealt.groupBy("part").applyInArrow(meet, PATHS)


def compacted(text: bytes, start, count, source, source_start) -> list[tuple[int, int, int, int]]:
    """A text's paths in order, those that continue each other here and at the source as one."""
    out: list[list[int]] = []
    own, place = tag(text), (1 << PLACE_BITS) - 1
    mine = [(s - own, c, d, p) for s, c, d, p in zip(start, count, source, source_start, strict=True) if s & ~place == own]
    for s, c, d, p in sorted(mine):
        last = out[-1] if out else None
        if last and s == last[0] + last[1] and d == last[2] and p == last[3] + last[1]:
            last[1] += c
        else:
            out.append([s, c, d, p])
    return [(s, c, d, p & place) for s, c, d, p in out]


def deduplicated(docs: DataFrame, k: int = WINDOW, m: int = GROUP) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, kept, spans)`` of every document of ``(doc_id, text)``.

    ``kept`` is the text left, null where nothing was removed; ``spans`` are the
    repeated spans as ``(start, words, source, source_start)`` in word numbers.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 << ceil(log2(max(LEAST_PARTS, size / PART_BYTES)))
    known = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), "text")
    found = durable(marked(known, shared_groups(known, parts, k, m), k, m))
    runs = found.filter("text is not null")
    paths = repeated_paths(runs.select("doc_id", "text", "start", "count"), parts, k, m)
    lists = [c for c in PATH_NAMES if c != "doc_id"]
    by_doc = paths.groupBy("doc_id").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in lists])

    def remove(batches):
        for batch in batches:
            rows = batch.to_pydict()
            out = {c: [] for c in ("n_removed", "kept_sha256", "kept", "spans")}
            for text, *path in zip(rows["text"], *(rows[c] for c in lists), strict=True):
                raw = text.encode()
                words = raw.split()
                spans = compacted(raw, *path) if path[0] else []
                gone = np.zeros(len(words) + 1, np.int32)
                for s, c, _, _ in spans:
                    gone[s] += 1
                    gone[min(s + c + k - 1, len(words))] -= 1
                keep = np.cumsum(gone)[:-1] == 0
                left = [w for w, x in zip(words, keep.tolist(), strict=True) if x]
                out["n_removed"].append(len(words) - len(left))
                out["kept_sha256"].append(digest(left))
                out["kept"].append(b" ".join(left).decode("utf-8", "replace"))
                out["spans"].append([{"start": s, "words": c + k - 1, "source": d, "source_start": p} for s, c, d, p in spans])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("n_words"), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string()),
                pa.array(out["kept"], pa.string()), pa.array(out["spans"], SPANS),
            ], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans"])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<start:int,words:int,source:long,source_start:int>>"
    changed = runs.select("doc_id", "n_words", "text").join(by_doc, "doc_id", "left").select("doc_id", "n_words", "text", *lists).mapInArrow(W.lean(remove), schema)
    plain = found.filter("text is null").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept"),
        F.array().cast("array<struct<start:int,words:int,source:long,source_start:int>>").alias("spans"))
    return plain.unionByName(changed).withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(LAST)))


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())]))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("spans").alias("n_spans"))
