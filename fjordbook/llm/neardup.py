"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within a radius have a value in common that is at most half the
radius from each. So every fingerprint stands for all its variants within half the
radius, fingerprints meet on equal variants, and meeting pairs are verified.

Variants are dealt by their leading bits. A fingerprint is sent once for each
prefix that its variants have, a few dozen rows in place of thousands, and the task
of a prefix forms the variants that begin with it, sorts them, and finds the equal
ones. Fingerprints that share a variant are linked to the least of them; each task
sends a spanning forest of its links and not all pairs. Equal fingerprints are one
node from the start, whatever their number.

Defined cases: a null text is an empty one; a text without words has the zero
fingerprint and links like any other; rows alike have one fingerprint; a component
without any doc_id has a null id; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fjordbook.llm.common import table, whole_row
from fjordbook.llm.components import components
from fjordbook.llm.words import lean, mix, release
from fjordbook.session import durable

SEED = 42
#: Variants that meet in one task, on average, and those it forms at once; fewest leading bits to deal by.
VARIANTS, FORMED, LEAST_LEAD = 4_000_000, 1_000_000, 3
#: Members and shingles of a part of a candidate group, and shingles compared at once.
PART_ROWS, PART_SHINGLES, COLUMNS = 128, 500_000, 4096
SEEDS = mix(np.arange(101, 165, dtype=np.uint64))


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """The XXH64 of every shingle of a UTF-8 text, in order.

    A shingle is ``shingle`` words, lower-cased in A-Z and joined by one space; a
    shorter text is one shingle, and one without words has none.
    """
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    k = min(shingle, len(words))
    starts = np.concatenate([[0], ends[:-1]])[:len(words) - k + 1].tolist()
    digest, stops = xxhash.xxh64_digest, (ends[k - 1:] - 1).tolist()
    raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)])
    return np.frombuffer(raw, ">u8").astype(np.uint64)


def simhash(hashes: np.ndarray, bits: int) -> bytes:
    """Bit by bit, whether over half of the hashes have it set. Bits beyond 64 are remixed from them."""
    counts = np.zeros(bits, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        some = hashes[i:i + (1 << 15)]
        for j in range(bits // 64):
            part = (some if j == 0 else mix(some + SEEDS[j])).astype(">u8")
            set_bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1)
            counts[64 * j:64 * j + 64] += np.add.reduce(set_bits, axis=0, dtype=np.uint16)
    return np.packbits(counts * 2 > len(hashes)).tobytes()


def code_of(text: bytes, shingle: int, bits: int) -> bytes:
    """The SimHash of a UTF-8 text over all its shingles; zero for one without words."""
    return simhash(shingle_hashes(text, shingle), bits)


def fingerprints(docs: DataFrame, shingle: int, bits: int = 64) -> DataFrame:
    """``(doc_id, code)`` of every whole text."""
    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            found = [code_of(t.as_py() or b"", shingle, bits) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "code"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, code binary")


def flips(width: int, most: int) -> list[np.ndarray]:
    """Masks of ``width`` bits by number of set bits, up to ``most``."""
    ones = [1 << i for i in range(width)]
    return [np.array([sum(c) for c in combinations(ones, n)], np.uint64) for n in range(most + 1)]


def block_values(codes: np.ndarray, block: int, width: int) -> np.ndarray:
    """Bits ``block * width`` and on of each code, as numbers; ``width`` is a multiple of 8."""
    part = codes[:, block * width // 8:(block + 1) * width // 8]
    out = np.zeros(len(codes), np.uint64)
    for column in part.T:
        out = (out << np.uint64(8)) | column
    return out


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least index reachable from each of ``n`` nodes."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def meetings(values: np.ndarray, prefix: int, lead: int, width: int, half: int, codes: np.ndarray, limit: int) -> np.ndarray:
    """Forest of the verified links among rows whose variants begin with ``prefix``."""
    n, low = len(values), width - lead
    rest = values & np.uint64((1 << low) - 1)
    apart = np.bitwise_count((values >> np.uint64(low) if lead else values * np.uint64(0)) ^ np.uint64(prefix)).astype(np.int64)
    masks = flips(low, half)
    index_bits = max(1, int(n - 1).bit_length())
    parts = []
    for left in range(half + 1):
        rows = np.flatnonzero(apart == half - left)
        if len(rows):
            ball = np.concatenate(masks[:left + 1])
            keys = (rest[rows][:, None] ^ ball[None, :]) * np.uint64(0x9E3779B97F4A7C15)
            parts.append(((keys >> np.uint64(index_bits) << np.uint64(index_bits)) | rows.astype(np.uint64)[:, None]).ravel())
    keys = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    keys.sort()
    same = (keys[1:] >> np.uint64(index_bits)) == (keys[:-1] >> np.uint64(index_bits))
    met = np.flatnonzero(same)
    if not len(met):
        return np.arange(n)
    # runs of equal variants: each member with the run's first
    opens = np.concatenate([[True], np.diff(met) > 1])
    run = np.cumsum(opens) - 1
    begin = met[opens]
    index = np.uint64((1 << index_bits) - 1)
    member, first = (keys[met + 1] & index).astype(np.int64), (keys[begin] & index).astype(np.int64)[run]

    def verified(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), bool)
        for i in range(0, len(a), 1 << 18):
            s = slice(i, i + (1 << 18))
            out[s] = np.bitwise_count(codes[a[s]] ^ codes[b[s]]).sum(1) <= limit
        return out

    pair, where = np.unique(first * n + member, return_inverse=True)
    a, b = pair // n, pair % n
    good = verified(a, b)
    links_a, links_b = [a[good]], [b[good]]
    # members that fail against the first are held against all others of their run
    size = np.bincount(run) + 1
    failed = np.flatnonzero(~good[where] & (size[run] > 2))
    for i in range(0, len(failed), 4096):
        part = failed[i:i + 4096]
        many = size[run[part]]
        other = np.repeat(begin[run[part]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pair = np.unique(np.repeat(member[part], many) * n + (keys[other] & index).astype(np.int64))
        a, b = pair // n, pair % n
        good = verified(a, b) & (a != b)
        links_a.append(a[good])
        links_b.append(b[good])
    return forest(np.concatenate(links_a), np.concatenate(links_b), n)


def all_meetings(values: np.ndarray, prefix: int, lead: int, width: int, half: int, codes: np.ndarray, limit: int) -> np.ndarray:
    """:func:`meetings` under a prefix, a longer prefix at a time, so that few variants are formed at once."""
    n = len(values)
    ball = sum(comb(width - lead, i) for i in range(half + 1))
    more = max(0, min(width - lead - half - 1, ceil(log2(max(1, n * ball / FORMED)))))
    if not more:
        return meetings(values, prefix, lead, width, half, codes, limit)
    tops, links_a, links_b = values >> np.uint64(width - lead - more), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for longer in range(prefix << more, (prefix + 1) << more):
        rows = np.flatnonzero(np.bitwise_count(tops ^ np.uint64(longer)) <= half)
        root = meetings(values[rows], longer, lead + more, width, half, codes[rows], limit)
        linked = np.flatnonzero(root != np.arange(len(rows)))
        links_a.append(rows[linked])
        links_b.append(rows[root[linked]])
    return forest(np.concatenate(links_a), np.concatenate(links_b), n)


def links(codes: DataFrame, count: int, bits: int, radius: int, blocks: int = 1, width: int | None = None, limit: int | None = None, variants: int = VARIANTS, held: int | None = None) -> DataFrame:
    """``(a, b)`` over ``(id, code)`` rows: a spanning forest per task of pairs within ``radius`` in a block.

    With one block of all bits the radius is that of the code. With several blocks
    of ``width`` bits, pairs within ``radius`` in any of them are candidates, and
    ``limit`` is the radius of the whole code that they are held to, or of ``held``
    of its bits from the block on: only those are sent.
    """
    limit = radius if limit is None else limit
    sent = (held or bits) // 8
    width, half = width or bits // blocks, ceil(radius / 2)
    ball = sum(comb(width, i) for i in range(half + 1))
    lead = max(0, min(width - half - 1, max(LEAST_LEAD, ceil(log2(max(1, count * ball / variants))))))
    prefixes = np.concatenate(flips(lead, min(half, lead)))

    def emit(batches):
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, bits // 8)
            for block in range(blocks):
                part = np.ascontiguousarray(np.roll(raw, -block * width // 8, axis=1)[:, :sent])
                code = pa.FixedSizeBinaryArray.from_buffers(pa.binary(sent), len(part), [None, pa.py_buffer(part)]).cast(pa.binary())
                top = block_values(part, 0, width) >> np.uint64(width - lead) if lead else np.zeros(len(raw), np.uint64)
                keys = ((top[:, None] ^ prefixes[None, :]) | np.uint64(block << lead)).ravel().astype(np.int64)
                rows = pa.array(np.repeat(np.arange(len(raw)), len(prefixes)))
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).take(rows), code.take(rows)], ["key", "id", "code"])

    def meet(rows: pa.Table) -> pa.Table:
        key = rows.column("key")[0].as_py()
        order = np.argsort(rows.column("id").to_numpy())
        ids = rows.column("id").to_numpy()[order]
        raw = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(-1, sent)[order]
        root = all_meetings(block_values(raw, 0, width), key & ((1 << lead) - 1), lead, width, half, raw.view(np.uint64), limit)
        linked = np.flatnonzero(root != np.arange(len(ids)))
        release()
        return pa.table({"a": ids[linked], "b": ids[root[linked]]})

    return codes.select("id", "code").mapInArrow(lean(emit), "key long, id long, code binary").groupBy("key").applyInArrow(meet, "a long, b long")


def groups(prints: DataFrame, bits: int, radius: int, **how) -> DataFrame:
    """A stored table of fingerprints with each row's ``component`` and ``component_id``, the least doc_id reachable."""
    codes = durable(prints.groupBy("code").agg(F.min("doc_id").alias("low")).withColumn("id", F.monotonically_increasing_id()))
    found = links(codes, codes.count(), bits, radius, **how)
    roots = durable(components(found))
    linked = codes.select("id", "low").join(roots.withColumnRenamed("node", "id"), "id")
    lows = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    known = roots.join(lows, "root").select(F.col("node").alias("id"), "root", "component_id")
    named = codes.join(known, "id", "left").select("code", F.coalesce("root", "id").alias("component"), F.coalesce("component_id", "low").alias("component_id"))
    return prints.join(named, "code")


def similar_links(left: list[int], right: list[int], sets: list[np.ndarray], similar: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a member of ``left`` and one of ``right`` whose sets have a Jaccard similarity of ``similar`` or more."""
    used = sorted({*left, *right})
    sizes = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(used, [len(sets[i]) for i in used])
    values, column, times = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    shared = times[column] > 1  # what one set has alone is in no intersection
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    row_of = np.full((2, len(sets)), -1)
    row_of[0, left], row_of[1, right] = np.arange(len(left)), np.arange(len(right))
    both = np.zeros((len(left), len(right)))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        sides = []
        for side, n in ((0, len(left)), (1, len(right))):
            rows = row_of[side, owner[a:b]]
            held = np.zeros((n, COLUMNS), np.float32)
            held[rows[rows >= 0], column[a:b][rows >= 0] - low] = 1
            sides.append(held)
        both += sides[0] @ sides[1].T
    union = sizes[left][:, None] + sizes[right][None, :] - both
    one, other = np.nonzero(both >= similar * union)
    return np.array(left, np.int64)[one], np.array(right, np.int64)[other]


def verified(members: DataFrame, shingle: int, similar: float, buckets: int) -> DataFrame:
    """``(a, b)``: a spanning forest per task of the pairs of a candidate group that are similar, by their whole shingle sets.

    ``members`` are ``(id, root, parts, text)``. Small groups share a task. A large one
    is dealt in ``parts``, and each two of them meet in one task, so that pairs are
    compared in memory, all of them, and are never rows.
    """
    def emit(batches):
        for batch in batches:
            for i, root, parts, text in zip(*(batch.column(c).to_pylist() for c in ("id", "root", "parts")), batch.column("text").cast(pa.large_binary()), strict=True):
                found = np.unique(shingle_hashes(text.as_py() or b"", shingle)).tobytes()
                mine = int(mix(np.array([i], np.uint64))[0]) % parts
                if parts == 1:
                    keys = [(-1 - int(mix(np.array([root], np.uint64))[0]) % buckets, 0, 0)]
                else:
                    keys = [(root, min(mine, j), max(mine, j)) for j in range(parts)]
                for group in range(0, len(keys), 64):
                    some = keys[group:group + 64]
                    n = len(some)
                    columns = [pa.array(x, kind) for x, kind in zip(zip(*some, strict=True), (pa.int64(), pa.int32(), pa.int32()), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [*columns, pa.array([root] * n, pa.int64()), pa.array([i] * n, pa.int64()), pa.array([mine] * n, pa.int32()), pa.array([found] * n, pa.binary())],
                        ["task", "one", "two", "root", "id", "mine", "found"])

    def compare(rows: pa.Table) -> pa.Table:
        one, two = rows.column("one")[0].as_py(), rows.column("two")[0].as_py()
        roots, ids, mine = (rows.column(c).to_numpy() for c in ("root", "id", "mine"))
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("found").to_pylist()]
        order = np.lexsort([ids, roots])
        borders = np.flatnonzero(np.diff(roots[order], prepend=-1, append=-1))
        links_a, links_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for low, high in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            group = order[low:high]
            left, right = group[mine[group] == one], group[mine[group] == two]
            if len(group) > 1 and len(left) and len(right):
                local = [sets[i] for i in group]
                at = {g: i for i, g in enumerate(group.tolist())}
                a, b = similar_links([at[g] for g in left.tolist()], [at[g] for g in right.tolist()], local, similar)
                links_a.append(group[a])
                links_b.append(group[b])
        label = forest(np.concatenate(links_a), np.concatenate(links_b), len(ids))
        linked = np.flatnonzero(label != np.arange(len(ids)))
        release()
        return pa.table({"a": ids[linked], "b": ids[label[linked]]})

    dealt = members.select("id", "root", "parts", "text").mapInArrow(lean(emit), "task long, one int, two int, root long, id long, mine int, found binary")
    return dealt.groupBy("task", "one", "two").applyInArrow(compare, "a long, b long")


def deduplicated(docs: DataFrame, shingle: int = 5, similar: float = 0.8, bits: int = 512, radius: int = 4, blocks: int = 16, width: int = 32, held: int = 256, limit: int = 60) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one of least doc_id, nulls last.

    Documents are linked where their sets of ``shingle`` words have a Jaccard
    similarity of ``similar`` or more, and a group is all that such links connect.
    Codes only find the candidates; groups of these are then compared pair by pair
    on the whole sets. Texts with one set are one node from the start.

    At a similarity of 0.8 sets differ in 15 in a hundred bits on average. Such a pair
    comes within ``radius`` in a block of 32 bits with probability 0.45 to 0.48, so it
    misses all sixteen blocks in about 1 of 20,000 cases. Of the 256 bits from the
    block on it then differs in 38 with a deviation of 5, which leaves 4 deviations to
    ``limit``. A candidate group can also join such a pair through a third document.
    """
    mark = F.xxhash64("text")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", mark.alias("mark"))

    def run(batches):
        for batch in batches:
            digests, sizes, codes = [], [], []
            for text in batch.column("text").cast(pa.large_binary()):
                found = np.unique(shingle_hashes(text.as_py() or b"", shingle))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                sizes.append(len(found))
                codes.append(simhash(found, bits))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(codes, pa.binary())],
                ["doc_id", "mark", "digest", "size", "code"])

    prints = durable(keyed.mapInArrow(lean(run), "doc_id long, mark long, digest binary, size long, code binary"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark"))
    nodes = durable(prints.groupBy("digest", "size", "code").agg(first.alias("first")).withColumn("id", F.monotonically_increasing_id()))
    near = durable(components(links(nodes, nodes.count(), bits, radius, blocks, width, limit, 4 * VARIANTS, held)))
    known = near.join(nodes.select(F.col("id").alias("node"), "size", F.struct("first.doc_id", "first.mark").alias("key")), "node")
    total = known.agg(F.sum("size")).first()[0] or 0
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / PART_ROWS), F.ceil(F.sum("size") / PART_SHINGLES), F.lit(1)).cast("int")
    wanted = known.join(near.join(nodes.select(F.col("id").alias("node"), "size"), "node").groupBy("root").agg(parts.alias("parts")), "root")
    texts = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), mark.alias("mark")).alias("key"), "text")
    members = texts.join(wanted.select(F.col("node").alias("id"), "root", "parts", "key"), "key").dropDuplicates(["id"])
    linked = durable(components(verified(members, shingle, similar, total // PART_SHINGLES + 1)))
    grouped = nodes.join(linked.withColumnRenamed("node", "id"), "id", "left").select(F.coalesce("root", "id").alias("component"), "first")
    kept = grouped.groupBy("component").agg(F.min("first").alias("first")).select(F.struct("first.doc_id", "first.mark").alias("key"))
    rows = docs.select(whole_row(docs).alias("row"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), mark.alias("mark")).alias("key"))
    joined = rows.join(kept, "key")
    one = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0)))
    return joined.withColumn("_one", one).filter("_one = 1").select("row.*")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = durable(fingerprints(table(spark, sf_dir, "documents"), shingle=4))
    found = groups(prints, bits=64, radius=4)
    return found.select("doc_id", F.lower(F.hex("code")).alias("fingerprint"), "component_id")
