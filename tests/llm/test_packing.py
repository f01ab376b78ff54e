import random
import zlib
from bisect import bisect_left, insort

import numpy as np

from fjordbook.llm import packing as P
from fjordbook.llm import tokens

VOCABULARY = tokens.vocabulary_path()


def pieces_by_hand(rows, length):
    encode = tokens.encoder(VOCABULARY).tokenizer.encode
    out = []
    for doc_id, text in rows:
        ids = [*encode(text or "", add_special_tokens=False).ids, 0]
        head = len(ids) - (-(-len(ids) // length) - 1) * length
        cuts = [0, *range(head, len(ids) + 1, length)]
        out += [(doc_id, j, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return out


def check(rows, length):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by_sequence.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= length
    return len(by_sequence)


def test_pieces_and_places(edges, none):
    packed = P.pack(P.durable(P.pieces(edges, VOCABULARY))).collect()
    rows = [(r.doc_id, r.text) for r in edges.select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed), key=repr) == sorted(pieces_by_hand(rows, 2048), key=repr)
    bins = check(packed, 2048)
    assert bins == -(-sum(r.length for r in packed) // 2048)
    assert P.pack(P.durable(P.pieces(none, VOCABULARY))).count() == 0


def test_whole_table_needs_no_more_than_the_bound(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    packed = P.pack(P.durable(P.pieces(docs, VOCABULARY))).collect()
    assert check(packed, 2048) == -(-sum(r.length for r in packed) // 2048)


def test_sequences_hold_the_ids(documents):
    rows = [(i, "some words here " * (i * 7 % 40)) for i in range(30)]
    cut = P.durable(P.pieces(documents(rows), VOCABULARY, 64, ids=True))
    packed = P.pack(cut, 64)
    whole = {r.sequence_id: r.ids for r in P.sequences(packed, length=64).collect()}
    assert all(len(ids) == 64 for ids in whole.values())
    for r in packed.collect():
        part = whole[r.sequence_id][r.offset:r.offset + r.length]
        assert part == r.ids and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32


def fewest(items, length):
    """The optimum by trying every placement."""
    best = [len(items)]
    def place(i, spaces):
        if len(spaces) >= best[0]:
            return
        if i == len(items):
            best[0] = len(spaces)
            return
        for j, s in enumerate(spaces):
            if s >= items[i] and s not in spaces[:j]:
                place(i + 1, [*spaces[:j], s - items[i], *spaces[j + 1:]])
        place(i + 1, [*spaces, length - items[i]])
    place(0, [])
    return best[0]


def test_counts_are_packed_whole_and_well():
    for seed in range(60):
        r = random.Random(seed)
        length, counts = r.choice([10, 50, 100]), {}
        for _ in range(r.choice([5, 9, 40])):
            n = r.randint(1, length)
            counts[n] = counts.get(n, 0) + 1
        found, used = P.pack_counts(counts, length), {}
        for filling, times in found:
            assert sum(n * k for n, k in filling) <= length
            for n, k in filling:
                used[n] = used.get(n, 0) + k * times
        assert used == counts
        items, spaces = sorted((n for n, k in counts.items() for _ in range(k)), reverse=True), []
        for n in items:  # best-fit decreasing, a piece at a time
            i = bisect_left(spaces, n)
            insort(spaces, (spaces.pop(i) if i < len(spaces) else length) - n)
        assert sum(t for _, t in P.best_fit(counts, length)) == len(spaces)
        bins = sum(t for _, t in found)
        assert bins <= len(spaces)
        if len(items) <= 9:
            assert bins == fewest(items, length)


def test_bin_completion_beats_best_fit():
    counts = {n: 1 for n in (4, 5, 7, 6, 3)} | {8: 1, 2: 1}  # 35 of 5 * 10: best-fit needs what the bound allows or more
    hard = {60: 1, 50: 1, 30: 2, 20: 2, 40: 1, 10: 5}
    for c, length in ((counts, 10), (hard, 100)):
        assert sum(t for _, t in P.pack_counts(c, length)) == fewest(sorted((n for n, k in c.items() for _ in range(k)), reverse=True), length)


def test_huge_counts_stay_small_work():
    rng = np.random.default_rng(1)
    counts = {int(n): int(rng.integers(1, 10**9)) for n in range(1, 2048)}
    found = P.pack_counts(counts)
    assert len(found) < 10_000
    assert sum(t for _, t in found) <= 1.02 * sum(n * c for n, c in counts.items()) / 2048


def test_a_wasteful_tail_is_repacked_behind_many_full_sequences():
    for seed in (65, 88, 1323):
        r, counts = random.Random(seed), {}
        pieces = [x for _ in range(300) for a in [r.randint(510, 560)] for x in (a, 1000 - a)]
        for n in pieces + [r.randint(120, 400) for _ in range(r.randint(9, 14))]:
            counts[n] = counts.get(n, 0) + 1
        least = -(-sum(n * c for n, c in counts.items()) // 1000)
        wasted = [1000 - sum(n * k for n, k in filling) for filling, _ in P.best_fit(counts, 1000)]
        assert wasted == sorted(wasted)
        assert sum(t for _, t in P.best_fit(counts, 1000)) == least + 1
        assert sum(t for _, t in P.pack_counts(counts, 1000)) == least
