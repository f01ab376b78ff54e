import hashlib
import random

import numpy as np
import pytest

from fjordbook.llm import induced as I
from fjordbook.llm import suffixdedup as S


def brute(rows, k=50):
    """Removed bytes by comparing every window with every other document's."""
    cut = [((d is None, d or 0), (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in cut:
        for i in range(len(b) - k + 1):
            key = b[i:i + k]
            first[key] = min(first.get(key, d), d)
    out = []
    for (d, b), (doc_id, _) in zip(cut, rows, strict=True):
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - k + 1):
            source = first[b[i:i + k]]
            if source < d and not (source[0] and d[0]):
                gone[i + 1:i + k + 1] = True
        left = bytes(x for x, g in zip(b, gone[1:-1], strict=True) if not g)
        out.append((doc_id, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def found(df, k=50, m=24, **how):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.deduplicated(df, k, m, **how).collect()), key=repr)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeé日", k=r.randrange(1, 9)))
    words = [word() for _ in range(200)]
    text = lambda n: " ".join(r.choices(words, k=n))
    passages = [text(n) for n in (9, 15, 40, 120)]
    rows = []
    for d in range(150):
        parts = [text(r.randrange(60)) for _ in range(3)]
        parts.insert(r.randrange(4), r.choice(passages))
        if d % 3 == 0:
            parts.insert(r.randrange(4), passages[1])  # one passage in a third of all documents
        rows.append((d * 7 % 150, "".join(parts)))
    rows += [(500 + i, rows[i][1]) for i in range(12)]
    rows += [(600 + i, "-" * (49 + i) + "=" * 700 * (i % 2) + "ab" * 40 * i) for i in range(6)]
    return rows


def test_against_brute_force(documents):
    rows = corpus(3)
    assert found(documents(rows)) == brute(rows)


def test_small_budgets_recursion_and_other_lengths(documents):
    """Queues that spill at once, recursion down to the end, passages cut short."""
    rows = corpus(4)[:90]
    assert found(documents(rows), memory=50, names=10) == brute(rows)
    assert found(documents(rows), 20, 8) == brute(rows, 20)


def test_edges(edges):
    rows = [(r.doc_id, r.text) for r in edges.select("doc_id", "text").collect()]
    assert found(edges) == brute(rows)


def test_largest_id_and_many_rows_without_one(documents):
    copy = "a passage that is longer than fifty bytes, so that it counts as one"
    rows = [((1 << 63) - 1, copy), (-(1 << 63), copy + "x"), (0, "y" + copy)] + [(None, copy)] * 40 + [(None, f"{i}{copy}") for i in range(40)]
    assert found(documents(rows)) == brute(rows)
    alone = [(None, copy)] * 5 + [((1 << 63) - 1, "z" + copy)]
    assert found(documents(alone)) == brute(alone)


def test_spans_and_what_is_kept(documents):
    text = "".join(chr(97 + i * i % 23) for i in range(120))
    rows = {r.doc_id: r for r in S.deduplicated(documents([(1, "AB" + text), (2, "XYZ" + text + "end"), (3, "ok")])).collect()}
    assert [tuple(s) for s in rows[2].spans] == [(3, 120)] and bytes(rows[2].kept) == b"XYZend"
    assert rows[1].spans == [] and rows[1].kept is None and rows[3].kept is None


def test_empty(none):
    assert S.deduplicated(none).count() == 0


@pytest.mark.parametrize("memory, names", [(1 << 20, 1 << 20), (3, 1 << 20), (5, 0)])
def test_order_and_shared_prefixes(memory, names):
    """Suffixes and what neighbours share against plain sorting, with and without spilling and recursion."""
    r = random.Random(names + memory)
    for _ in range(60):
        top = r.choice([1, 2, 5, 250])
        base, symbols = [r.randint(1, top) for _ in range(60)], []
        for _ in range(r.randint(1, 8)):
            a = r.randrange(50)
            symbols += (base[a:a + r.randint(1, 40)] if r.random() < 0.5 else [r.randint(1, top) for _ in range(r.randint(0, 30))]) + [0]
        text = {i: tuple(symbols[i:symbols.index(0, i)]) for i, s in enumerate(symbols) if s}
        got = list(I.ordered(np.array(symbols, np.uint16), 10, memory, names))
        places = [p for g in got for p in g[0].tolist()]
        assert sorted(places) == sorted(text) and [text[p] for p in places] == sorted(text.values(), reverse=True)
        share = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert [c for g in got for c in g[1].tolist()][1:] == [min(10, share(text[a], text[b])) for a, b in zip(places, places[1:], strict=False)]


def test_queue_spills_and_keeps_order():
    q = I.Queue(4, False, np.dtype(np.int32))
    for i in range(6):
        q.push(np.array([1, 2, 2]), np.array([i, 10 * i, 10 * i + 1]), np.array([i, i, i], np.int16))
    assert q.spilled
    out = {}
    while q.first() is not None:
        s = q.first()
        places, common = q.pop()
        out.setdefault(s, []).extend(zip(places.tolist(), common.tolist(), strict=True))
    assert out == {1: [(i, i) for i in range(6)], 2: [(10 * i + j, i) for i in range(6) for j in (0, 1)]}
    q.close()


def test_group_hashes():
    data = np.random.default_rng(1).integers(0, 3, 400).astype(np.uint8)
    for m in (1, 2, 3, 8, 24):
        h = S.group_hashes(data, m)
        assert len(h) == 400 - m + 1
        same = {}
        for i, x in enumerate(h.tolist()):
            assert same.setdefault(data[i:i + m].tobytes(), x) == x
        assert len(set(same.values())) == len(same)
    assert len(S.group_hashes(data[:5], 24)) == 0
