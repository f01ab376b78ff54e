import hashlib
import random

import numpy as np

from fjordbook.llm import substrings as S


def brute(rows, k=13):
    """Removed words by comparing every window with every other document's."""
    first = {}
    cut = [(d if d is not None else S.LAST, (t or "").encode().split()) for d, t in rows]
    for d, w in cut:
        for i in range(len(w) - k + 1):
            key = tuple(w[i:i + k])
            first[key] = min(first.get(key, d), d)
    out = []
    for (d, w), (doc_id, _) in zip(cut, rows, strict=True):
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i:i + k])] < d:
                gone |= set(range(i, i + k))
        left = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc_id, len(w), len(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return sorted(out, key=repr)


def found(df, k=13):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in S.deduplicated(df, k).collect()), key=repr)


def test_against_brute_force(documents):
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    passages = [" ".join(r.choices(words, k=r.choice([13, 14, 30, 80]))) for _ in range(6)]
    rows = []
    for d in range(120):
        parts = [" ".join(r.choices(words, k=r.randrange(40))) for _ in range(3)]
        parts.insert(r.randrange(4), r.choice(passages))
        if d % 3 == 0:
            parts.insert(r.randrange(4), passages[0])  # one passage in a third of all documents
        rows.append((d, "\n".join(parts)))
    rows += [(500 + i, rows[i][1]) for i in range(10)]
    assert found(documents(rows)) == brute(rows)
    few = [(d, " ".join(r.choices("ab", k=60))) for d in range(20)]  # all windows common, many within one document
    assert found(documents(few)) == brute(few)
    assert found(documents(few), 5) == brute(few, 5) if S.GROUP <= 5 else True


def test_edges(edges):
    rows = [(r.doc_id, r.text) for r in edges.select("doc_id", "text").collect()]
    assert found(edges) == brute(rows)


def test_spans_lead_to_their_source(documents):
    text = " ".join(f"p{i}" for i in range(100))
    rows = S.deduplicated(documents([(1, "a b " + text), (2, "x " + text + " y"), (3, text)])).collect()
    by_id = {r.doc_id: r for r in rows}
    assert [tuple(s) for s in by_id[2].spans] == [(1, 100, 1, 2)] and [tuple(s) for s in by_id[3].spans] == [(0, 100, 1, 2)]
    assert by_id[2].kept == "x y" and by_id[1].spans == []


def test_empty(none):
    assert S.deduplicated(none).count() == 0


def test_minima():
    v = np.random.default_rng(1).integers(0, 9, 200)
    for width in (1, 2, 3, 5, 8):
        assert S.minima(v, width).tolist() == [i + int(v[i:i + width].argmin()) for i in range(len(v) - width + 1)]
    assert len(S.minima(v[:3], 8)) == 0
