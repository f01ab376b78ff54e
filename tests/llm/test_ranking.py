import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from fjordbook.llm import ranking as R

PLAIN = re.compile(R.PATTERN)


def cut(text):
    return [t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in PLAIN.findall(text or "")]


def brute(docs, items, k=20):
    """Every score of every pair, from counted terms."""
    bags = [(d, Counter(cut(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for d, b, n in bags:
            m = 75 + (25 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 12 * m)) for t in cut(text) if t in b)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def found(spark, docs, items, k=20):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in R.best_documents(*frames(spark, docs, items), k).collect()), key=repr)


@pytest.fixture
def corpus():
    r = random.Random(5)
    words = [f"W{i}" if i % 3 else f"ö{i}é" for i in range(300)]
    share = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ,".join(r.choices(words, share, k=r.randrange(1, 200)))) for i in range(900)]
    docs += [(1000 + i, docs[7][1]) for i in range(300)]  # a hot group of copies, all tied
    items = [(i, "; ".join(r.choices(words, k=r.randrange(1, 12)) + r.choices(words, share, k=r.randrange(6)))) for i in range(25)]
    return docs, [*items, (90, docs[7][1])]


def test_against_all_scores(spark, corpus):
    assert found(spark, *corpus) == brute(*corpus)


def test_small_lists_windows_and_blocks(spark, corpus, monkeypatch):
    """Many short windows, nearly nothing summed beforehand, several blocks of items."""
    for name, value in {"LISTS": 4000, "SUMMED": 30, "SPAN": 64, "SKIP": 8, "BLOCK": 60, "CHUNK": 5000}.items():
        monkeypatch.setattr(R, name, value)
    assert found(spark, *corpus, k=7) == brute(*corpus, k=7)


def test_search_skips_and_stops():
    rng = np.random.default_rng(2)
    for _ in range(60):
        lists = []
        for _ in range(rng.integers(1, 7)):
            docs = np.sort(rng.choice(30_000, rng.integers(1, 9000), replace=False))
            lists.append(R.Postings(docs, rng.integers(0, rng.choice([3, 1000, 10**9]), len(docs))))
        sums = np.zeros(30_000, np.int64)
        for p in lists:
            sums[p.docs] += p.scores
        want = [d for d in np.lexsort([np.arange(30_000), -sums])[:20] if sums[d] > 0]
        docs, scores = R.search(lists, 30_000, 20, 0)
        assert docs.tolist() == want and scores.tolist() == sums[want].tolist()
        floor = int(scores[len(scores) // 2])
        high, _ = R.search(lists, 30_000, 20, floor)
        assert set(high.tolist()) >= {d for d in want if sums[d] > floor}


def test_edges(spark, edges):
    docs = [(r.doc_id, r.text) for r in edges.select("doc_id", "text").collect()]
    items = [(1, "ÜNÏCODE copied3 copied3 日本"), (1, "one TWO under"), (2, None), (3, ""), (4, "nowhere"), (None, "word7x7 text"), (5, "copied1 copied2"), (5, "copied1 copied2")]
    got = R.best_documents(edges, frames(spark, [], items)[1]).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=repr) == brute(docs, items)


def test_empty(spark, none):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == [] and found(spark, [(1, " ,")], [(1, "a")]) == []
    assert R.best_documents(none, frames(spark, [], [(1, "a")])[1]).columns == ["item_id", "rank", "doc_id", "score"]


def test_terms_are_cut_like_the_pattern():
    texts = ["A1b-c_d", "", " é\x80x\x7fÅ ", "日本,語", "z"]
    got, first = R.terms(*R.W.joined([t.encode() for t in texts]))
    assert [[b.decode() for b in got[a:b].to_pylist()] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)] == [cut(t) for t in texts]


def test_long_lengths_do_not_overflow():
    n = np.array([1, 10**9])
    assert R.length_norms(n, 10**11, 10**12).tolist() == [75 + (25 * int(x) * 10**11) // 10**12 for x in n]
