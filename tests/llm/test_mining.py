import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fjordbook.llm import mining as M


def brute(rows, every=10, scale=256, n_pos=5, n_neg=5, least=80, most=100):
    """All scores of all pairs in Python's own integers."""
    kept = [(i, lab, [math.floor(scale * x) for x in v]) for i, v, lab in rows]
    out = []
    for a, lab, v in kept:
        if a % every:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, m) for i, m, w in kept if i != a]
        positives = sorted((s, i) for s, i, m in scores if m == lab)[:n_pos]
        for s, p in positives:
            inside = sorted((t, i) for t, i, m in scores if m != lab and least * -s <= 100 * -t <= most * -s)[:n_neg]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(inside)]
    return sorted(out)


def run(spark, rows, every=10, **how):
    frame = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, 1) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, score int")
    found = M.mined(frame, F.col("id") % every == 0, F.col("label"), **how).collect()
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found)


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 40, 35), (65, 129, 64), (100, 37, 71), (130, 200, 96), (5, 300, 64)])
def test_recursion_equals_the_plain_product(shape):
    m, n, d = shape
    rng = np.random.default_rng(m)
    a, b = rng.integers(-(1 << 26), 1 << 26, (m, d)), rng.integers(-(1 << 26), 1 << 26, (n, d))
    want = a.astype(object) @ b.T.astype(object)
    assert (M.product(a, b) == want).all()


def test_deep_recursion(monkeypatch):
    monkeypatch.setattr(M, "LEAF", 2)
    rng = np.random.default_rng(1)
    for m, n, d in ((3, 3, 3), (17, 9, 11), (31, 64, 13)):
        a, b = rng.integers(-500, 500, (m, d)), rng.integers(-500, 500, (n, d))
        assert (M.product(a, b) == a @ b.T).all()


def test_against_all_pairs(spark, monkeypatch):
    """Several blocks and tiles, a hot label, a hot group of equal vectors, many ties."""
    for name, value in {"ANCHORS": 16, "ROWS": 100, "TILE_ANCHORS": 7, "TILE_ROWS": 40, "LEAF": 3}.items():
        monkeypatch.setattr(M, name, value)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6)) / 8
    x[100:230] = x[100]
    labels = np.where(rng.random(400) < 0.4, 0, rng.integers(1, 6, 400))
    rows = [(i, x[i].tolist(), int(labels[i])) for i in range(400)]
    assert run(spark, rows) == brute(rows)
    narrow = {"positives": 3, "negatives": 2, "least": 95, "most": 99}
    assert run(spark, rows, **narrow) == brute(rows, n_pos=3, n_neg=2, least=95, most=99)


def test_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1, 0], 1), (1, [1, 0.5], 1), (2, [0.9, 0.1], 2), (3, [0.95, 0], 2), (10, [-1, 0], 1), (11, [0, 0], 3)]
    bad = [(4, None, 1), (5, [nan, 1], 2), (6, [inf, 1], 2), (7, [None, 1], 2), (8, [1, 0], None), (9, [1, 2, 3], 2), (None, [1, 0], 2), (12, [], 2), (20, [1e300, 0], 1)]
    assert run(spark, good + bad) == brute(good) != []


def test_repeated_rows(spark):
    rows = [(0, [1, 0], 1), (0, [1, 0], 1), (1, [1, 0], 1), (1, [1, 0], 1), (2, [0.9, 0], 2), (2, [0.9, 0], 2)]
    assert run(spark, rows) == brute(rows)


def test_few_and_none(spark):
    assert run(spark, []) == [] and run(spark, [(0, [1.0], 1)]) == [] and run(spark, [(0, [1.0], 1), (1, [1.0], 2)]) == []


def test_large_components_stay_exact(spark):
    big = float(1 << 21)
    rows = [(0, [big, 1], 1), (1, [big, 3], 1), (2, [big - 1, 1], 2), (3, [big * 0.9, 1], 2)]
    assert run(spark, rows) == brute(rows)
