import numpy as np
import pytest
from pyspark.sql import functions as F

from fjordbook.llm import ann


def frame(spark, rows):
    return spark.createDataFrame([(int(i) if i is not None else None, [None if x is None else float(x) for x in v] if v is not None else None, 1) for i, v in rows], "vec_id long, embedding array<float>, code int")


def run(spark, rows, k=10, every=10):
    return ann.neighbours(ann.vectors(frame(spark, rows)), F.col("id") % every == 0, k).collect()


def exact(rows, q, k):
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    ids = np.array([i for i, _ in rows])
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
    order = [j for j in np.lexsort([ids, d]) if ids[j] != q][:k]
    return [(int(ids[j]), d[j]) for j in order]


@pytest.mark.parametrize("shape", ["spread", "clusters", "hot"])
def test_recall_and_order(spark, shape):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 32))
    if shape == "clusters":
        x = x[rng.integers(0, 30, 1500)] + 0.05 * x
    if shape == "hot":
        x[:500] = x[0] + 0.01 * x[:500]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    got = {}
    for r in run(spark, rows):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 10))
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        truth = exact(rows, q, 10)
        score = dict(exact(rows, q, 1500))
        assert all(abs(score[v] - s) < 1e-12 for _, v, s in found)
        hits += len({v for v, _ in truth} & {v for _, v, _ in found})
    assert hits / (10 * len(got)) >= 0.9


def test_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0]), (1, [1, 0]), (2, [1, 0]), (3, None), (4, [0, 0]), (5, [nan, 1]), (6, [inf, 1]), (7, [None, 1]), (8, [1, 2, 3]), (None, [1, 1]), (10, [0, 1]), (11, []), (1, [1, 0])]
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in run(spark, rows))
    assert got == [(0, 1, 1, 0.0), (0, 2, 1, 0.0), (0, 3, 2, 0.0), (0, 4, 10, 1.414214), (10, 1, 0, 1.414214), (10, 2, 1, 1.414214), (10, 3, 1, 1.414214), (10, 4, 2, 1.414214)]


def test_few_and_none(spark):
    assert run(spark, []) == [] and run(spark, [(0, [1.0])]) == []
    assert [(r.vec_id, r.score) for r in run(spark, [(0, [1.0]), (3, [3.0])])] == [(3, 2.0)]


def test_probing_finds_every_code_within_the_radius(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    coder = ann.fit(x.astype(np.float64), 5)
    rows = ann.durable(ann.coded(ann.vectors(frame(spark, list(enumerate(x.tolist())))), coder))
    codes = coder.codes(x.astype(np.float64))
    rows_limit, ann.ROWS = ann.ROWS, 40
    try:
        for radius in (0, 6, 13, 30):
            got = {(r.query_id, r.vec_id) for r in ann.nearest(rows, rows.filter("id % 20 = 0"), 1000, radius, 400).collect()}
            want = {(q, v) for q in range(0, 400, 20) for v in range(400) if v != q and int(codes[q] ^ codes[v]).bit_count() <= radius}
            assert got == want
    finally:
        ann.ROWS = rows_limit


def test_double_vectors_keep_their_digits(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 8)) * 1e3 + rng.random((300, 8)) * 1e-9
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, vector int")
    for r in ann.neighbours(ann.vectors(rows), F.col("id") % 10 == 0).collect():
        assert r.score == np.sqrt(((x[r.vec_id] - x[r.query_id]) ** 2).sum())
