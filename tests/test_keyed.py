import random

import pytest
from pyspark.sql import functions as F

from fjordbook.operators import keyed as K


@pytest.fixture(scope="module")
def hot(spark):
    """A third of all rows have one key, some have none; figures tie, numbers do not."""
    r = random.Random(6)
    rows = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{r.randrange(60)}", r.choice([None, *range(40)])) for i in range(6000)]
    return spark.createDataFrame(rows, "n long, key string, x long").repartition(5).cache()


def order():
    return [F.desc_nulls_last("x"), F.asc("n")]


def ranks(df):
    return sorted((r.n, r.nr) for r in df.collect())


def expected(hot):
    by_key = {}
    for r in hot.collect():
        by_key.setdefault(r.key, []).append(((r.x is None, -(r.x or 0), r.n), r.n))
    return sorted((n, i + 1) for rows in by_key.values() for i, (_, n) in enumerate(sorted(rows)))


def test_ranks_by_ranges_equal_those_of_a_window(hot):
    want = expected(hot)
    assert ranks(K.ranked_within(hot, ["key"], order(), "nr", parts=40)) == want
    assert ranks(K.ranked_per_key(hot, ["key"], order(), "nr", one_task=10)) == want == ranks(K.top_per_key(hot, ["key"], order(), rank="nr", spread=True))
    assert K.ranked_within(hot, ["key"], order(), "nr").columns == ["n", "key", "x", "nr"]
    assert ranks(K.ranked_within(hot.limit(0), ["key"], order(), "nr")) == [] == ranks(K.ranked_per_key(hot.limit(0), ["key"], order(), "nr"))


def test_no_task_gets_a_hot_key(spark, hot, monkeypatch):
    """Forty ranges of six thousand rows: none holds more than a twentieth, though a third have one key."""
    stored = []
    monkeypatch.setattr(K, "durable", lambda df, _d=K.durable: stored.append(_d(df)) or stored[-1])
    K.ranked_within(hot, ["key"], order(), "nr", parts=40)
    sizes = [r["count"] for r in stored[0].groupBy(F.shiftright("_id", 33)).count().collect()]
    assert sum(sizes) == 6000 and max(sizes) <= 300
    assert stored[0].filter("key = 'hot'").select(F.shiftright("_id", 33)).distinct().count() > 8
