import zlib

import numpy as np

from fjordbook.llm import quality as Q
from fjordbook.llm import words as W

SF = "/root/testdata/sf0.01"


def test_held_out_documents_are_told_apart(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r for r in Q.classify(docs, labels).collect()}
    assert len(rows) == docs.count()
    held = [(rows[r.doc_id].score, rows[r.doc_id].predicted, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(p == y for _, p, y in held) / len(held) > 0.95
    good, bad = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in rows.items())
    again = {r.doc_id: r.score for r in Q.classify(docs.repartition(5), labels.repartition(3)).collect()}
    assert again == {d: r.score for d, r in rows.items()}


def test_held_out_labels_change_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) as quality")
    a, b = ({r.doc_id: r.score for r in Q.classify(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_edges(spark, edges, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (6, None), (None, 1), (7, 5)], "doc_id long, quality int")
    rows = Q.classify(edges, labels).collect()
    assert len(rows) == 13 and all(0 < r.score < 1 for r in rows)
    empty = labels.limit(0)
    assert {r.score for r in Q.classify(edges, empty).collect()} == {0.5}
    assert Q.classify(none, labels).count() == 0
    scored = Q.scored(edges, Q.train(edges, labels)).select("row.*")
    assert scored.columns == edges.columns


def test_statistics_by_hand():
    texts = [b"Ab cd cd. EF!! x|y 12", b"", b"\n\n", "é é\nline\nline".encode()]
    x = dict(zip(Q.NAMES, Q.statistics(*W.joined(texts)).T, strict=True))
    assert np.allclose(x["log_words"], np.log1p([6, 0, 0, 4])) and np.allclose(x["word_bytes"][0], 16 / 6)
    assert np.allclose(x["distinct_words"], [1, 0, 0, 2 / 4]) and np.allclose(x["repeated_words"], [0, 0, 0, 2 / 4])
    assert np.allclose(x["words_all_upper"][0], 1 / 6) and np.allclose(x["words_without_letter"][0], 1 / 6)
    assert np.allclose(x["distinct_lines"], [1, 0, 1 / 2, 2 / 3]) and np.allclose(x["top_word"][3], 2 / 4)


def test_flat_trees_equal_a_walk_of_each():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = Q.fit(x, y)
    def walk(row):
        total = trees.start
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.cut[node] else trees.right[node]
            total += trees.value[node]
        return 1 / (1 + np.exp(-total))
    got = trees.score(x)
    assert np.allclose(got[:50], [walk(r) for r in x[:50]]) and ((got > 0.5) == y).mean() > 0.97
    assert len(set(Q.fit(x, np.ones(800)).score(x))) == 1 and len(Q.fit(x[:0], y[:0]).score(x)) == 800
