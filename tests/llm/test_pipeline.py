import pytest

import corpus_pipeline as P
from fjordbook.llm import lines, neardup, packing, quality
from fjordbook.session import durable

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [f.__name__ for _, f in P.STAGES] == ["good_quality", "without_boilerplate", "one_of_each", "mixed", "packed"]


@pytest.fixture(scope="module")
def results(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in P.STAGES:
        docs = durable(stage(spark, docs, SF))
        out.append(docs)
    return out


def test_columns_and_decisions(spark, results):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert all(r.columns == documents.columns for r in results[:-1])
    scores = {r.doc_id: r.predicted for r in quality.classify(documents, labels).collect()}
    assert {r.doc_id for r in results[0].collect()} == {d for d, p in scores.items() if p}
    cleaned = {r.doc_id: r.text for r in lines.without_boilerplate(results[0], results[0]["source"]).collect()}
    assert {r.doc_id: r.text for r in results[1].collect()} == cleaned
    assert all(r.n_chars == len(r.text) for r in results[1].collect())
    codes = [(r.doc_id, int.from_bytes(neardup.code_of((r.text or "").encode(), 5, 512), "big")) for r in results[2].collect()]
    assert len({d for d, _ in codes}) == len(codes) == len({c for _, c in codes})
    assert all((a ^ b).bit_count() > 40 for i, (_, a) in enumerate(codes) for _, b in codes[:i])
    assert {d for d, _ in codes} <= set(cleaned)


def test_packing_is_of_the_mix(results):
    mixed, packed = results[3].collect(), results[4].collect()
    assert sum(r.piece == 0 for r in packed) == len(mixed)
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed}
    assert len({r.sequence_id for r in packed}) == -(-sum(r.length for r in packed) // packing.LENGTH)


def test_run_gives_the_same(spark, results):
    key = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(P.run(spark, SF).collect()) == key(results[4].collect())


@pytest.mark.parametrize("kind", ["edges", "none"])
def test_every_stage_takes_awkward_documents(spark, kind, request):
    docs = request.getfixturevalue(kind)
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        stage(spark, docs, SF).collect()
    P.STAGES[-1][1](spark, docs, SF).collect()


def test_a_hot_group_of_copies_keeps_one_text(spark, documents):
    body = "\n".join(f"line {i} of the copied text with words of its own" for i in range(12))
    rows = [(i, body, "s") for i in range(13)] + [(100 + i, "\n".join(f"page {i} has line {j} for itself" for j in range(12)), "s") for i in range(26)]
    docs = durable(P.without_boilerplate(spark, documents(rows), SF))
    left = {r.doc_id: r.text for r in P.one_of_each(spark, docs, SF).collect()}
    assert left == {0: body} | {d: t for d, t, _ in rows[13:]}
