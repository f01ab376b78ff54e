import numpy as np
import pytest

from fjordbook.llm import mixing as M


def sizes(docs):
    return docs.select(*M.sized_columns())


def targets_by_hand(sums):
    """Reshare round by round until no source is above twice its size."""
    order = sorted(sums, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sums.values()), set(order), {}
    while free:
        rate = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * rate >= 2 * sums[s]]
        if not over:
            out |= {s: weight[s] * rate for s in free}
            break
        for s in over:
            out[s] = 2.0 * sums[s]
            left -= out[s]
            free.remove(s)
    return out


def check(rows):
    sums, taken, target = {}, {}, {}
    for r in rows:
        sums[r.source] = sums.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size and r.taken == sum(d.words for d in r.draws)
        for reading in (0, 1):  # a reading takes no word twice
            spans = sorted((d.start, d.start + d.words) for d in r.draws if d.reading == reading)
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)) and all(0 <= a and b <= r.size for a, b in spans)
    by_hand = targets_by_hand(sums)
    for s in sums:
        assert target[s] == pytest.approx(by_hand[s], rel=1e-9) and abs(taken[s] - target[s]) <= 0.5001
    return taken


def test_targets_and_draws(documents):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 400))), f"s{'ABCDEFG'[int(rng.integers(0, 7)) if i % 3 else 0]}") for i in range(400)]
    rows.append((400, "x " * 9000, "sB"))
    mixed = M.mix(sizes(documents(rows)))
    got = mixed.collect()
    assert len(got) == len(rows)
    check(got)
    again = M.mix(sizes(documents(rows).repartition(7))).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_shards_are_even_and_take_each_source_in_share(documents):
    rows = [(i, "w " * 300, "s" + "AB"[i % 2]) for i in range(300)]
    flat = M.shards_in_order(M.mix(sizes(documents(rows)), shards=8), shards=8).collect()
    words = {}
    for r in flat:
        words[r["shard"], r["source"]] = words.get((r["shard"], r["source"]), 0) + r["words"]
    per = {s: [words.get((i, s), 0) for i in range(8)] for s in ("sA", "sB")}
    assert min(per["sA"]) > 0 and min(per["sB"]) > 0
    totals = [per["sA"][i] + per["sB"][i] for i in range(8)]
    assert max(totals) - min(totals) < 0.2 * max(totals)


def test_splitting_tree_is_exact():
    rng = np.random.default_rng(0)
    colours, leaves = np.array([5, 0, 17, 100]), np.array([31, 31, 30, 30])
    dealt = M.split(colours, leaves, rng)
    assert (dealt.sum(1) == colours).all() and (dealt.sum(0) == leaves).all()
    mean = np.mean([M.split(colours, leaves, rng)[:, 0] for _ in range(2000)], axis=0)
    assert np.allclose(mean, colours * 31 / 122, atol=0.6)


def test_edges(edges):
    got = M.mix(sizes(edges)).collect()
    assert len(got) == 13
    check(got)
    assert all(r.size == 0 and r.taken == 0 for r in got if r.doc_id in (3, 4, 5))


def test_documents_of_the_mix(edges, none):
    rows = M.mixed_documents(edges)
    assert rows.columns == edges.columns
    sized = {}
    for r in M.mix(sizes(edges)).collect():
        sized[r.doc_id] = sized.get(r.doc_id, 0) + r.taken
    got = {}
    for r in rows.collect():
        assert r.n_chars == len(r.text) and r.text
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.encode().split())
    assert got == {k: v for k, v in sized.items() if v}
    assert M.mixed_documents(none).count() == 0 and M.mix(sizes(none)).count() == 0


def test_one_tiny_source(documents):
    check(M.mix(sizes(documents([(1, "a b c")]))).collect())
    check(M.mix(sizes(documents([(1, ""), (2, None)]))).collect())


def test_documents_are_drawn_and_cut_in_one_worker(spark, documents):
    docs = documents([(i, f"some words of text {i}", "ab"[i % 2]) for i in range(20)])
    plan = M.mixed_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
