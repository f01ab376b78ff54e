import hashlib

import numpy as np

from fjordbook.llm import fingerprints as FP
from fjordbook.llm import words as W


def by_hand(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for (d, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        t, following = t or "", following or ""
        cut = len(t) // 3
        out.append((d, len(t), hashlib.sha256((t[:len(t) - cut] + following[:cut]).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, docs):
    return FP.edited_pairs(spark, docs).collect()


def test_edits_follow_the_next_document(spark, edges, documents):
    rows = [(r.doc_id, r.text) for r in edges.select("doc_id", "text").collect()]
    got = found(spark, edges)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == by_hand(rows)
    prints = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    for rows in ([(5, "only one document here")], [(None, "a b c d"), (None, "e f g h")], [(i, f"text {i} " * i) for i in range(300)]):
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in found(spark, documents(rows))), key=repr) == by_hand(rows)


def test_edited_texts_are_nearer_than_the_next(spark):
    rows = found(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert len(rows) == 1000 and np.mean([r.near_edited > r.near_next + 0.1 for r in rows]) > 0.97
    text = {r.doc_id: r for r in rows}
    assert text[5].n_chars == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id = 5").first().n_chars


def test_next_is_the_likeness_to_the_next_fingerprint(spark, documents):
    rows = [(i, " ".join(f"w{i * j % 53}" for j in range(200))) for i in range(30)]
    got = sorted(found(spark, documents(rows)), key=lambda r: -r.doc_id)
    bits = lambda r: int(r.fingerprint, 16)
    for a, b in zip(got, got[1:] + got[:1], strict=True):
        assert abs(a.near_next - (1 - (bits(a) ^ bits(b)).bit_count() / 256)) < 1e-12


def test_empty(spark, none):
    assert found(spark, none) == []


def test_block_tables_find_all_within_the_radius(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2, (60, 128))
    near = np.concatenate([base, base.copy(), base.copy()])
    for row in near[60:]:
        row[rng.choice(128, int(rng.integers(0, 7)), replace=False)] ^= 1
    codes = np.packbits(near.astype(np.uint8), axis=1).view(np.int64)
    df = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(codes)], "key long, code array<long>")
    got = {(r["query"], r["key"], r["distance"]) for r in FP.within_radius(df, df.filter("key % 3 = 0"), 5, bits=128).collect()}
    u = codes.view(np.uint64)
    far = np.bitwise_count(u[:, None, :] ^ u[None, :, :]).sum(2)
    assert got == {(i, j, int(far[i, j])) for i in range(0, 180, 3) for j in range(180) if far[i, j] <= 5}


def test_words_and_hashes_do_not_depend_on_the_buffer():
    texts = ["a bb\tccc\n", "", "  ", "x" * 3_000_000 + " y", "a bb ccc", "é\x0bü\x1cz"]
    data, offsets = W.joined([t.encode() for t in texts])
    starts, ends, first = W.spans(data, offsets)
    got = [[data[a:b].tobytes() for a, b in zip(starts[first[i]:first[i + 1]], ends[first[i]:first[i + 1]], strict=True)] for i in range(len(texts))]
    assert got == [t.encode().split() for t in texts]
    hashed = W.hashes(data, starts, ends)
    assert (hashed[first[0]:first[1]] == hashed[first[4]:first[5]]).all() and len(set(hashed.tolist())) == len({w for t in got for w in t})
    whole = FP.fingerprints(data, offsets, 128)
    for i, t in enumerate(texts):
        assert (FP.fingerprints(*W.joined([t.encode()]), 128)[0] == whole[i]).all()
