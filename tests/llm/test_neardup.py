import numpy as np
import pytest
import xxhash

from fjordbook.llm import components as C
from fjordbook.llm import neardup as N


def code(text, k):
    """The fingerprint a bit at a time."""
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(codes, near):
    """Components by comparing all pairs."""
    root = list(range(len(codes)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(codes)):
        for j in range(i):
            if near(codes[i], codes[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(codes))]


def op5(docs):
    prints = N.fingerprints(docs, 4)
    return N.groups(N.durable(prints), 64, 4).collect()


def test_fingerprints_and_components(edges):
    rows = [(r.doc_id, r.text) for r in edges.select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.code.hex(), r.component_id) for r in op5(edges)), key=repr)
    codes = [code(t, 4) for _, t in rows]
    roots = classes(codes, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (d, _), r in zip(rows, roots, strict=True):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    assert got == sorted(((d, f"{c:016x}", least.get(r)) for (d, _), c, r in zip(rows, codes, roots, strict=True)), key=repr)


def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    codes = [code(t, 4) for _, t in rows]
    roots = classes(codes, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (d, _), r in zip(rows, roots, strict=True):
        least[r] = min(least.get(r, d), d)
    got = {r.doc_id: (r.code.hex(), r.component_id) for r in op5(docs)}
    assert got == {d: (f"{c:016x}", least[r]) for (d, _), c, r in zip(rows, codes, roots, strict=True)}


def near_codes(rng, n, bits):
    base = rng.integers(0, 2, (n // 6, bits))
    rows = [b for b in base]
    while len(rows) < n:
        b = rows[int(rng.integers(len(rows)))].copy()
        b[rng.choice(bits, int(rng.integers(1, 7)), replace=False)] ^= 1
        rows.append(b)
    return np.unique(np.packbits(np.array(rows, np.uint8), axis=1), axis=0)


@pytest.mark.parametrize("radius", [2, 4])
@pytest.mark.parametrize("variants", [10**7, 20_000])
def test_links_reach_all_pairs_within_the_radius(spark, radius, variants):
    codes = near_codes(np.random.default_rng(radius), 300, 64)
    df = spark.createDataFrame([(i, bytearray(c.tobytes())) for i, c in enumerate(codes)], "id long, code binary")
    links = N.links(df, len(codes), 64, radius, variants=variants)
    roots = {r.node: r.root for r in C.components(links).collect()}
    expected = classes([int.from_bytes(c.tobytes(), "big") for c in codes], lambda a, b: (a ^ b).bit_count() <= radius)
    mine = [roots.get(i, i) for i in range(len(codes))]
    pairs = lambda x: {frozenset(i for i in range(len(x)) if x[i] == k) for k in set(x)}
    assert pairs(mine) == pairs(expected)
    assert all(r == min(i for i in range(len(mine)) if mine[i] == r) for r in set(mine))


def test_blocks_hold_pairs_to_the_limit(spark):
    codes = near_codes(np.random.default_rng(5), 300, 64)
    df = spark.createDataFrame([(i, bytearray(c.tobytes())) for i, c in enumerate(codes)], "id long, code binary")
    links = N.links(df, len(codes), 64, 2, blocks=4, width=16, limit=9)
    numbers = [int.from_bytes(c.tobytes(), "big") for c in codes]
    def near(a, b):
        d = a ^ b
        return d.bit_count() <= 9 and any((d >> 16 * i & 0xFFFF).bit_count() <= 2 for i in range(4))
    roots = {r.node: r.root for r in C.components(links).collect()}
    mine, expected = [roots.get(i, i) for i in range(len(codes))], classes(numbers, near)
    pairs = lambda x: {frozenset(i for i in range(len(x)) if x[i] == k) for k in set(x)}
    assert pairs(mine) == pairs(expected)


def test_a_prefix_at_a_time_finds_the_same(monkeypatch):
    codes = near_codes(np.random.default_rng(8), 300, 64)
    values, raw = N.block_values(codes, 0, 64), codes.view(np.uint64)
    whole = N.meetings(values, 0, 0, 64, 2, raw, 4)
    for formed in (10**9, 100_000, 3000):
        monkeypatch.setattr(N, "FORMED", formed)
        assert (N.all_meetings(values, 0, 0, 64, 2, raw, 4) == whole).all()


def test_components_of_long_and_hot_graphs(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (None, 3), (1500, 1600), (1600, 1500)]
    roots = {r.node: r.root for r in C.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {roots[i] for i in range(201)} == {0} and {roots[1000 + i] for i in range(300)} == {1000} and roots[1600] == 1500 and len(roots) == 503
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_document_of_each_group(documents, edges, none):
    words = [f"w{i}" for i in range(300)]
    other = [*words[:150], "changed", *words[151:]]
    rows = [(3, " ".join(words)), (1, " ".join(other)), (2, " ".join(words)), (2, " ".join(words)), (9, " ".join(f"v{i}" for i in range(300))), (4, None), (5, "")]
    assert sorted(r.doc_id for r in N.deduplicated(documents(rows)).collect()) == [1, 4, 9]
    kept = N.deduplicated(edges)
    assert kept.columns == edges.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 3, 6, 7, 8]
    assert N.deduplicated(none).count() == 0


def shingle_set(text, k=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def kept_by_all_pairs(rows):
    sets = [shingle_set(t) for _, t in rows]
    roots = classes(sets, similar)
    return sorted(min(d for (d, _), r in zip(rows, roots, strict=True) if r == root) for root in set(roots))


def edited(rng, words, n, name):
    out = list(words)
    for i in rng.choice(len(words), n, replace=False):
        out[i] = f"{name}x{i}"
    return " ".join(out)


@pytest.mark.parametrize("part_rows", [128, 7])
def test_groups_are_those_of_all_pairs(documents, monkeypatch, part_rows):
    """Pairs just above 0.8 are all found, and pairs from 0.7 to below 0.8 are not linked."""
    monkeypatch.setattr(N, "PART_ROWS", part_rows)
    rng, rows = np.random.default_rng(4), []
    for group in range(60):
        words = [f"g{group}w{i}" for i in range(300)]
        rows.append((len(rows), " ".join(words)))
        rows += [(len(rows) + j, edited(rng, words, int(n), f"e{group}v{j}")) for j, n in enumerate(rng.integers(2, 22, 3))]
    words = [f"hot{i}" for i in range(200)]
    rows += [(len(rows) + j, edited(rng, words, int(n), f"h{j}")) for j, n in enumerate(rng.integers(0, 12, 60))]
    sets = [shingle_set(t) for _, t in rows]
    share = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]]
    assert sum(0.8 <= s < 0.82 for s in share) > 10 and sum(0.7 <= s < 0.8 for s in share) > 50
    assert sorted(r.doc_id for r in N.deduplicated(documents(rows)).collect()) == kept_by_all_pairs(rows)


def test_documents_of_a_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in N.deduplicated(docs).collect()) == kept_by_all_pairs(rows)
