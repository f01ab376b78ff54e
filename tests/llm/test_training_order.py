import numpy as np
import pytest

from fjordbook.llm import feistel, tokens
from fjordbook.llm import training_order as O

VOCABULARY = tokens.vocabulary_path()


def expected(rows, length):
    encode = tokens.encoder(VOCABULARY).tokenizer.encode
    out = []
    for doc_id, text in rows:
        ids = [*encode(text or "", add_special_tokens=False).ids, 0]
        head = len(ids) - (-(-len(ids) // length) - 1) * length
        cuts = [0, *range(head, len(ids) + 1, length)]
        out += [(doc_id, j, tuple(ids[a:b])) for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shards", [1, 5])
def test_every_sequence_has_one_slot(spark, edges, tmp_path, shards):
    O.write_shards(edges, f"{tmp_path}/a", VOCABULARY, 64, shards=shards)
    rows = O.read_shards(spark, f"{tmp_path}/a", 64).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    texts = [(r.doc_id, r.text) for r in edges.select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, r.piece, tuple(r.ids)) for r in rows), key=repr) == expected(texts, 64)
    part = O.read_shards(spark, f"{tmp_path}/a", 64, start=37, stop=61).collect()
    whole = {r.slot: r for r in rows}
    assert sorted(r.slot for r in part) == list(range(37, 61)) and all(whole[r.slot].ids == r.ids for r in part)
    assert O.read_shards(spark, f"{tmp_path}/a", 64, start=10**6).count() == 0


def test_key_decides_the_order(spark, documents, tmp_path):
    docs = documents([(i, f"text number {i} " * 30) for i in range(40)])
    def order(name, key, parts):
        O.write_shards(docs.repartition(parts), f"{tmp_path}/{name}", VOCABULARY, 32, key=key, shards=3)
        return [(r.doc_id, r.piece) for r in O.read_shards(spark, f"{tmp_path}/{name}", 32).orderBy("slot").collect()]
    one = order("one", 7, 2)
    assert order("again", 7, 5) == one != order("other", 8, 2)
    assert one != sorted(one)


def test_files_have_one_stride(spark, documents, tmp_path):
    O.write_shards(documents([(i, "a b c " * 50) for i in range(20)]), f"{tmp_path}/s", VOCABULARY, 16, shards=2)
    sizes = [p.stat().st_size for p in (tmp_path / "s").glob("part-*")]
    assert all(n % O.record_type(16).itemsize == 0 for n in sizes) and sum(sizes)


def test_empty(spark, none, tmp_path):
    O.write_shards(none, f"{tmp_path}/e", VOCABULARY)
    assert O.read_shards(spark, f"{tmp_path}/e").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    for key in (1, 99):
        out = feistel.permute(np.arange(n), n, key)
        assert sorted(out.tolist()) == list(range(n))
    mixed = feistel.permute(np.array([0, 1, 2, 0, 1]), np.array([3, 3, 3, 2, 2]), np.array([5, 5, 5, 6, 6]))
    assert sorted(mixed[:3].tolist()) == [0, 1, 2] and sorted(mixed[3:].tolist()) == [0, 1]


def test_tokens_in_parts_equal_tokens_of_whole_texts():
    texts = ["", " ", "\n", "a", "it's  he'll \t x'y", "é à ë\u0085 q w <|endoftext|> foo 日本 語 \U0001f600 x\x1cy　 z  k", "end. Start, (x)! 12 34.5", "w" * 300 + " " + "é" * 90, "a  b   c"]
    encoder = tokens.Encoder(VOCABULARY)
    from fjordbook.llm import words
    for kept in (2_000_000, 5):
        tokens.KEPT, before = kept, tokens.KEPT
        ids, ends = encoder.encode(*words.joined([t.encode() for t in texts * 2]))
        tokens.KEPT = before
        for i, t in enumerate(texts * 2):
            assert ids[ends[i]:ends[i + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids
