import math
import random
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from checks.texts import ENDINGS
from fjordbook.functions import text as T
from fjordbook.functions.hashing import fnv1a, signed_slots
from fjordbook.operators import retrieval as X
from fjordbook.session import durable

# Two questions, the document frequencies of a 33-chunk corpus, and the weights they must get by slot.
QUESTIONS = {
    "What authentication does the order API use?": (
        {"order": 13, "use": 8, "api": 3, "authenticat": 2},
        {151: -0.196701, 1106: 0.471752, 1121: -0.357251, 1211: -0.471752, 1268: 0.24275, 2024: 0.471752, 2695: -0.327268},
    ),
    "What happens to a message after it fails five times?": (
        {"message": 8, "fail": 7, "after": 5, "five": 3, "time": 2, "happen": 1},
        {613: -0.360517, 917: -0.250101, 1239: -0.360517, 1857: -0.305309, 1901: -0.194893, 2273: -0.360517,
         2276: 0.185512, 2358: 0.360517, 2690: 0.360517, 3044: 0.273014, 3529: -0.217806},
    ),
}


@pytest.mark.parametrize("question", QUESTIONS)
def test_question_vectors_match_the_golden_values(spark, question):
    frequencies, expected = QUESTIONS[question]
    counts = spark.createDataFrame(
        [(doc, token, 1) for token, df in frequencies.items() for doc in range(df)], "doc_id long, token string, tf long"
    )
    n = F.lit(33)
    weights = X.idf(counts, n)
    asked = spark.createDataFrame([(1, question)], "query_id long, text string")
    vector = X.embed_questions(asked, weights, n).first()
    assert vector.slots == sorted(expected)
    assert dict(zip(vector.slots, vector["values"])) == pytest.approx(expected, abs=1e-5)


def reference_tokens(text):
    """Word by word, as the rules are stated."""
    out = []
    for w in re.sub(r"[^\w]|_", " ", text.lower()).split():
        if len(w) <= 1 or w in T.STOP_WORDS:
            continue
        for step in ENDINGS if len(w) > 3 else ():
            applies = [(e, new) for e, new, fewest, but in step if w.endswith(e) and len(w) >= fewest and not w.endswith(but or ("\0",))]
            if applies:
                w = w.removesuffix(applies[0][0]) + applies[0][1]
        out.append(w)
    return out


def test_tokens_follow_the_rules_word_by_word(spark):
    rng = random.Random(5)
    parts = ["valid", "ss", "es", "ies", "s", "us", "ion", "ing", "ed", "ly", "a", "the", "x", "å", "42", "_", "-", "ses", "sses", "ie"]
    texts = [" ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(40)) for _ in range(200)]
    texts += ["", "the a of", "dies lies uses sses cases speeding seeding classes Retries, retried & retry!"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = {r.i: r for r in frame.select("i", T.tokens(F.col("text")).alias("t"), T.bigrams(F.col("text")).alias("b"), T.terms(F.col("text")).alias("all")).collect()}
    for i, text in enumerate(texts):
        expected = reference_tokens(text)
        assert got[i].t == expected
        pairs = [f"{a}_{b}" for a, b in zip(expected, expected[1:])]
        assert got[i].b == pairs
        assert sorted(got[i]["all"]) == sorted(expected + pairs)


def test_fnv_matches_a_plain_loop():
    def slow(text):
        h = 2166136261
        data = text.encode("utf-16-le")
        for lo, hi in zip(data[::2], data[1::2]):
            h = ((h ^ (lo | hi << 8)) * 16777619) & 0xFFFFFFFF
        return h
    texts = ["", "a", "order", "ærlig", "order_api#sign", "😀 x"]
    for together in (texts, [*texts, "a\0b"]):
        assert fnv1a(pd.Series(together))[0].tolist() == [slow(t) for t in together]
        assert fnv1a(pd.Series(together), "#sign")[1].tolist() == [slow(t + "#sign") for t in together]


def test_sentences_and_windows(spark):
    text = "Short one. This sentence is long enough! Is this one also long enough?\nA line without an end mark"
    got = spark.range(1).select(T.sentences(F.lit(text)).alias("s")).first().s
    assert got == ["This sentence is long enough!", "Is this one also long enough?", "A line without an end mark"]
    for length in (1, 899, 900, 901, 1700, 1701, 5000):
        body = "".join(chr(97 + i % 26) for i in range(length))
        pieces = spark.range(1).select(T.windows(F.lit(body)).alias("w")).first().w
        assert all(0 < len(p) <= 900 for p in pieces)
        assert pieces[0] + "".join(p[100:] for p in pieces[1:]) == body


def test_chunks_carry_title_and_heading(spark):
    text = "intro\n\n## First part\nbody one\n## Second\n\n## Third\nbody three"
    documents = spark.createDataFrame([(1, "Guide", text)], "doc_id long, title string, text string")
    got = [(r.seksjon, r.overskrift, r.tekst) for r in X.chunk(documents).orderBy("seksjon").collect()]
    assert got == [
        (0, "", "Guide\n\nintro"), (1, "First part", "Guide > First part\n\nbody one"), (2, "Third", "Guide > Third\n\nbody three"),
    ]


def test_knn_is_exact_and_respects_models(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(400, 12)).astype("float32")
    model = ["a" if i % 3 else "b" for i in range(400)]
    vectors = spark.createDataFrame([(i, model[i], data[i].tolist()) for i in range(400)], "doc_id long, model string, embedding array<float>").repartition(7)
    asked = spark.createDataFrame([(f"q{i}", "a", data[i].tolist()) for i in range(9)], "query_id string, model string, embedding array<float>")
    unit = data.astype("float64") / np.linalg.norm(data.astype("float64"), axis=1, keepdims=True)

    def expected(i):
        scores = [(-round(float(unit[i] @ unit[j]), 6), j) for j in range(400) if model[j] == "a"]
        return [j for _, j in sorted(scores)[:5]]

    for block in (64 << 20, 200):  # one block of queries, then several
        monkeypatch.setattr(X, "BLOCK_BYTES", block)
        got = X.knn(asked, vectors, 5).orderBy("query_id", "rank").collect()
        assert len(got) == 45
        for i in range(9):
            assert [r.doc_id for r in got if r.query_id == f"q{i}"] == expected(i)


def test_knn_refuses_other_widths(spark):
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    vectors = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "doc_id long, embedding array<float>")
    with pytest.raises(Exception, match="widths differ"):
        X.knn(asked, vectors, 1).collect()


def test_knn_without_questions_is_empty(spark):
    asked = spark.createDataFrame([], "query_id long, embedding array<float>")
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "doc_id long, embedding array<float>")
    assert X.knn(asked, vectors, 3).collect() == []


def test_approximate_search_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(10, 16))
    points = [(i, (centres[i % 10] + 0.15 * rng.normal(size=16)).astype("float32").tolist()) for i in range(500)]
    vectors = spark.createDataFrame(points, "doc_id long, embedding array<float>")
    asked = vectors.filter("doc_id < 20").withColumnRenamed("doc_id", "query_id")
    found = X.knn_approx(asked, vectors, 10)
    assert X.recall(found, X.knn(asked, vectors, 10)).first().recall > 0.9
    assert found.filter("rank = 1 and query_id = doc_id").count() == 20


def test_relevance_keeps_nothing_below_the_floor(spark):
    # The scores of a question with an answer and of one without.
    scores = [(1, 1, 0.1129), (1, 2, 0.0807), (1, 3, 0.0697), (1, 4, 0.0672), (2, 1, 0.0692), (2, 2, 0.0522), (2, 3, 0.0490)]
    ranked = spark.createDataFrame(scores, "query_id long, doc_id long, score double")
    kept = X.relevance(ranked, X.FLOORS["hashed"]).filter("beholdt")
    assert sorted((r.query_id, r.doc_id) for r in kept.collect()) == [(1, 1), (1, 2)]


def test_quoted_sentences(spark):
    passages = spark.createDataFrame([
        (1, 1, "Clients sign in with a service token. The token expires after a day of use.\nNothing else is relevant here."),
        (1, 2, "Billing is unrelated to that subject."),
    ], "query_id long, rank int, text string")
    questions = spark.createDataFrame([(1, "How does a service token expire?")], "query_id long, text string")
    counts = X.term_counts(passages.withColumn("doc_id", F.col("rank")), "doc_id")
    answers = X.extractive_answers(questions, passages, X.idf(counts, F.lit(2)), F.lit(2)).orderBy("plass").collect()
    assert [(a.rank, a.nr) for a in answers] == [(1, 0), (1, 1)]
    assert answers[1].linje == "The token expires after a day of use. [S1]"


def test_context_is_numbered_in_order(spark):
    kept = spark.createDataFrame([(1, 2, "b.md", "H2", "two"), (1, 1, "a.md", "H1", "one")],
                                 "query_id long, rank int, source string, overskrift string, text string")
    assert X.assemble_context(kept).first().kontekst == "[S1] (a.md > H1)\none\n\n[S2] (b.md > H2)\ntwo"


def test_embedder_replies_are_put_back_in_order(spark):
    texts = spark.createDataFrame([(f"k{i}", "x" * (i + 1)) for i in range(7)], "k string, tekst string").coalesce(1)

    def embed(batch):
        return [(i, [float(len(t))]) for i, t in reversed(list(enumerate(batch)))]

    got = {r.k: r.embedding for r in X.embed_texts(texts, embed, "k", "plain-model", batch=3).collect()}
    assert got == {f"k{i}": [float(i + 1)] for i in range(7)}


def test_evaluation(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1), (2, 21, 3)], "query_id long, doc_id long, rank int")
    golden = spark.createDataFrame([(1, 10), (2, 21), (3, 30)], "query_id long, doc_id long")
    row = X.evaluate(ranked, golden, 3).first()
    assert (row.spoersmaal, row.topp1, row.gjenfinning) == (3, pytest.approx(1 / 3), pytest.approx(2 / 3))


# Sample words and stems published with the Norwegian stemmer.
NORWEGIAN = {
    "havn": "havn", "havnedistrikt": "havnedistrikt", "havnedistriktene": "havnedistrikt", "havnedistrikter": "havnedistrikt",
    "havnedistriktet": "havnedistrikt", "havnedistriktets": "havnedistrikt", "opning": "opning", "opningar": "opning", "opningen": "opning",
    "oppdage": "oppdag", "oppdaga": "oppdag", "oppdager": "oppdag", "oppbyggingen": "oppbygging", "opp": "opp",
}


def test_norwegian_stems(spark):
    frame = spark.createDataFrame(list(NORWEGIAN.items()), "ord string, stamme string")
    got = {r.ord: r.s for r in frame.select("ord", T.stems(F.col("ord"), "norsk").alias("s")).collect()}
    assert got == {w: s if w != "opp" else "" for w, s in NORWEGIAN.items()}


def reference_norwegian(word):
    """The algorithm step by step, one word at a time."""
    vowels = "aeiouyæåø"
    start = len(word)
    for i in range(1, len(word)):
        if word[i - 1] in vowels and word[i] not in vowels:
            start = i + 1
            break
    start = max(start, 3)

    def longest(endings):
        return max((e for e in endings if word.endswith(e) and len(word) - len(e) >= start), key=len, default=None)

    ending = longest(T._INFLECTIONS + ["s", "erte", "ert"])
    if ending in ("erte", "ert"):
        word = word[: -len(ending)] + "er"
    elif ending == "s":
        before = word[:-1]
        if before[-1] in "bcdfghjlmnoprtvyz" or (before[-1] == "k" and before[-2] not in vowels):
            word = before
    elif ending:
        word = word[: -len(ending)]
    if longest(["dt", "vt"]):
        word = word[:-1]
    ending = longest(T._DERIVATIONS)
    return word[: -len(ending)] if ending else word


def test_norwegian_stems_match_the_steps(spark):
    rng = random.Random(8)
    parts = ["fisk", "båt", "k", "ks", "s", "er", "ert", "erte", "en", "ene", "het", "hetene", "lig", "elig", "slov", "els", "dt", "vt", "æ", "ø", "st", "a", "ar", "ig", "ut"]
    words = sorted({"".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(4000)} - set(T.NORWEGIAN_STOP_WORDS))
    words = [w for w in words if len(w) > 1]
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: r.s for r in frame.select("w", T.stems(F.col("w"), "norsk").alias("s")).collect()}
    wrong = {w: (got[w], reference_norwegian(w)) for w in words if got[w] != reference_norwegian(w)}
    assert not wrong


def test_heading_lines_are_not_quoted(spark):
    documents = spark.createDataFrame([(1, "Handbook of ordering", "## Ordering the goods today\nOrdering goods takes three days in all. Nothing else matters here at all.")], "doc_id long, title string, text string")
    passages = X.chunk(documents).select(F.lit(1).alias("query_id"), F.lit(1).alias("rank"), F.col("tekst").alias("text"))
    questions = spark.createDataFrame([(1, "ordering goods")], "query_id long, text string")
    weights = X.idf(X.term_counts(documents), X.count_of(documents))
    quoted = [r.setning for r in X.extractive_answers(questions, passages, weights, X.count_of(documents), headed=True).collect()]
    assert quoted == ["Ordering goods takes three days in all."]


def test_words_stemmed_once_are_those_of_the_column(spark):
    """The stemmer of an array of words against that of a text column, on made-up words with all endings."""
    r = random.Random(8)
    heads = ["", "a", "bu", "pas", "cla", "respon", "quick", "é", "日", "x1"]
    tails = ["", "s", "ss", "ses", "sses", "ies", "us", "ion", "ions", "ing", "ings", "ed", "ly", "y", "es", "ees"]
    words = sorted({h + t for h in heads for t in tails} | {"the", "a"} | {"".join(r.choices("abesingltyou", k=r.randrange(2, 9))) for _ in range(400)})
    words = [w for w in words if w]
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    want = {x.w: x.s for x in frame.select("w", T.stems(F.col("w")).alias("s")).collect()}
    got = dict(zip(words, T.stem_each(pa.array(words)).to_pylist(), strict=True))
    assert {w: s or "" for w, s in got.items()} == want


def test_sparse_neighbours_skip_but_miss_nothing(spark, monkeypatch):
    """Postings with thresholds against all products: short and long vectors, signs, ties, empty queries, several blocks."""
    rng = np.random.default_rng(5)

    def vectors(n, first):
        out = []
        for i in range(n):
            slots = np.sort(rng.choice(60, rng.integers(1, 30), replace=False))
            values = rng.choice([-0.5, 0.25, 0.5, 1.0], len(slots)) if i % 3 else rng.normal(size=len(slots))
            out.append((first + i, slots.tolist(), (values / np.linalg.norm(values)).tolist(), "m" if i % 5 else "n"))
        return out

    docs, asked = vectors(300, 0), vectors(20, 1000)
    docs += [(400 + i, *docs[4][1:]) for i in range(30)]  # ties beyond the wanted number
    shape = "slots array<int>, values array<double>, model string"
    frames = spark.createDataFrame(asked, f"query_id long, {shape}"), spark.createDataFrame(docs, f"doc_id long, {shape}").repartition(3)

    def dense(rows):
        x = np.zeros((len(rows), 60))
        for i, (_, s, v, _) in enumerate(rows):
            x[i, s] = v
        return x

    scores = np.round(dense(asked) @ dense(docs).T, 12)
    for model in (False, True):
        want = {}
        for q, row in enumerate(asked):
            ranked = sorted((-scores[q, d], doc[0]) for d, doc in enumerate(docs) if not model or doc[3] == row[3])[:7]
            want[row[0]] = [(i, round(-s, 6) + 0.0) for s, i in ranked]
        picked = frames if model else tuple(f.drop("model") for f in frames)
        for entries in (1 << 20, 60):
            got = {}
            for x in X.knn_sparse(*picked, 7, entries=entries).orderBy("query_id", "rank").collect():
                got.setdefault(x.query_id, []).append((x.doc_id, x.score))
            assert got == want


def test_both_sides_are_marked_for_models_that_want_it(spark):
    texts = spark.createDataFrame([(1, "laks")], "k long, tekst string")

    def echo(asked):
        return [(i, [float(ord(c)) for c in t]) for i, t in enumerate(asked)]

    def said(model):
        stored = X.embed_texts(texts, echo, "k", model).first().embedding
        return ["".join(chr(int(x)) for x in v) for v in (stored, X.embed_question(echo, "laks", model))]

    assert said("nomic-embed-text:v1.5") == ["search_document: laks", "search_query: laks"]
    assert said("text-embedding-3-small") == ["laks", "laks"]


def test_batches_are_worked_on_in_parts(spark, monkeypatch):
    """Texts and vectors of one batch, more than a task holds at once: no part is larger, and nothing is lost."""
    batch = pa.RecordBatch.from_pydict({"n": list(range(8))})
    sizes = np.array([3, 3, 5, 20, 0, 0, 9, 1])
    parts = [p.column("n").to_pylist() for p in X._parts(batch, sizes, 10)]
    assert parts == [[0, 1], [2], [3], [4, 5, 6, 7]] and list(X._parts(batch.slice(0, 0), sizes[:0], 10)) == []
    r = random.Random(4)
    texts = [(i, " ".join(r.choice(["fish", "boats", "trading", "x", "of"]) + str(r.randrange(5)) for _ in range(r.randrange(30)))) for i in range(60)] + [(60, None)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    whole = [sorted(map(tuple, X.term_counts(frame).collect())), sorted(map(tuple, X.knn(*[X.index_documents(frame)[1].withColumnRenamed("doc_id", n) for n in ("query_id", "doc_id")], 3).collect()))]
    monkeypatch.setattr(X, "TEXT_HELD", 200)
    monkeypatch.setattr(X, "ENTRIES_HELD", 50)
    cut = [sorted(map(tuple, X.term_counts(frame).collect())), sorted(map(tuple, X.knn(*[X.index_documents(frame)[1].withColumnRenamed("doc_id", n) for n in ("query_id", "doc_id")], 3).collect()))]
    assert cut == whole and len(whole[1]) > 100


def test_bigrams_are_counted_before_they_are_shuffled(spark):
    plan = queries()["bigrams"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1


def _plain_vectors(texts):
    """Vectors by key of ``(key, text)`` rows, worked out term by term; rows of one key add up."""
    terms = []
    for key, text in texts:
        words = [w.as_py() for w in T.stem_each(pa.array((text or "").split(" "))) if w.is_valid]
        terms.append((key, Counter(words + [f"{a}_{b}" for a, b in pairwise(words)])))
    df = Counter(t for _, tf in terms for t in tf)
    found = {}
    for key, tf in terms:
        for term, count in tf.items():
            place = int(signed_slots(pd.Series([term]))[0])
            slots = found.setdefault(key, {})
            slot = -1 - place if place < 0 else place
            slots[slot] = slots.get(slot, 0.0) + (-1 if place < 0 else 1) * (1 + math.log(count)) * (math.log((len(texts) + 1) / (df[term] + 1)) + 1)
    norms = {key: math.sqrt(sum(w * w for w in slots.values())) for key, slots in found.items()}
    return df, {key: {s: w / norms[key] for s, w in slots.items()} for key, slots in found.items()}


@pytest.mark.parametrize("held", [None, 40])
def test_vectors_are_those_of_terms_counted_one_by_one(spark, monkeypatch, held):
    """Keys that come twice or are missing, empty texts, texts over several pieces: the vectors are exact, and no term is a row on the way."""
    if held:
        monkeypatch.setattr(X, "TEXT_HELD", held)
        monkeypatch.setattr(X, "SHARE_TEXT", held)
    r = random.Random(7)
    texts = [(i, " ".join(r.choice(["fish", "boats", "trading", "x", "of", "\u00e6rlig"]) + str(r.randrange(4)) for _ in range(r.randrange(1, 25)))) for i in range(40)]
    texts += [(3, "fish1 boats2"), (None, "fish1 fish1"), (None, "trading3"), (50, None), (51, ""), (52, "of x")]
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    if held:  # several batches a task, so pieces of several parts
        spark.conf.set(rows, "3")
    weights, vectors = X.index_documents(spark.createDataFrame(texts, "doc_id long, text string").repartition(3))
    assert "token" not in vectors._jdf.queryExecution().optimizedPlan().toString()
    vectors = durable(vectors)
    spark.conf.set(rows, before)
    df, wanted = _plain_vectors(texts)
    assert {w.token: w.df for w in weights.collect()} == df
    found = {row[0]: dict(zip(row[1], row[2], strict=True)) for row in vectors.select("doc_id", "slots", "values").collect()}
    assert found.keys() == wanted.keys() and len(found) == vectors.count()
    for key, slots in wanted.items():
        assert found[key] == pytest.approx(slots, abs=1e-12)
    assert all(row.slots == sorted(row.slots) for row in vectors.select("slots").collect())


def test_passages_meet_their_texts_without_a_shuffle_of_texts(spark):
    for name in ("context_assembly", "extractive_top3", "extractive_headed"):
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") >= 1, name
