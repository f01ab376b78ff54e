import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from fjordbook.functions import text as T
from fjordbook.operators import keyed as K
from fjordbook.operators import search as S
from fjordbook.operators import spec as P
from fjordbook.operators.selectors import embedding_text, needs_embedding
from fjordbook.schema import ORG

DAY = date(2024, 6, 1)


@pytest.fixture(scope="module")
def companies(spark):
    records = [
        ("000000001", "Havvik Fisk AS", "AS", "03.111", 12, "0301", "PLACE", date(2024, 5, 1), date(1990, 1, 1), False, False, False, "Oppdrett av laks", None, None),
        ("000000002", "Bakeri 100% AS", "AS", "10.711", None, "0301", "PLACE", date(2010, 5, 1), None, True, False, False, None, "Bake brød og kaker", None),
        ("000000003", "ÅSGARD bygg", "ENK", "41.201", 0, "4601", "PLACE", date(2011, 5, 1), date(1950, 1, 1), False, True, False, "Building houses and boats", None, None),
        ("000000004", "Havvik Slettet", "AS", "03.111", 3, "0301", "PLACE", date(2011, 5, 1), None, False, False, False, "Laks", None, date(2024, 1, 1)),
    ]
    return spark.createDataFrame(
        records, f"{ORG} string, navn string, organisasjonsform_kode string, naeringskode1_kode string, antall_ansatte int, "
        "forretningsadresse_kommunenummer string, forretningsadresse_poststed string, registreringsdato_enhetsregisteret date, stiftelsesdato date, "
        "konkurs boolean, under_avvikling boolean, under_tvangsavvikling boolean, aktivitet string, vedtektsfestet_formaal string, slettet_dato date")


def keys(df):
    return sorted(r[ORG][-1] for r in df.collect())


@pytest.mark.parametrize("spec, expected", [
    (S.SearchSpec(), "123"),
    (S.SearchSpec(q="havvik"), "1"),
    (S.SearchSpec(q="åsgard"), "3"),
    (S.SearchSpec(q="000000002"), "2"),
    (S.SearchSpec(q="00000000"), ""),
    (S.SearchSpec(q="b%keri"), "2"),
    (S.SearchSpec(ansatte=1), "1"),
    (S.SearchSpec(ansatte_maks=0), "3"),
    (S.SearchSpec(aktive=True), "1"),
    (S.SearchSpec(konkurs=True, avvikling=True), "23"),
    (S.SearchSpec(nye=True), "1"),
    (S.SearchSpec(kommune="46"), "3"),
    (S.SearchSpec(fylke="3"), "12"),
    (S.SearchSpec(gjor="laks"), "1"),
    (S.SearchSpec(gjor="houses boats"), "3"),
    (S.SearchSpec(gjor='"boats houses"'), ""),
    (S.SearchSpec(gjor="laks or brød"), "12"),
    (S.SearchSpec(gjor="lakser og oppdretter"), "1"),
    (S.SearchSpec(gjor="houses -brød"), "3"),
])
def test_filters(companies, spec, expected):
    assert keys(S.search(companies, spec, DAY)) == list(expected)


def brute_match(query_groups, words):
    text = " " + " ".join(words) + " "
    return any(all((f" {term} " in text) != minus for minus, term in group) for group in query_groups)


def test_keyword_queries_match_brute_force(spark):
    rng = random.Random(9)
    vocabulary = ["fish", "boat", "net", "harbour", "crew"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 8))) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    queries = {
        "fish boat": [[(False, "fish"), (False, "boat")]],
        "fish -boat": [[(False, "fish"), (True, "boat")]],
        '"fish boat"': [[(False, "fish boat")]],
        '"fish boat" or crew net': [[(False, "fish boat")], [(False, "crew"), (False, "net")]],
        '-"net harbour" OR og': [[(True, "net harbour")]],
    }
    stems = [[w for w in t.split()] for t in texts]
    for query, groups in queries.items():
        got = {r.i for r in frame.filter(S.keyword_filter(query, F.col("t"))).collect()}
        assert got == {i for i, words in enumerate(stems) if brute_match(groups, words)}, query
    assert T.STOP_WORDS and frame.filter(S.keyword_filter("og som", F.col("t"))).count() == 0


def test_pages_and_counts(spark):
    frame = spark.range(95).select(F.col("id").cast("string").alias(ORG), (F.col("id") % 7).alias("antall_ansatte"), F.lit("n").alias("navn"))
    order = S.sort_order()
    seen = []
    for number in range(1, 12):
        rows, more = K.trimmed_page(frame, order, 10, number)
        seen += [r[ORG] for r in rows]
        assert more == (number < 10)
    assert len(seen) == len(set(seen)) == 95
    assert K.capped_count(frame, 50).first().asDict() == {"antall": 50, "flere": True}
    assert K.capped_count(frame, 95).first().asDict() == {"antall": 95, "flere": False}
    assert len(K.page(frame, order, 1000).collect()) == 95
    for size, number in ((0, 1), (10, 0)):
        with pytest.raises(ValueError):
            K.page(frame, order, size, number)


@pytest.mark.parametrize("bad", [
    {"filtre": [{"felt": "alder", "op": "er", "verdi": 1}]},
    {"filtre": [{"felt": "navn", "op": "er", "verdi": "x"}]},
    {"filtre": [{"felt": "ansatte", "op": "minst", "verdi": "mange"}]},
    {"filtre": [{"felt": "ansatte", "op": "minst", "verdi": "inf"}]},
    {"filtre": [{"felt": "ansatte", "op": "mellom", "verdi": 5}]},
    {"filtre": [{"felt": "ansatte", "op": "mellom", "verdi": [5, None]}]},
])
def test_specs_outside_the_vocabulary_are_refused(spark, bad):
    with pytest.raises(P.SpecError):
        P.compile_spec(bad)


def test_place_names_match_before_the_dash(spark):
    frame = spark.createDataFrame([("Oslo - Oslove", None), ("Oslo", None), ("Oslofjord", None), ("oslo", "x")], "fylke string, slettet_dato string")
    condition = P.compile_spec({"filtre": [{"felt": "fylke", "op": "er", "verdi": "oslo"}]})
    assert sorted(r.fylke for r in frame.filter(condition).collect()) == ["Oslo", "Oslo - Oslove"]


def test_spec_limits_and_schema(spark):
    assert [P.spec_limit({"grense": g}) for g in (None, 1, 500, "40")] == [25, 1, 500, 40]
    for bad in (0, -3, "x", "inf", 2.5):
        with pytest.raises(P.SpecError):
            P.spec_limit({"grense": bad})
    schema = P.spec_schema()["properties"]
    assert len(schema["filtre"]["items"]["properties"]["felt"]["enum"]) == 14
    assert set(schema["filtre"]["items"]["properties"]["op"]["enum"]) == set(P.OPERATORS)
    assert len(P.vocabulary_text().splitlines()) == 14


def test_specs_are_found_in_replies(spark):
    replies = spark.createDataFrame([
        (1, 'Sure!\n{"filtre": [{"felt": "ansatte", "op": "mellom", "verdi": [10, 20]}], "sorter": "navn"}\nDone'),
        (2, "no object"), (3, '{"filtre": [{"felt": "alder", "op": "er", "verdi": 3}]}'), (4, '{"sorter": "navn"}'), (5, "{broken"),
    ], "id int, text string")
    specs, rejects = P.parse_specs(replies)
    spec = P.spec_of(specs.first().spec)
    assert spec["filtre"] == [{"felt": "ansatte", "op": "mellom", "verdi": [10, 20]}] and spec["sorter"] == "navn"
    P.compile_spec(spec)
    assert {r.id: r.grunn for r in rejects.collect()} == {
        2: "ingen spesifikasjon", 3: "ukjent felt eller operator", 4: "ingen filtre", 5: "ingen spesifikasjon"}


def test_embedding_selection(companies, spark):
    texts = {r[ORG]: r for r in embedding_text(companies).collect()}
    assert sorted(texts) == ["000000001", "000000002", "000000003"]
    known = spark.createDataFrame([
        ("000000001", texts["000000001"].tekst_hash, "m"), ("000000002", "other", "m"), ("000000003", texts["000000003"].tekst_hash, "old")],
        f"{ORG} string, tekst_hash string, modell string")
    assert keys(needs_embedding(companies, known, "m")) == ["2", "3"]
