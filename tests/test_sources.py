import gzip
import json
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from checks.filesources import _DAMAGE
from checks.standins import write_arrays
from fjordbook.functions import cleaning as C
from fjordbook.schema import COMPANY_HEADERS, COMPANY_MAPPING, DUMP_FIELDS, ORG
from fjordbook.sources import dump, files


def company_csv(path, records):
    def cell(v):
        return '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n') else v
    lines = [",".join(COMPANY_HEADERS)] + [",".join(cell(r.get(h, "")) for h in COMPANY_HEADERS) for r in records]
    with gzip.open(path, "wt", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def test_company_file(spark, tmp_path):
    path = str(tmp_path / "companies.csv.gz")
    company_csv(path, [
        {ORG: "000000001", "navn": 'Fjell "og" Sønn, AS', "aktivitet": "line one\nline two, with comma", "antallAnsatte": "12",
         "harRegistrertAntallAnsatte": "true", "naeringskode1.kode": "00.000", "naeringskode1.beskrivelse": "Uoppgitt",
         "stiftelsesdato": "1999-02-28", "kapital.belop": "30000.00", "kapital.fulltInnbetalt": "false"},
        {ORG: "000000002", "navn": "Nul", "naeringskode1.kode": "41.201", "naeringskode1.beskrivelse": "Bygg", "antallAnsatte": "0",
         "harRegistrertAntallAnsatte": "true", "registreringsdatoenhetsregisteret": "2020-01-02"},
        {ORG: "000000003", "navn": "Bad", "antallAnsatte": "twelve", "stiftelsesdato": "2001-02-30"},
    ])
    for land in (None, str(tmp_path / "landed")):
        rows, rejects = files.read_mapped_csv(spark, path, land=land)
        assert len(rows.columns) == len(COMPANY_MAPPING) == 90
        got = {r[ORG]: r for r in rows.collect()}
        assert set(got) == {"000000001", "000000002"}
        first = got["000000001"]
        assert first.navn == 'Fjell "og" Sønn, AS' and first.aktivitet == "line one\nline two, with comma"
        assert first.naeringskode1_kode is None and first.naeringskode1_beskrivelse is None
        assert (first.antall_ansatte, first.stiftelsesdato, first.kapital_belop) == (12, date(1999, 2, 28), Decimal("30000.00"))
        assert first.kapital_fullt_innbetalt is False and first.konkurs is False and first.hjemmeside is None
        second = got["000000002"]
        assert second.antall_ansatte == 0 and second.har_registrert_antall_ansatte and second.naeringskode1_kode == "41.201"
        assert second.kapital_fullt_innbetalt is None and second.registreringsdato_enhetsregisteret == date(2020, 1, 2)
        bad = rejects.first()
        assert bad[ORG] == "000000003" and sorted(bad.feil_kolonner) == ["antall_ansatte", "stiftelsesdato"]


def test_holdings_file_keeps_quotes_and_drops_the_mark(spark, tmp_path):
    path = tmp_path / "holdings.csv"
    text = "Orgnr;Selskap;Aksjeklasse;Navn;Fodt;Sted;Land;Aksjer;Totalt\n1234;Fjord AS;A;Ola \"Kai;1970;4020 STAVANGER;NOR;10;40\n"
    path.write_bytes(b"\xef\xbb\xbf" + text.encode())
    row = files.read_holdings(spark, str(path)).first()
    assert row.eier_navn == 'Ola "Kai' and row.orgnr == "1234" and row.antall_aksjer_selskap == "40"


def test_postcodes_in_latin_1(spark, tmp_path):
    path = tmp_path / "post.txt"
    path.write_bytes("0001\tOSLO\t0301\tOslo\tP\r\n9990\tBÅTSFJORD\t5632\tBåtsfjord\tB\r\n1234\tKORT\t0301\r\n".encode("latin-1"))
    got = sorted((r.postnummer, r.poststed, r.kategori) for r in files.read_postcodes(spark, str(path)).collect())
    assert got == [("0001", "OSLO", "P"), ("9990", "BÅTSFJORD", "B")]


def test_nested_roles(spark, tmp_path):
    documents = [
        {ORG: "000000001", "rollegrupper": [{"type": {"kode": "STYR"}, "sistEndret": "2020-01-01", "roller": [
            {"type": {"kode": "LEDE"}, "rekkefolge": 1, "person": {"navn": {"fornavn": "Åse", "etternavn": "Li"}, "fodselsdato": "1960-05-05"}},
            {"type": {"kode": "MEDL"}, "avregistrert": True, "person": {"navn": {"fornavn": "Per", "etternavn": "Moe"}, "fodselsdato": ""}}]},
            {"type": {"kode": "REVI"}, "roller": [{"type": {"kode": "REVI"}, "enhet": {ORG: "000000009", "navn": ["Revisor", "AS"]}}]}]},
        {ORG: "000000002", "rollegrupper": []},
        {ORG: "000000003", "rollegrupper": [{"type": {"kode": "DAGL"}, "roller": [{"type": {"kode": "DAGL"}}]}]},
    ]
    path = tmp_path / "roles.json"
    path.write_text(json.dumps(documents, indent=2))
    companies = spark.createDataFrame([("000000001",), ("000000002",)], f"{ORG} string")
    roles = files.explode_roles(files.read_nested_json(spark, str(path)), companies)
    got = {r.rolletype_kode: r for r in roles.collect()}
    assert set(got) == {"LEDE", "MEDL", "REVI"}
    assert got["LEDE"].person_fodselsdato == date(1960, 5, 5) and got["LEDE"].avregistrert is False
    assert got["MEDL"].person_fodselsdato is None and got["MEDL"].avregistrert is True
    assert got["REVI"].innehaver_navn == "Revisor AS" and got["REVI"].person_etternavn is None


def dump_tuple(values):
    fields = ["0"] * DUMP_FIELDS
    for i, v in values.items():
        fields[i] = v
    return "(" + ",".join(fields) + ")"


def test_sql_dump(spark, tmp_path):
    good = dump_tuple({0: "'000000001'", 1: "2019", 2: "6", 3: "1500", 10: "-20", 5: "'a, (b) \\' c'", 28: "10", 35: "''"})
    december = dump_tuple({0: "'000000001'", 1: "'2020'", 2: "0", 3: "abc", 10: "1"})
    unknown = dump_tuple({0: "'000000077'", 1: "2020", 2: "12"})
    path = tmp_path / "dump.sql"
    path.write_text("-- comment\nINSERT INTO `t` VALUES " + ",".join([good, december, "(1,2)", dump_tuple({0: "'12'", 1: "2020"})]) + ";\n"
                    + f"INSERT INTO `t` VALUES {unknown};\nUNLOCK TABLES;\n")
    rows = dump.read_sql_dump(spark, str(path))
    assert rows.count() == 3
    companies = spark.createDataFrame([("000000001",)], f"{ORG} string")
    got = {r.periode_til: r for r in dump.history_accounts(rows, companies).collect()}
    june, last = got[date(2019, 6, 30)], got[date(2020, 12, 31)]
    assert june.periode_fra == date(2018, 7, 1) and june.sum_driftsinntekter == 1_500_000 and june.driftsresultat == -20_000
    assert june.sum_driftskostnad == 1_520_000 and june.sum_anleggsmidler == 10_000
    assert june.sum_omloepsmidler is None and june.sum_eiendeler is None
    assert last.sum_driftsinntekter is None and last.periode_fra == date(2020, 1, 1) and last.kilde == "historikk" and last.valuta is None


def test_account_documents(spark, tmp_path):
    body = {ORG: "000000001", "id": 1234567, "journalnr": 99, "regnskapstype": "SELSKAP", "valuta": "NOK",
            "regnskapsperiode": {"fraDato": "2023-01-01", "tilDato": "2023-12-31"}, "virksomhet": {"morselskap": False},
            "resultatregnskapResultat": {"aarsresultat": -1500.5, "driftsresultat": {"driftsinntekter": {"sumDriftsinntekter": 1234567.0}}},
            "egenkapitalGjeld": {"gjeldOversikt": {"sumGjeld": 499}}}
    path = tmp_path / "accounts.jsonl"
    path.write_text(json.dumps(body) + "\n")
    row = files.read_accounts(spark, str(path))[0].first()
    assert (row.periode_til, row.brreg_id, row.morselskap) == (date(2023, 12, 31), 1234567, False)
    assert (row.sum_driftsinntekter, row.aarsresultat, row.sum_gjeld) == (1_235_000, -2000, 0)
    assert row.sum_eiendeler is None and row.kilde == "brreg-api" and json.loads(row.raw) == body


def test_account_documents_that_do_not_fit(spark):
    def body(**other):
        return json.dumps({ORG: "000000001", "regnskapstype": "SELSKAP", "regnskapsperiode": {"tilDato": "2023-12-31"}, **other})

    documents = [
        body(egenkapitalGjeld={"gjeldOversikt": {"sumGjeld": "12x"}}), body(regnskapsperiode={"tilDato": "2023-02-30"}), body(regnskapstype=" "), body(**{ORG: ""}),
        "{", "", "  ", "[]", "7", body(egenkapitalGjeld={"gjeldOversikt": {"sumGjeld": ""}}), None,
    ]
    rows, rejects = files.account_rows(spark.createDataFrame([(d,) for d in documents], "raw string"))
    assert rows.count() == 1 and rows.first().sum_gjeld is None
    assert sorted((r.raw, ",".join(sorted(r.feil_kolonner))) for r in rejects.collect()) == sorted([
        (documents[0], "sum_gjeld"), (documents[1], "periode_til"), (documents[2], "regnskapstype"), (documents[3], ORG), ("{", "raw"), ("[]", "raw"), ("7", "raw")])


def test_company_documents(spark):
    body = {ORG: "000000001", "navn": "Ny AS", "registrertIMvaregisteret": True, "antallAnsatte": 7,
            "forretningsadresse": {"adresse": ["c/o Li", "Gata 1"], "kommunenummer": "0301"},
            "naeringskode1": {"kode": "00.000", "beskrivelse": "Uoppgitt"}, "overordnetEnhet": {ORG: "000000009"}}
    bad = [("000000002", json.dumps({ORG: "000000002", "antallAnsatte": "12x"})), ("000000003", "{"), ("000000004", json.dumps({ORG: "000000005"})), ("000000006", json.dumps({"navn": "no key"}))]
    documents = spark.createDataFrame([("000000001", json.dumps(body)), *bad], f"{ORG} string, doc string")
    rows, rejects = files.company_documents(documents)
    assert {r[ORG]: r.feil_kolonner for r in rejects.collect()} == {"000000002": ["antall_ansatte"], "000000003": [ORG], "000000004": [ORG]}
    assert {r[ORG] for r in rows.collect()} == {"000000001", "000000006"}
    row = rows.filter(F.col(ORG) == "000000001").first()
    assert row.forretningsadresse_adresse == "c/o Li, Gata 1" and row.registrert_i_mva_registeret is True
    assert row.naeringskode1_kode is None and row.naeringskode1_beskrivelse is None and row.antall_ansatte == 7
    assert row.overordnet_enhet == "000000009" and row.konkurs is False and row.postadresse_adresse in (None, "")


def test_classification_and_names(spark, tmp_path):
    codes = tmp_path / "codes.json"
    codes.write_text(json.dumps({"codes": [{"code": "A", "name": "Jordbruk", "level": "1", "parentCode": "", "validFrom": "2009-01-01"},
                                           {"code": "01", "name": "Skog", "level": "2", "parentCode": "A"}]}))
    got = sorted((r.kode, r.niva, r.parent_kode, r.gyldig_fra) for r in files.read_codes(spark, str(codes)).collect())
    assert got == [("01", 2, "A", None), ("A", 1, None, date(2009, 1, 1))]
    names = tmp_path / "names.json"
    names.write_text(json.dumps({"variables": [
        {"text": "år", "values": ["1"], "valueTexts": ["x"]},
        {"text": "fornavn", "values": ["1AASE", "2PER", "1KIM", "2KIM", "9X"], "valueTexts": ["Aase ", "Per", "Kim", "kim", "Q"]}]}))
    gender = files.gender_by_name(files.read_first_names(spark, str(names)))
    assert sorted(map(tuple, gender.collect())) == [("AASE", "K"), ("KIM", "?"), ("PER", "M")]


def test_cleaning_rules(spark):
    frame = spark.createDataFrame([("12 ", "4020 OSLO S", 500.0), ("1234567890", "LONDON", -1500.0)], "k string, a string, v double")
    got = frame.select(
        C.org_key(F.col("k")).alias("k"), C.post_code(F.col("a")).alias("c"), C.post_place(F.col("a")).alias("p"),
        C.to_thousand(F.col("v").cast("decimal(20,2)")).alias("v")).collect()
    assert [tuple(r) for r in got] == [("000000012", "4020", "OSLO S", Decimal("1000.00")), ("123456789", None, None, Decimal("-2000.00"))]


def _parses(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString().count("from_json(")


def test_accounts_documents_are_parsed_once(spark):
    rows, rejects = files.account_rows(spark.createDataFrame([("{}",)], "raw string"))
    assert [_parses(rows), _parses(rejects), _parses(rejects.filter("array_contains(feil_kolonner, 'raw')"))] == [1, 1, 1]


def test_company_documents_are_parsed_once(spark):
    rows, rejects = files.company_documents(spark.createDataFrame([("000000001", "{}")], f"{ORG} string, doc string"))
    assert [_parses(rows), _parses(rejects)] == [1, 1]


def test_a_landed_file_is_read_by_all_cores_and_typed_once(spark, tmp_path):
    """One file is read by one task; what comes after it is not, and does not type its cells again."""
    header = [h for h, _, _ in COMPANY_MAPPING]
    lines = [",".join(f'"{n:09d}"' if h == "organisasjonsnummer" else ('"x"' if h == "antallAnsatte" and n % 5 == 0 else '""') for h in header) for n in range(40)]
    (tmp_path / "a.csv").write_text("\n".join([",".join(f'"{h}"' for h in header), *lines]) + "\n", encoding="utf-8")
    rows, rejects = files.read_mapped_csv(spark, str(tmp_path / "a.csv"), land=str(tmp_path / "raa"))
    assert len(spark.read.parquet(str(tmp_path / "raa")).inputFiles()) > 1
    assert "try_cast" not in rows._jdf.queryExecution().optimizedPlan().toString().lower()
    assert (rows.count(), rejects.count()) == (32, 8)


@pytest.mark.parametrize("name", [n for n, (layout, _) in _DAMAGE.items() if isinstance(layout, tuple)])
def test_arrays_are_written_line_by_line(spark, tmp_path, name):
    """A file for each share, each what joining its documents gives, without a row as long as that."""
    opening, between, closing = _DAMAGE[name][0]
    keys = [*[f"{i:09}" for i in range(30)], None]
    documents = {k: '{"a":"' + 'x]}' * (i % 4) + f'{i}","r":[{{"b":[]}}]}}' for i, k in enumerate(keys)}
    frame = spark.createDataFrame([*documents.items()], f"{ORG} string, d string").repartition(5)
    share = F.pmod(F.xxhash64(ORG), F.lit(3))
    wanted = {}
    for k, n in frame.select(ORG, share).orderBy(F.asc_nulls_last(ORG)).collect():
        wanted.setdefault(n, []).append(documents[k])
    write_arrays(frame, frame.select(ORG), str(tmp_path / "a"), 3, opening, between, closing)
    files = {int(f.parent.name[4:]): f.read_text() for f in (tmp_path / "a").glob("del=*/*.txt")}
    assert files == {n: opening + between.join(mine) + closing for n, mine in wanted.items()}
    assert len(list((tmp_path / "a").glob("del=*/*.txt"))) == len(wanted)
