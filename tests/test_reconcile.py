from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from fjordbook.operators import accounts as A
from fjordbook.operators import reconcile as R
from fjordbook.schema import ORG, ROLE_DOCUMENT
from fjordbook.session import durable
from fjordbook.sources.files import explode_roles

DAY = date(2024, 3, 10)
STATE = "savnet_siden date, slettet_dato date"


def companies(spark, *records):
    frame = spark.createDataFrame(list(records), f"{ORG} string, navn string")
    return R.add_content_hash(frame, [ORG, "navn"])


def test_content_hash_tells_null_from_empty(spark):
    frame = spark.createDataFrame([("a", None, ""), ("a", "", None), ("a", None, "")], "x string, y string, z string")
    hashes = [r.content_hash for r in R.add_content_hash(frame).collect()]
    assert hashes[0] == hashes[2] != hashes[1]


def load(current, incoming, day):
    return {r[ORG]: (r.utfall, r.navn, r.savnet_siden, r.slettet_dato) for r in R.load_snapshot(current, incoming, day).collect()}


def test_load_snapshot_counts_and_is_idempotent(spark):
    current = companies(spark, ("1", "one"), ("2", "two"), ("3", "three"))
    incoming = companies(spark, ("1", "one"), ("2", "TWO"), ("4", "four"))
    snapshot, counts = R.hash_upsert(current, incoming)
    assert counts.first().asDict() == {"lest": 3, "nye": 1, "endret": 1, "uendret": 1}
    assert {r[ORG]: r.navn for r in snapshot.collect()} == {"1": "one", "2": "TWO", "3": "three", "4": "four"}
    again = R.hash_upsert(snapshot.drop("utfall"), incoming)[1]
    assert again.first().asDict() == {"lest": 3, "nye": 0, "endret": 0, "uendret": 3}


def test_missing_then_deleted_then_back(spark):
    here = companies(spark, ("1", "one"), ("2", "two"))
    gone = companies(spark, ("1", "one"))
    day1 = R.load_snapshot(here, gone, DAY)
    assert load(here, gone, DAY)["2"] == ("fravaerende", "two", DAY, None)
    within = R.load_snapshot(day1.drop("utfall"), gone, DAY + timedelta(6))
    assert {r[ORG]: r.slettet_dato for r in within.collect()} == {"1": None, "2": None}
    late = DAY + timedelta(7)
    confirmed = R.load_snapshot(within.drop("utfall"), gone, late).drop("utfall")
    assert {r[ORG]: (r.savnet_siden, r.slettet_dato) for r in confirmed.collect()}["2"] == (DAY, late)
    # The same file again changes nothing.
    again = R.load_snapshot(confirmed, gone, late + timedelta(1)).drop("utfall")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, confirmed.collect()))
    back = load(confirmed, here, late)
    assert back["2"] == ("uendret", "two", None, None)


def test_an_old_gap_confirms_at_once_but_a_new_one_never(spark):
    current = spark.createDataFrame([("1", None, None), ("2", DAY - timedelta(30), None), ("3", None, DAY)], f"{ORG} string, {STATE}")
    nothing = spark.createDataFrame([], f"{ORG} string")
    got = {r[ORG]: (r.overgang, r.savnet_siden, r.slettet_dato) for r in R.reconcile_deletions(current, nothing, DAY, grace_days=0).collect()}
    assert got == {"1": ("savnet", DAY, None), "2": ("bekreftet", DAY - timedelta(30), DAY), "3": (None, None, DAY)}


def test_deltas_replace_rows_and_clear_marks(spark):
    current = spark.createDataFrame(
        [("1", "one", "h1", DAY, DAY), ("2", "two", "h2", None, None), ("3", "three", "h3", None, DAY - timedelta(1))],
        f"{ORG} string, navn string, content_hash string, {STATE}")
    documents = spark.createDataFrame([("1", "ONE"), ("9", "nine")], f"{ORG} string, navn string")
    deleted = spark.createDataFrame([("2",), ("3",), ("8",)], f"{ORG} string")
    rows = R.apply_changes(current, documents, deleted, DAY)
    got = {r[ORG]: (r.navn, r.content_hash, r.slettet_dato, r.savnet_siden) for r in rows.collect()}
    assert got == {"1": ("ONE", None, None, None), "9": ("nine", None, None, None), "2": ("two", "h2", DAY, None),
                   "3": ("three", "h3", DAY - timedelta(1), None)}
    again = R.apply_changes(rows, documents, deleted, DAY)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)


ROLE = (f"{ORG} string, rollegruppe_kode string, rolletype_kode string, rekkefolge int, avregistrert boolean, person_fornavn string, "
        "person_etternavn string, person_fodselsdato date, innehaver_orgnr string")


def roles(spark, *records):
    return spark.createDataFrame(list(records), ROLE)


def test_role_history(spark):
    li = ("1", "STYR", "LEDE", 1, False, "Åse", "Li", date(1960, 1, 1), None)
    moe = ("1", "STYR", "MEDL", 2, False, "Per", "Moe", None, None)
    firm = ("2", "REVI", "REVI", None, False, None, None, None, "9")
    first = date(2020, 1, 1)
    current = roles(spark, li, moe).withColumn("forst_sett", F.lit(first))
    history = current.limit(0).withColumn("sist_sett", F.lit(DAY))
    li_ended = li[:4] + (True,) + li[5:]
    incoming = roles(spark, li_ended, firm)
    now, archive = R.reconcile_scd2(current, history, incoming, DAY)
    assert {r.rolletype_kode: (r.forst_sett, r.avregistrert) for r in now.collect()} == {"LEDE": (first, True), "REVI": (DAY, False)}
    assert [(r.person_etternavn, r.forst_sett, r.sist_sett) for r in archive.collect()] == [("Moe", first, DAY)]
    later, archive2 = R.reconcile_scd2(now, archive, incoming, DAY + timedelta(1))
    assert sorted(map(tuple, later.select(*now.columns).collect()), key=repr) == sorted(map(tuple, now.collect()), key=repr)
    assert archive2.count() == 1


def feed(spark, *events):
    return spark.createDataFrame(list(events), f"oppdateringsid long, {ORG} string, endringstype string")


def brute_batch(events, cursor, cap):
    seen, out = set(), []
    for event in sorted(events):
        if event[0] <= cursor:
            continue
        if len(seen) >= cap and event[1] not in seen:
            break
        seen.add(event[1])
        out.append(event)
    return out


@pytest.mark.parametrize("cap", [1, 2, 3, 50])
def test_capped_batches_cover_the_feed_without_gaps(spark, cap):
    import random
    rng = random.Random(cap)
    events = [(i * 3, str(rng.randint(1, 6)), rng.choice(["Ny", "Endring", "Sletting"])) for i in range(40)]
    frame = feed(spark, *events)
    cursor, covered = 20, []
    while True:
        batch = sorted(map(tuple, R.next_change_batch(frame, cursor, cap)[0].collect()))
        assert batch == brute_batch(events, cursor, cap)
        if not batch:
            break
        covered += batch
        cursor = batch[-1][0]
    assert covered == [e for e in events if e[0] > 20]


def test_last_change_wins(spark):
    got = R.last_changes(feed(spark, (1, "a", "Ny"), (5, "a", "Sletting"), (2, "b", "Fjernet"), (9, "b", "Endring")))
    assert {r[ORG]: (r.oppdateringsid, r.slettes) for r in got.collect()} == {"a": (5, True), "b": (9, False)}


def accounts(spark, *records):
    schema = (f"{ORG} string, regnskapstype string, periode_til date, valuta string, kilde string, "
              + ", ".join(f"{c} decimal(20,2)" for c in A.LATEST_AMOUNTS))
    padded = [(o, t, date(y, 12, 31), v, k, *([None if r is None else r] + [0] * 6)) for o, t, y, v, k, r in records]
    from decimal import Decimal
    padded = [tuple(Decimal(x) if isinstance(x, int) else x for x in p) for p in padded]
    return spark.createDataFrame(padded, schema)


def test_latest_accounts_edge_cases(spark):
    frame = accounts(
        spark,
        ("tie", "KONSERN", 2023, "NOK", "x", 900), ("tie", "SELSKAP", 2023, "NOK", "x", 100), ("tie", "SELSKAP", 2022, "NOK", "x", 80),
        ("usd", "SELSKAP", 2023, "USD", "x", 5), ("usd", "SELSKAP", 2021, "NOK", "x", 7),
        ("wild", "SELSKAP", 2023, "NOK", "x", 51_000), ("wild", "SELSKAP", 2022, "NOK", "x", 1_000),
        ("edge", "SELSKAP", 2023, "NOK", "x", 50_000), ("edge", "SELSKAP", 2022, "NOK", "x", 1_000),
        ("null", "SELSKAP", 2023, "NOK", "x", None), ("null", "SELSKAP", 2022, "NOK", "x", 1_000),
        ("neg", "SELSKAP", 2023, "NOK", "x", 9_000_000), ("neg", "SELSKAP", 2022, "NOK", "x", -1),
        ("one", "SELSKAP", 2020, "NOK", "x", 10),
    )
    got = {r[ORG]: r for r in A.latest_and_previous(frame).collect()}
    assert (got["tie"].sum_driftsinntekter, got["tie"].forrige_inntekter, float(got["tie"].vekst_prosent)) == (100, 80, 25.0)
    assert (got["usd"].aar, got["usd"].forrige_inntekter) == (2021, None)
    assert [got[k].rimelig for k in ("wild", "edge", "null", "neg", "one")] == [False, True, None, True, True]
    assert got["neg"].vekst_prosent is None


def test_api_rows_win_whole_and_currency_is_filled(spark):
    history = accounts(spark, ("a", "SELSKAP", 2022, None, "historikk", 10), ("a", "SELSKAP", 2021, None, "historikk", 9), ("b", "SELSKAP", 2021, None, "historikk", 1))
    api = accounts(spark, ("a", "SELSKAP", 2022, "USD", "brreg-api", 11))
    merged = A.merge_accounts(history, api)
    got = {(r[ORG], r.periode_til.year): (r.valuta, r.kilde, int(r.sum_driftsinntekter)) for r in A.backfill_currency(merged).collect()}
    assert got == {("a", 2022): ("USD", "brreg-api", 11), ("a", 2021): ("USD", "historikk", 9), ("b", 2021): ("NOK", "historikk", 1)}


def test_year_on_year_compares_like_with_like(spark):
    frame = accounts(spark, ("a", "SELSKAP", 2022, "NOK", "x", -50), ("a", "KONSERN", 2022, "NOK", "x", 7), ("a", "SELSKAP", 2023, "NOK", "x", 25))
    got = {(r.regnskapstype, r.periode_til.year): (r.sum_driftsinntekter_endring, r.sum_driftsinntekter_retning)
           for r in A.year_on_year(frame, ["sum_driftsinntekter"]).collect()}
    assert got[("SELSKAP", 2023)] == (150, "opp") and got[("SELSKAP", 2022)] == (None, None) and got[("KONSERN", 2022)] == (None, None)


def test_smallest_bar_is_one_percent(spark):
    frame = accounts(spark, ("a", "SELSKAP", 2022, "NOK", "x", 1), ("a", "SELSKAP", 2023, "NOK", "x", -1000), ("z", "SELSKAP", 2023, "NOK", "x", 0))
    got = sorted((r[ORG], r.periode_til.year, r.andel_av_maks) for r in A.share_of_max(frame).collect())
    assert got == [("a", 2022, 1.0), ("a", 2023, 100.0), ("z", 2023, 1.0)]


def test_sides_that_grow_are_not_broadcast(spark):
    """Roles and companies may be small files and many rows: the driver holds none of them."""
    fields = ["rollegruppe_kode", "rolletype_kode", "innehaver_orgnr", "person_etternavn", "person_fornavn"]
    roles = durable(spark.createDataFrame([("1", "STYR", "LEDE", None, "B", "A", DAY, 1)], f"{ORG} string, {', '.join(f + ' string' for f in fields)}, person_fodselsdato date, rekkefolge int"))
    current = roles.withColumn("forst_sett", F.lit(DAY))
    now, history = R.reconcile_scd2(current, current.limit(0).withColumn("sist_sett", F.lit(DAY)), roles, DAY)
    documents = durable(spark.createDataFrame([], ROLE_DOCUMENT))
    stored = durable(companies(spark, ("1", "one")))
    loaded = R.load_snapshot(stored, stored, DAY, rejected=stored)
    for frame in (now, history, explode_roles(documents, roles), loaded):
        assert "BroadcastHashJoin" not in frame._jdf.queryExecution().executedPlan().toString()
    assert [r.forst_sett for r in now.collect()] == [DAY] and history.count() == 0
