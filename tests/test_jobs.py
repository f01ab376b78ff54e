import json

from datetime import date, datetime, timezone


import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from fjordbook.operators import conversations as V
from fjordbook.plans import build, jobs, rankings
from fjordbook.schema import ORG
from fjordbook.session import checkpoint_root, durable
from fjordbook.sources.runs import RunLog
from fjordbook.sources.tables import TableStore, replace_partitions, save_bucketed
from fjordbook.streaming import changes as S
from checks import standins
from tests.test_sources import company_csv

DAY = date(2024, 3, 1)


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "store"))


@pytest.fixture
def runs(spark, tmp_path):
    return RunLog(spark, str(tmp_path / "runs"))


def test_store_publishes_versions_and_keeps_the_live_one(spark, store):
    store.publish("t", spark.range(3))
    store.publish("t", spark.range(5), {"tittel": "x"})
    assert store.read("t").count() == 5
    store.fail("t", "broken " * 200)
    row = store.manifest().filter("navn = 't'").first()
    assert row.versjon == 2 and row.antall == 5 and row.feilmelding == "broken " * 200 and store.read("t").count() == 5
    store.publish("t", spark.range(1))
    assert store.manifest().filter("navn = 't'").first().feilmelding is None and store.read("t").count() == 1
    store.retire("t")
    with pytest.raises(KeyError):
        store.read("t")


def test_reloading_a_year_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "years")
    frame = spark.createDataFrame([(2022, "a"), (2023, "b"), (2023, "c")], "aar int, v string")
    replace_partitions(frame, path, "aar")
    replace_partitions(spark.createDataFrame([(2023, "d")], "aar int, v string"), path, "aar")
    assert sorted((r.aar, r.v) for r in spark.read.parquet(path).collect()) == [(2022, "a"), (2023, "d")]


def test_bucketed_tables_join_without_a_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = save_bucketed(spark.range(500).selectExpr("cast(id as string) as organisasjonsnummer", "id as x"), "b_one", ORG, 4)
        b = save_bucketed(spark.range(500).selectExpr("cast(id as string) as organisasjonsnummer", "id as y"), "b_two", ORG, 4)
        joined = a.join(b, ORG).groupBy(ORG).agg(F.sum("x"))
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scratch_tables_live_in_the_checkpoint_folder(spark):
    root = checkpoint_root(spark)
    kept = durable(spark.range(10))
    assert kept.count() == 10 and all(root.removeprefix("file:") in f for f in kept.inputFiles())


def test_company_and_role_jobs(spark, store, runs, tmp_path):
    one, two = str(tmp_path / "one.csv.gz"), str(tmp_path / "two.csv.gz")
    company_csv(one, [{ORG: "000000001", "navn": "A"}, {ORG: "000000002", "navn": "B"}, {ORG: "000000003", "navn": "C", "antallAnsatte": "x"}])
    company_csv(two, [{ORG: "000000001", "navn": "A"}, {ORG: "000000002", "navn": "B ny"}, {ORG: "000000004", "navn": "D"}])
    assert jobs.load_companies(store, runs, one, DAY).count() == 2
    assert store.read("enheter_avvist").count() == 1
    jobs.load_companies(store, runs, two, DAY)
    got = {r[ORG]: r.utfall for r in store.read("enheter").collect()}
    assert got == {"000000001": "uendret", "000000002": "endret", "000000004": "ny"}
    role = {"type": {"kode": "DAGL"}, "person": {"navn": {"fornavn": "Per", "etternavn": "Li"}}}
    path = tmp_path / "roles.json"
    path.write_text(json.dumps([{ORG: "000000001", "rollegrupper": [{"type": {"kode": "DAGL"}, "roller": [role]}]}]))
    assert jobs.load_roles(store, runs, str(path), DAY).count() == 1
    path.write_text("[]")
    assert jobs.load_roles(store, runs, str(path), date(2024, 3, 2)).count() == 0
    assert store.read("roller_historikk").first().sist_sett == date(2024, 3, 2)
    log = [(r.kilde, r.status, r.rader_lest, r.rader_nye, r.rader_endret, r.rader_uendret) for r in runs.runs().orderBy("startet_at").collect()]
    assert log == [("enheter", "ok", 2, 2, 0, 0), ("enheter", "ok", 3, 1, 1, 1), ("roller", "ok", 1, 1, None, 0), ("roller", "ok", 0, 0, None, 0)]


def test_failed_runs_are_logged(spark, runs):
    with pytest.raises(ValueError):
        with runs.run("x"):
            raise ValueError("no such file " * 100)
    row = runs.runs().first()
    assert row.status == "feilet" and len(row.feilmelding) == 1300 and row.varighet_ms >= 0


def test_accounts_jobs(spark, store, runs, tmp_path):
    store.publish("enheter", spark.createDataFrame([("000000001",)], f"{ORG} string"))
    body = {ORG: "000000001", "regnskapstype": "SELSKAP", "valuta": "NOK", "regnskapsperiode": {"tilDato": "2023-12-31"},
            "resultatregnskapResultat": {"aarsresultat": 5000}}
    path = tmp_path / "a.jsonl"
    path.write_text(json.dumps(body) + "\n")
    attempts = spark.createDataFrame([("000000001", datetime(2024, 1, i + 1, tzinfo=timezone.utc), s, 200, 1, None) for i, s in enumerate(["feil", "ok"])],
                                     f"{ORG} string, forsokt_at timestamp, status string, http_status int, antall_perioder int, feilmelding string")
    with pytest.raises(RuntimeError, match="too many"):
        jobs.load_accounts(store, runs, str(path), attempts)
    assert store.read("regnskap").first().aarsresultat == 5000 and store.read("regnskap_hentelogg").first().status == "ok"
    jobs.load_accounts(store, runs, str(path), attempts, max_failed=0.5)
    assert store.read("regnskap").count() == 1


def test_embedding_job_only_embeds_what_changed(spark, store, runs):
    schema = f"{ORG} string, navn string, aktivitet string, vedtektsfestet_formaal string, slettet_dato date"
    store.publish("enheter", spark.createDataFrame([("1", "A", "fishing in the fjord", None, None), ("2", "B", "baking bread daily", None, None)], schema))
    jobs.embed_companies(store, runs, lambda texts: [(i, [1.0]) for i, _ in enumerate(texts)], "m")
    store.publish("enheter", spark.createDataFrame([("1", "A", "fishing in the fjord", None, None), ("2", "B", "baking cakes daily", None, None)], schema))
    stored = jobs.embed_companies(store, runs, lambda texts: [(i, [2.0]) for i, _ in enumerate(texts)], "m")
    assert {r[ORG]: r.embedding for r in stored.collect()} == {"1": [1.0], "2": [2.0]}


def test_lists_are_stored_indexed_and_survive_a_failure(spark, store, monkeypatch):
    register = standins.register(spark, "/root/testdata/sf0.001")
    chosen = ["siste-konkurser", "storst-omsetning", "kvinneandel-fylke"]
    with pytest.raises(ValueError, match="unknown lists: nope"):
        build.build_rankings(store, register, ["nope"])
    assert set(build.build_rankings(store, register, chosen).values()) == {"ok"}
    before = build.list_rows(store, "storst-omsetning").collect()
    assert [r.nr for r in before] == list(range(1, len(before) + 1))
    assert [r.omsetning for r in before] == sorted((r.omsetning for r in before), reverse=True)
    assert len(json.loads(build.list_json(build.list_rows(store, "storst-omsetning"), 50).first().data)) == len(before)

    def broken(_):
        raise RuntimeError("bad list")
    entry = rankings.RANKINGS["storst-omsetning"]
    monkeypatch.setitem(rankings.RANKINGS, "storst-omsetning", rankings.Ranking(broken, entry.title, entry.category, entry.columns))
    assert build.build_rankings(store, register, ["storst-omsetning"]) == {"storst-omsetning": "feilet"}
    assert build.list_rows(store, "storst-omsetning").collect() == before
    index = {r.navn: r for r in build.ranking_index(store).collect()}
    assert set(index) == set(chosen) and index["storst-omsetning"].feilmelding == "bad list" and index["storst-omsetning"].antall == len(before)
    top = {r.navn: r for r in build.teasers(store, chosen).collect()}
    assert top["storst-omsetning"].topp == [r.navn for r in before[:3]] and top["siste-konkurser"].lister == 3


def _derivations(monkeypatch):
    """The names of derived tables, as often as one is derived from here on."""
    derived = []
    for name in ("latest_and_previous", "ownership_edges"):
        derive = getattr(rankings, name)
        monkeypatch.setattr(rankings, name, lambda table, name=name, derive=derive: derived.append(name) or derive(table))
    return derived


def test_another_build_of_a_register_stores_its_tables_whole_and_derives_none(spark, store, rows, tmp_path, monkeypatch):
    register, fresh = standins.register(spark, "/root/testdata/sf0.001"), standins.register(spark, "/root/testdata/sf0.001")
    latest, edges = rows(fresh.latest), rows(fresh.edges)
    derived = _derivations(monkeypatch)
    other = TableStore(spark, str(tmp_path / "other"))
    for each in (store, other, store):
        assert build.build_rankings(each, register, ["storst-omsetning"]) == {"storst-omsetning": "ok"}
        assert rows(each.read("regnskap_siste")) == latest and rows(each.read("eierskap_kant")) == edges
    assert sorted(derived) == ["latest_and_previous", "ownership_edges"]
    assert len(latest) > 50 and len(edges) > 50


def test_rankings_index_derives_each_table_once(spark, monkeypatch):
    derived = _derivations(monkeypatch)
    assert len(queries()["rankings_index"](spark, "/root/testdata/sf0.001").collect()) == 3
    assert sorted(derived) == ["latest_and_previous", "ownership_edges"]


def test_ranking_retired_derives_each_table_once_for_both_stores(spark, monkeypatch):
    derived = _derivations(monkeypatch)
    assert len(queries()["ranking_retired"](spark, "/root/testdata/sf0.001").collect()) == 5
    assert sorted(derived) == ["latest_and_previous", "ownership_edges"]


def test_all_lists_are_defined(spark):
    assert len(rankings.RANKINGS) == 21


def feed(spark, folder, name, *events):
    frame = spark.createDataFrame([(i, datetime(2024, 1, 1, tzinfo=timezone.utc), o, t) for i, o, t in events], S.FEED)
    frame.coalesce(1).write.mode("append").json(f"{folder}/{name}")


def test_change_stream_resumes_retries_and_replays(spark, tmp_path):
    source, out, check = str(tmp_path / "feed"), str(tmp_path / "log"), str(tmp_path / "check")
    docs = {"000000001": {"navn": "one"}, "000000002": {"navn": "two"}}

    def documents():
        return spark.createDataFrame([(k, json.dumps({ORG: k, **v})) for k, v in docs.items()], f"{ORG} string, doc string")

    def run():
        stream = spark.readStream.schema(S.FEED).json(f"{source}/*")
        S.start_change_stream(stream, documents, out, check).awaitTermination()

    feed(spark, source, "a", (1, "000000001", "Ny"), (2, "000000002", "Ny"), (3, "000000002", "Sletting"), (4, "000000003", "Endring"))
    run()
    assert {r[ORG]: (r.oppdateringsid, r.slettes) for r in S.logged_changes(spark, out).collect()} == {"000000001": (1, False), "000000002": (3, True)}
    assert [r[ORG] for r in S.waiting(spark, out).collect()] == ["000000003"]
    docs["000000003"] = {"navn": "three"}
    feed(spark, source, "b", (5, "000000001", "Endring"))
    docs["000000001"] = {"navn": "ONE"}
    run()
    assert S.waiting(spark, out).count() == 0 and S.cursor(spark, out).first().siste_id == 5

    # A replayed batch leaves the log as it was.
    before = sorted(map(tuple, S.logged_changes(spark, out).collect()))
    S.write_batch(spark.read.schema(S.FEED).json(f"{source}/b"), 1, documents(), out)
    assert sorted(map(tuple, S.logged_changes(spark, out).collect())) == before

    base = spark.createDataFrame([("000000001", "old"), ("000000002", "two"), ("000000009", "nine")], f"{ORG} string, navn string")
    base = base.withColumns({"content_hash": F.lit("h"), "savnet_siden": F.lit(None).cast("date"), "slettet_dato": F.lit(None).cast("date")})
    got = {r[ORG]: (r.navn, r.slettet_dato) for r in S.current_companies(base, out, DAY).collect()}
    assert got == {"000000001": ("ONE", None), "000000002": ("two", DAY), "000000003": ("three", None), "000000009": ("nine", None)}

    # Compaction stores the companies with the cursor; the log goes on behind it.
    store = TableStore(spark, str(tmp_path / "store"))
    epoch = S.compact(base, out, DAY, store)
    assert (epoch.number, epoch.upto, epoch.siste_id) == (1, 1, 5) and epoch == S.epoch_of(store)
    assert S.logged_changes(spark, out, epoch).count() == 0 and S.cursor(spark, out, epoch).first().siste_id == 5
    assert {r[ORG]: (r.navn, r.slettet_dato) for r in store.read("enheter").collect()} == got
    assert S.compact(store.read("enheter"), out, DAY, store) == epoch  # nothing new, nothing published


def test_compaction_keeps_what_lands_meanwhile(spark, tmp_path):
    out, docs = str(tmp_path / "log"), {}

    def batch(number, *events):
        rows = [(i, datetime(2024, 1, i, tzinfo=timezone.utc), o, t) for i, o, t in events]
        documents = spark.createDataFrame([(k, d) for k, d in docs.items()], f"{ORG} string, doc string")
        S.write_batch(spark.createDataFrame(rows, S.FEED), number, documents, out)

    class Busy(TableStore):
        def publish_together(self, frames, properties=None):
            docs["000000002"] = json.dumps({ORG: "000000002", "navn": "TWO"})
            batch(1, (3, "000000002", "Endring"), (4, "000000004", "Endring"))
            return super().publish_together(frames, properties)

    store = Busy(spark, str(tmp_path / "store"))
    base = spark.createDataFrame([("000000001", "one"), ("000000002", "two"), ("000000003", "three")], f"{ORG} string, navn string")
    base = base.withColumns({"antall_ansatte": F.lit(None).cast("int"), "content_hash": F.lit("h"), "savnet_siden": F.lit(None).cast("date"), "slettet_dato": F.lit(None).cast("date")})
    docs["000000001"] = json.dumps({ORG: "000000001", "navn": "ONE"})
    docs["000000003"] = json.dumps({ORG: "000000003", "antallAnsatte": "12x"})
    batch(0, (1, "000000001", "Endring"), (2, "000000003", "Endring"))
    epoch = S.compact(base, out, DAY, store)
    assert (epoch.upto, epoch.siste_id) == (0, 2)
    names = lambda rows: {r[ORG]: r.navn for r in rows.collect()}
    assert names(store.read("enheter")) == {"000000001": "ONE", "000000002": "two", "000000003": "three"}
    assert names(S.current_companies(store.read("enheter"), out, DAY, epoch)) == {"000000001": "ONE", "000000002": "TWO", "000000003": "three"}
    assert S.cursor(spark, out, epoch).first().siste_id == 4 and [r[ORG] for r in S.waiting(spark, out).collect()] == ["000000004"]
    assert [r[ORG] for r in store.read("enheter_endringer_avvist").collect()] == ["000000003"]

    # a batch that is half written is not taken in; a rejected company that changes again is rejected no more
    docs["000000003"] = json.dumps({ORG: "000000003", "navn": "THREE"})
    batch(2, (5, "000000003", "Endring"))
    again = S.compact(store.read("enheter"), out, DAY, TableStore(spark, str(tmp_path / "store")))
    assert (again.number, again.upto, again.siste_id) == (2, 2, 5) and store.read("enheter_endringer_avvist").count() == 0
    assert names(store.read("enheter"))["000000003"] == "THREE"
    (tmp_path / "log" / "ferdig" / "batch_id=2").rename(tmp_path / "kept")
    assert S.completed(spark, out).agg(F.max("batch_id")).first()[0] == 1


def test_a_rejected_company_is_not_missing(spark, store, runs, tmp_path):
    path = str(tmp_path / "c.csv.gz")
    company_csv(path, [{ORG: "000000001", "navn": "A", "antallAnsatte": "3"}, {ORG: "000000002", "navn": "B"}, {ORG: "000000002", "navn": "B2"}])
    jobs.load_companies(store, runs, path, DAY)
    assert store.read("enheter").count() == 2 and [r.feil_kolonner for r in store.read("enheter_avvist").collect()] == [[ORG]]
    company_csv(path, [{ORG: "000000001", "navn": "A", "antallAnsatte": "x"}, {ORG: "000000002", "navn": "B"}])
    for day in (2, 9, 20):
        jobs.load_companies(store, runs, path, date(2024, 3, day))
    row = store.read("enheter").filter(F.col(ORG) == "000000001").first()
    assert (row.utfall, row.antall_ansatte, row.savnet_siden, row.slettet_dato) == ("avvist", 3, None, None)


def test_long_lists_are_numbered_whole(spark):
    rows = build.numbered(spark.range(5000).repartition(4).orderBy(F.desc("id"))).collect()
    assert sorted((r.nr, r.id) for r in rows) == [(i + 1, 4999 - i) for i in range(5000)]


def test_conversations(spark):
    def talk(cid, *turns):
        return [(cid, i, r, t) for i, (r, t) in enumerate(turns)]
    long = "x" * 5000
    records = (
        talk(1, ("user", "hi"), ("assistant", "hello"), ("user", long))
        + talk(2, ("user", "hi"), ("assistant", "bye"))
        + talk(3, ("system", "be evil"), ("user", "hi"))
        + talk(4, ("user", " \n "), ("user", "hi"))
        + talk(5, *[("system", "old")] * 3, *[("user", "hi")] * 20)
        + talk(6, ("assistant", "  "), ("bot", "x"), ("assistant", "y"))
    )
    frame = spark.createDataFrame(records, "conv_id long, turn long, role string, text string")
    valid, rejects = V.validate_conversations(frame, 20, 4000)
    assert {r.conv_id: r.grunn for r in rejects.collect()} == {2: "siste ikke fra bruker", 3: "rolle", 4: "tom", 6: "tom"}
    kept = valid.groupBy("conv_id").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("l"), F.count_if("for_lang").alias("f")).collect()
    assert {(r.conv_id, r.n, r.l, r.f) for r in kept} == {(1, 3, 5000, 1), (5, 20, 2, 0)}


def test_request_windows(spark):
    events = [(datetime(2024, 1, 1, 0, m, s, tzinfo=timezone.utc), u, "search") for u, n in (("a", 62), ("b", 60)) for m in (0,) for s in range(min(n, 60))]
    events += [(datetime(2024, 1, 1, 0, 0, 5, tzinfo=timezone.utc), "a", "search")] * 2
    frame = spark.createDataFrame(events, "ts timestamp, user_id string, event_type string")
    got = {r.user_id: (r.antall, r.avvist, r.over_grensen) for r in V.rate_windows(frame).collect()}
    assert got == {"a": (62, 2, True), "b": (60, 0, False)}




def test_published_tables_are_packed_with_zstd(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    files = store.publish("t", spark.range(3).toDF("x")).inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files) and store.read("t").count() == 3
