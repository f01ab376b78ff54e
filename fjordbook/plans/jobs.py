"""The load jobs: from files to published tables, each logged with its counts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from fjordbook.operators import accounts as A
from fjordbook.operators.holdings import classify_holders
from fjordbook.operators.quality import failure_rate, require
from fjordbook.operators.reconcile import (
    add_content_hash, load_counters, load_snapshot, one_per_key, reconcile_scd2, upsert_reference,
)
from fjordbook.operators.retrieval import embed_texts
from fjordbook.operators.selectors import needs_embedding
from fjordbook.schema import COMPANY_MAPPING, ORG, ROLE_DOCUMENT
from fjordbook.session import durable
from fjordbook.sources import files
from fjordbook.sources.dump import history_accounts, read_sql_dump
from fjordbook.sources.jsonarray import read_json_array
from fjordbook.sources.runs import RunLog
from fjordbook.sources.tables import TableStore, replace_partitions


def _stored(store: TableStore, name: str, like: DataFrame) -> DataFrame:
    """The live version of a table, or an empty one shaped like ``like``."""
    try:
        return store.read(name)
    except KeyError:
        return like.limit(0)


def load_companies(store: TableStore, runs: RunLog, path: str, as_of: date) -> DataFrame:
    """Full company file: upsert by content hash and move the deletion marks on, in one pass.

    Rows whose values do not fit, further rows of a company and rows without a key
    are set aside in ``enheter_avvist``. Their companies are in the file, so they
    are not missing; what is stored of them stays.
    """
    with runs.run("enheter") as counts:
        raw = f"{store.root}/enheter_raa"
        rows, rejects = files.read_mapped_csv(store.spark, path, land=raw)
        incoming, others = one_per_key(add_content_hash(rows, [c for _, c, _ in COMPANY_MAPPING]))
        others = others.drop("content_hash").withColumn("feil_kolonner", F.array(F.lit(ORG)))
        rejects = rejects.unionByName(others)
        loaded = load_snapshot(_stored(store, "enheter", incoming), incoming, as_of, rejected=rejects)
        written = Observation()
        gone = F.count_if(F.col("slettet_dato") == F.lit(as_of)).alias("slettet")
        stored, _ = store.publish_together({"enheter": loaded.observe(written, *load_counters(), gone), "enheter_avvist": rejects})
        counts.update(written.get)
    return stored.drop("utfall")


def load_roles(store: TableStore, runs: RunLog, path: str, as_of: date) -> DataFrame:
    """Full role file: flatten, keep what is unchanged, archive what ended."""
    with runs.run("roller") as counts:
        read = Observation()
        documents = durable(read_json_array(store.spark, path, ROLE_DOCUMENT).observe(read, F.count(F.lit(1)).alias("lest")))
        incoming = files.explode_roles(documents, store.read("enheter"))
        empty = incoming.withColumn("forst_sett", F.lit(as_of))
        current = _stored(store, "roller", empty)
        history = _stored(store, "roller_historikk", empty.withColumn("sist_sett", F.lit(as_of)))
        now, archive = reconcile_scd2(current, history, incoming, as_of, mark="_ny")
        before, written = store.size("roller_historikk"), Observation()
        watched = now.observe(written, F.count_if("_ny").alias("nye"), F.count_if(~F.col("_ny")).alias("uendret")).drop("_ny")
        stored, _ = store.publish_together({"roller": watched, "roller_historikk": archive})
        counts.update(read.get | written.get)
        counts["slettet"] = store.size("roller_historikk") - before
    return stored


def load_holdings(store: TableStore, runs: RunLog, path: str, year: int) -> DataFrame:
    """One year of the shareholder file; that year's partition is replaced, other years stay."""
    with runs.run("aksjonar") as counts:
        target = f"{store.root}/aksjonar"
        replace_partitions(classify_holders(files.read_holdings(store.spark, path), year), target, "regnskapsaar")
        stored = store.spark.read.parquet(target)
        counts["lest"] = counts["nye"] = stored.filter(F.col("regnskapsaar") == year).count()
    return stored


def load_history(store: TableStore, runs: RunLog, path: str) -> DataFrame:
    """Accounts history dump: only periods no source holds yet are added."""
    with runs.run("regnskap") as counts:
        incoming = history_accounts(read_sql_dump(store.spark, path), store.read("enheter"))
        merged = A.insert_absent(_stored(store, "regnskap", incoming), incoming, A.ACCOUNT_KEY)
        written = Observation()
        watched = A.backfill_currency(merged).observe(written, F.count_if(F.col("kilde") == "historikk").alias("nye"))
        stored = store.publish("regnskap", watched)
        counts["lest"] = counts["nye"] = written.get["nye"]
    return stored


def load_accounts(store: TableStore, runs: RunLog, path: str, attempts: DataFrame, max_failed: float = 0.10) -> DataFrame:
    """Landed accounts documents: they replace whole rows of the same period.

    Documents with values that do not fit are set aside in ``regnskap_avvist``, and
    what is stored of their periods stays. The job fails when more than ``max_failed`` of its fetches did, after the
    rows that did arrive are stored.
    """
    with runs.run("regnskap-api") as counts:
        read = Observation()
        good, rejects = files.read_accounts(store.spark, path)
        fetched = durable(good.observe(read, F.count(F.lit(1)).alias("lest")))
        existing = _stored(store, "regnskap", fetched)
        stored, _ = store.publish_together({"regnskap": A.merge_accounts(existing, fetched), "regnskap_avvist": rejects})
        store.publish("regnskap_hentelogg", A.latest_attempt(attempts))
        counts["lest"] = read.get["lest"]
        require(failure_rate(attempts, max_failed), "mislykket", "too many fetches failed")
    return stored


def load_reference(store: TableStore, name: str, incoming: DataFrame, key: str) -> DataFrame:
    return store.publish(name, upsert_reference(_stored(store, name, incoming), incoming, key))


def embed_companies(store: TableStore, runs: RunLog, embed, model: str) -> DataFrame:
    """Embed the companies whose text or model changed, and keep the other vectors."""
    with runs.run("embedding") as counts:
        companies = store.read("enheter")
        shape = f"{ORG} string, tekst_hash string, modell string, embedding array<float>"
        known = _stored(store, "enheter_embedding", store.spark.createDataFrame([], shape))
        todo = needs_embedding(companies, known, model)
        vectors = embed_texts(todo, embed, ORG, model).join(todo.select(ORG, "tekst_hash"), ORG)
        fresh = vectors.select(ORG, "tekst_hash", F.lit(model).alias("modell"), "embedding")
        kept = known.join(todo.select(ORG), ORG, "left_anti")
        stored = store.publish("enheter_embedding", kept.unionByName(fresh))
        counts["lest"] = store.size("enheter_embedding")
    return stored
