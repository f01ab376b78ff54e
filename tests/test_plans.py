"""What the plans must and must not contain."""

import re
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from fjordbook.operators import accounts as A
from fjordbook.operators import holdings as H
from fjordbook.operators import retrieval as X
from fjordbook.operators import search as S
from fjordbook.operators.keyed import lookup
from fjordbook.schema import ORG
from checks import standins

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Companies and accounts as stored tables."""
    root = str(tmp_path_factory.mktemp("stored"))
    for name in ("enheter", "regnskap"):
        standins.table(spark, SF, name).write.parquet(f"{root}/{name}")
    return {name: spark.read.parquet(f"{root}/{name}") for name in ("enheter", "regnskap")}


def test_search_filters_and_columns_reach_the_scan(spark, stored):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    spec = S.SearchSpec(orgform="MACH", ansatte=20, kommune="0312")
    text = plan(S.search(stored["enheter"], spec, date(2024, 1, 1)).select(ORG, "navn"))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    for part in ("IsNull(slettet_dato)", "EqualTo(organisasjonsform_kode,MACH)", "GreaterThanOrEqual(antall_ansatte,20)",
                 "EqualTo(forretningsadresse_kommunenummer,0312)"):
        assert part in pushed
    schema = re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    assert "kapital_belop" not in schema and "aktivitet" not in schema


def test_lookups_read_only_what_is_asked_for(spark, stored):
    from fjordbook.operators.spec import spec_rows
    r = standins.register(spark, SF)
    rows = spec_rows(stored["enheter"], r.municipalities, r.counties, r.industries, stored["regnskap"])
    text = plan(rows.select(ORG, "kommune"))
    schema = max((s for s in re.findall(r"ReadSchema: struct<(.*?)>", text) if "forretningsadresse_kommunenummer" in s), key=len)
    assert set(c.split(":")[0] for c in schema.split(",")) == {ORG, "forretningsadresse_kommunenummer", "naeringskode1_kode"} - (
        set() if "naeringskode1_kode" in schema else {"naeringskode1_kode"})


def test_latest_accounts_shuffle_once(stored):
    text = plan(A.latest_and_previous(stored["regnskap"]))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("WindowGroupLimit") == 2
    assert "EqualTo(valuta,NOK)" in text


def test_a_search_without_accounts_does_not_join_them(stored):
    assert "Join" not in plan(S.search(stored["enheter"], S.SearchSpec(q="x", aktive=True), date(2024, 1, 1)))


def test_owner_shares_combine_before_the_shuffle(spark):
    holdings = H.classify_holders(standins.table(spark, SF, "aksjonar_raw"), F.col("aar"))
    text = plan(H.holder_summary(holdings))
    assert text.count("HashAggregate") >= 2 and text.count("Exchange hashpartitioning(organisasjonsnummer") == 1


def test_neighbours_shuffle_only_the_best(spark):
    rows = [(i, np.ones(4).tolist()) for i in range(10)]
    vectors = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    text = plan(X.knn(vectors.withColumnRenamed("doc_id", "query_id"), vectors, 3))
    assert "FlatMapGroupsInPandas" in text and text.count("Exchange hashpartitioning") == 2 and "Join" not in text


def test_rows_without_a_key_are_spread(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(8000).select("id", F.when(F.col("id") % 100 == 0, F.col("id").cast("string")).alias("k"))
        names = spark.range(0, 8000, 100).select(F.col("id").cast("string").alias("k"), F.lit("n").alias("navn"))
        joined = lookup(rows, names, "k", "id")
        assert joined.filter("navn is not null").count() == 80 and joined.count() == 8000
        sizes = [r.n for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert max(sizes) < 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
