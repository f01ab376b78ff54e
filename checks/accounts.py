"""Accounts: latest figures, changes over time, merging sources."""

from pyspark.sql import functions as F

from checks.registry import LATEST, check
from checks.standins import load, table
from fjordbook.functions import cleaning as C
from fjordbook.operators import accounts as A
from fjordbook.schema import ACCOUNT_KEY, ORG


@check("latest_accounts", tables="regnskap", ctes=LATEST, oracle="""
SELECT organisasjonsnummer, cast(periode_til AS VARCHAR) AS periode_til, aar, cast(sum_driftsinntekter AS DOUBLE) AS sum_driftsinntekter,
       cast(sum_driftskostnad AS DOUBLE) AS sum_driftskostnad, cast(driftsresultat AS DOUBLE) AS driftsresultat,
       cast(aarsresultat AS DOUBLE) AS aarsresultat, cast(sum_eiendeler AS DOUBLE) AS sum_eiendeler,
       cast(sum_egenkapital AS DOUBLE) AS sum_egenkapital, cast(sum_gjeld AS DOUBLE) AS sum_gjeld,
       cast(forrige_inntekter AS DOUBLE) AS forrige_inntekter, cast(forrige_periode AS VARCHAR) AS forrige_periode,
       cast(vekst_prosent AS DOUBLE) AS vekst_prosent, rimelig FROM latest""")
def latest_accounts(spark, sf_dir):
    return A.latest_and_previous(table(spark, sf_dir, "regnskap"))


@check("newest_any_currency", tables="regnskap", oracle="""
SELECT organisasjonsnummer, cast(periode_til AS VARCHAR) AS periode_til, regnskapstype,
       cast(sum_driftsinntekter AS DOUBLE) AS sum_driftsinntekter, cast(aarsresultat AS DOUBLE) AS aarsresultat
FROM (SELECT *, row_number() OVER (PARTITION BY organisasjonsnummer ORDER BY periode_til DESC, regnskapstype DESC) AS r FROM regnskap) t
WHERE r = 1""")
def newest_any_currency(spark, sf_dir):
    return A.newest_any_currency(table(spark, sf_dir, "regnskap"))


def _yoy_sql(field: str) -> str:
    window = "OVER (PARTITION BY organisasjonsnummer, regnskapstype, valuta ORDER BY periode_til)"
    return f"cast({field} AS DOUBLE) AS {field}_naa, cast(lag({field}) {window} AS DOUBLE) AS {field}_foer"


@check("yoy_change", tables="regnskap", oracle=f"""
SELECT organisasjonsnummer, regnskapstype, cast(periode_til AS VARCHAR) AS periode_til, valuta,
       round(CASE WHEN sum_driftsinntekter_foer <> 0 THEN (sum_driftsinntekter_naa - sum_driftsinntekter_foer) / abs(sum_driftsinntekter_foer) * 100 END, 6) AS inntekt_endring,
       CASE WHEN sum_driftsinntekter_foer <> 0 AND sum_driftsinntekter_naa > sum_driftsinntekter_foer THEN 'opp'
            WHEN sum_driftsinntekter_foer <> 0 AND sum_driftsinntekter_naa < sum_driftsinntekter_foer THEN 'ned' END AS inntekt_retning,
       round(CASE WHEN aarsresultat_foer <> 0 THEN (aarsresultat_naa - aarsresultat_foer) / abs(aarsresultat_foer) * 100 END, 6) AS resultat_endring,
       round(CASE WHEN sum_gjeld_foer <> 0 THEN (sum_gjeld_naa - sum_gjeld_foer) / abs(sum_gjeld_foer) * 100 END, 6) AS gjeld_endring,
       cast(NULL AS VARCHAR) AS gjeld_retning
FROM (SELECT *, {_yoy_sql('sum_driftsinntekter')}, {_yoy_sql('aarsresultat')}, {_yoy_sql('sum_gjeld')} FROM regnskap) t""")
def yoy_change(spark, sf_dir):
    rows = A.year_on_year(table(spark, sf_dir, "regnskap"), ["sum_driftsinntekter", "aarsresultat", "sum_gjeld"])
    return rows.select(
        ORG, "regnskapstype", "periode_til", "valuta",
        F.round(F.col("sum_driftsinntekter_endring").cast("double"), 6).alias("inntekt_endring"),
        F.col("sum_driftsinntekter_retning").alias("inntekt_retning"),
        F.round(F.col("aarsresultat_endring").cast("double"), 6).alias("resultat_endring"),
        F.round(F.col("sum_gjeld_endring").cast("double"), 6).alias("gjeld_endring"),
        F.col("sum_gjeld_retning").alias("gjeld_retning"),
    )


@check("bar_share", tables="regnskap", oracle="""
SELECT organisasjonsnummer, regnskapstype, cast(periode_til AS VARCHAR) AS periode_til,
       round(greatest(1.0, cast(abs(aarsresultat) AS DOUBLE) / cast(greatest(max(abs(aarsresultat)) OVER (PARTITION BY organisasjonsnummer), 1) AS DOUBLE) * 100), 6) AS andel_av_maks
FROM regnskap""")
def bar_share(spark, sf_dir):
    rows = A.share_of_max(table(spark, sf_dir, "regnskap"), "aarsresultat")
    return rows.select(ORG, "regnskapstype", "periode_til", F.round("andel_av_maks", 6).alias("andel_av_maks"))


_TWO_SOURCES = """hist AS (SELECT * REPLACE ('historikk' AS kilde, cast(NULL AS VARCHAR) AS valuta) FROM regnskap WHERE year(periode_til) <= 1999),
api AS (SELECT * REPLACE ('brreg-api' AS kilde, sum_gjeld + 1000 AS sum_gjeld) FROM regnskap WHERE year(periode_til) >= 1998)"""

_ACCOUNT_SQL = """organisasjonsnummer, regnskapstype, cast(periode_til AS VARCHAR) AS periode_til, valuta, kilde,
       cast(sum_driftsinntekter AS DOUBLE) AS sum_driftsinntekter, cast(sum_gjeld AS DOUBLE) AS sum_gjeld"""
_ACCOUNT = [ORG, "regnskapstype", "periode_til", "valuta", "kilde", "sum_driftsinntekter", "sum_gjeld"]


def _two_sources(spark, sf_dir):
    rows = table(spark, sf_dir, "regnskap")
    year = F.year("periode_til")
    history = rows.filter(year <= 1999).withColumns({"kilde": F.lit("historikk"), "valuta": F.lit(None).cast("string")})
    raised = (F.col("sum_gjeld") + 1000).cast("decimal(20,2)")
    api = rows.filter(year >= 1998).withColumns({"kilde": F.lit("brreg-api"), "sum_gjeld": raised})
    return history, api


@check("source_priority_upsert", tables="regnskap", ctes=_TWO_SOURCES, oracle=f"""
SELECT {_ACCOUNT_SQL} FROM api
UNION ALL
SELECT {_ACCOUNT_SQL} FROM hist h WHERE NOT EXISTS (SELECT 1 FROM api a WHERE a.organisasjonsnummer = h.organisasjonsnummer
  AND a.regnskapstype = h.regnskapstype AND a.periode_til = h.periode_til)""")
def source_priority_upsert(spark, sf_dir):
    return A.merge_accounts(*_two_sources(spark, sf_dir)).select(*_ACCOUNT)


@check("accounts_refetch", tables="regnskap", ctes=_TWO_SOURCES, oracle=f"""
SELECT {_ACCOUNT_SQL} FROM (SELECT * REPLACE (CASE WHEN organisasjonsnummer LIKE '%4' THEN sum_gjeld + 7000 ELSE sum_gjeld END AS sum_gjeld) FROM api) a
UNION ALL
SELECT {_ACCOUNT_SQL} FROM hist h ANTI JOIN api a ON a.organisasjonsnummer = h.organisasjonsnummer AND a.regnskapstype = h.regnskapstype AND a.periode_til = h.periode_til""")
def accounts_refetch(spark, sf_dir):
    """Some accounts fetched before arrive again, corrected: the stored rows give way."""
    history, api = _two_sources(spark, sf_dir)
    again = api.filter(F.col(ORG).endswith("4")).withColumn("sum_gjeld", (F.col("sum_gjeld") + 7000).cast("decimal(20,2)"))
    return A.merge_accounts(A.merge_accounts(history, api), again).select(*_ACCOUNT)


@check("insert_absent_rows", tables="regnskap", ctes=_TWO_SOURCES, oracle=f"""
SELECT {_ACCOUNT_SQL} FROM api
UNION ALL
SELECT {_ACCOUNT_SQL} FROM hist WHERE (organisasjonsnummer, regnskapstype, periode_til) NOT IN
  (SELECT (organisasjonsnummer, regnskapstype, periode_til) FROM api)""")
def insert_absent_rows(spark, sf_dir):
    history, api = _two_sources(spark, sf_dir)
    return A.insert_absent(api, history, ACCOUNT_KEY).select(*_ACCOUNT)


@check("currency_backfill", tables="regnskap", oracle="""
, api AS (SELECT organisasjonsnummer, arg_max(valuta, (periode_til, valuta)) AS v FROM regnskap
     WHERE kilde = 'brreg-api' AND valuta IS NOT NULL GROUP BY 1)
SELECT r.organisasjonsnummer, regnskapstype, cast(periode_til AS VARCHAR) AS periode_til, kilde,
       coalesce(CASE WHEN kilde = 'historikk' THEN v END, valuta, 'NOK') AS valuta
FROM regnskap r LEFT JOIN api USING (organisasjonsnummer)""")
def currency_backfill(spark, sf_dir):
    return A.backfill_currency(table(spark, sf_dir, "regnskap")).select(ORG, "regnskapstype", "periode_til", "kilde", "valuta")


@check("round_to_thousand", oracle="""
SELECT o_orderkey, cast(round(cast(o_totalprice AS DECIMAL(20,2)) / 1000) * 1000 AS DOUBLE) AS belop FROM orders""")
def round_to_thousand(spark, sf_dir):
    price = F.col("o_totalprice").cast("decimal(20,2)")
    return load(spark, sf_dir, "orders").select("o_orderkey", C.to_thousand(price).alias("belop"))


@check("fiscal_periods", oracle="""
SELECT o_orderkey, cast(last_day(m) AS VARCHAR) AS periode_til, cast(cast(m - INTERVAL 11 MONTH AS DATE) AS VARCHAR) AS periode_fra
FROM (SELECT o_orderkey, make_date(year(o_orderdate), CASE WHEN o_orderkey % 13 = 0 THEN 12 ELSE o_orderkey % 13 END, 1) AS m FROM orders) t""")
def fiscal_periods(spark, sf_dir):
    year, month = F.year("o_orderdate"), (F.col("o_orderkey") % 13).cast("int")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", C.period_end(year, month).alias("periode_til"), C.period_start(year, month).alias("periode_fra")
    )


@check("accounts_history", tables="regnskap", oracle="""
SELECT organisasjonsnummer, regnskapstype, cast(periode_til AS VARCHAR) AS periode_til, kilde,
       row_number() OVER (PARTITION BY organisasjonsnummer ORDER BY periode_til DESC, regnskapstype) AS nr
FROM regnskap""")
def accounts_history(spark, sf_dir):
    return A.accounts_history(table(spark, sf_dir, "regnskap")).select(ORG, "regnskapstype", "periode_til", "kilde", "nr")


@check("latest_attempts", tables="forsok", oracle="""
SELECT organisasjonsnummer, epoch_us(forsokt_at) AS forsokt_us, status, http_status, antall_perioder, feilmelding
FROM (SELECT *, row_number() OVER (PARTITION BY organisasjonsnummer ORDER BY forsokt_at DESC) AS r FROM forsok) t WHERE r = 1""")
def latest_attempts(spark, sf_dir):
    rows = A.latest_attempt(table(spark, sf_dir, "forsok"))
    return rows.select(
        ORG, F.unix_micros(F.col("forsokt_at").cast("timestamp")).alias("forsokt_us"),
        "status", "http_status", "antall_perioder", "feilmelding",
    )
