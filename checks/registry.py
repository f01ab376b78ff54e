"""Registration of queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.standins import duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and dates as text, so both engines print the same values."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def check(name: str, oracle: str | None = None, tables: str = "", ctes: str = ""):
    """Register the decorated query. ``oracle`` is run by DuckDB over the named register tables.

    ``ctes`` are further named queries put between the tables and ``oracle``.
    """
    def register(query: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plain(query(spark, sf_dir))
        if oracle is not None:
            parts = [p for p in (duck(*tables.split()) if tables else "", ctes) if p]
            head = ",\n".join(parts)
            if head and not head.startswith("WITH"):
                head = "WITH " + head
            ORACLES[name] = f"{head}\n{oracle}".strip()
        return query
    return register


def half_up(numerator: str, denominator: str, digits: int) -> str:
    """``round(numerator / denominator, digits)`` of whole numbers, exactly, halves away from zero."""
    n, d, scale = f"cast({numerator} AS BIGINT)", f"cast({denominator} AS BIGINT)", 10**digits
    return f"(sign({n}) * ((2 * abs({n}) * {scale} + {d}) // (2 * {d})) / {scale}.0)"


#: Latest accounts per company in SQL, over ``regnskap``.
LATEST = f"""nok AS (
  SELECT *, dense_rank() OVER (PARTITION BY organisasjonsnummer ORDER BY periode_til DESC) AS p,
         row_number() OVER (PARTITION BY organisasjonsnummer, periode_til ORDER BY regnskapstype DESC) AS t
  FROM regnskap WHERE valuta = 'NOK'),
latest AS (
  SELECT a.organisasjonsnummer, a.periode_til, cast(year(a.periode_til) AS INT) AS aar, a.sum_driftsinntekter, a.sum_driftskostnad,
         a.driftsresultat, a.aarsresultat, a.sum_eiendeler, a.sum_egenkapital, a.sum_gjeld,
         b.sum_driftsinntekter AS forrige_inntekter, b.periode_til AS forrige_periode,
         CASE WHEN b.sum_driftsinntekter > 0 THEN {half_up('100 * (a.sum_driftsinntekter - b.sum_driftsinntekter)', 'b.sum_driftsinntekter', 1)} END AS vekst_prosent,
         (b.sum_driftsinntekter IS NULL OR b.sum_driftsinntekter <= 0 OR a.sum_driftsinntekter <= 50 * b.sum_driftsinntekter) AS rimelig
  FROM nok a LEFT JOIN nok b ON b.organisasjonsnummer = a.organisasjonsnummer AND b.p = 2 AND b.t = 1
  WHERE a.p = 1 AND a.t = 1)"""

#: Typed holdings in SQL, over ``aksjonar_raw``.
HOLDINGS = """aksjonar AS (
  SELECT aar AS regnskapsaar, lpad(trim(orgnr), 9, '0') AS organisasjonsnummer, selskap AS selskap_navn, aksjeklasse,
         CASE WHEN length(fodselsaar_orgnr) = 4 THEN true WHEN length(fodselsaar_orgnr) = 9 THEN false END AS er_person,
         CASE WHEN length(fodselsaar_orgnr) = 9 THEN fodselsaar_orgnr END AS eier_orgnr, eier_navn,
         CASE WHEN length(fodselsaar_orgnr) = 4 THEN cast(fodselsaar_orgnr AS INT) END AS eier_fodselsaar,
         CASE WHEN regexp_matches(postnr_sted, '^[0-9]{4}\\s+.') THEN substr(postnr_sted, 1, 4) END AS eier_postnr,
         CASE WHEN regexp_matches(postnr_sted, '^[0-9]{4}\\s+.') THEN trim(substr(postnr_sted, 5)) END AS eier_poststed,
         landkode AS eier_landkode, cast(antall_aksjer AS BIGINT) AS antall_aksjer, cast(antall_aksjer_selskap AS BIGINT) AS antall_aksjer_selskap,
         CASE WHEN cast(antall_aksjer_selskap AS BIGINT) > 0 THEN cast(
              (2 * 100000000 * cast(antall_aksjer AS BIGINT) + cast(antall_aksjer_selskap AS BIGINT)) // (2 * cast(antall_aksjer_selskap AS BIGINT))
              AS DECIMAL(20,0)) / 1000000 END AS andel
  FROM aksjonar_raw),
shares AS (
  SELECT eier_orgnr, organisasjonsnummer, sum(cast(round(andel * 1000000) AS BIGINT)) AS micro
  FROM aksjonar WHERE eier_orgnr IS NOT NULL AND regnskapsaar = (SELECT max(regnskapsaar) FROM aksjonar) GROUP BY 1, 2)"""
