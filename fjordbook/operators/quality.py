"""Data quality, coverage and run status."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjordbook.functions import cleaning as C
from fjordbook.operators.reconcile import latest_run_per_source
from fjordbook.operators.selectors import MIN_DESCRIPTION
from fjordbook.schema import AMOUNTS, ORG


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Exact row counts; each is one aggregate over an empty projection, answered from file footers."""
    counts = [t.agg(F.count(F.lit(1)).alias("rader")).select(F.lit(n).alias("tabell"), "rader") for n, t in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def run_status(runs: DataFrame, as_of: datetime) -> DataFrame:
    """The latest run of each source and its age in seconds."""
    age = F.unix_timestamp(F.lit(as_of)) - F.unix_timestamp(F.col("startet_at").cast("timestamp"))
    return latest_run_per_source(runs).withColumn("alder_sek", age)


def accounts_extent(accounts: DataFrame) -> DataFrame:
    """Years covered, companies with accounts, rows per source."""
    return accounts.agg(
        F.year(F.min("periode_til")).alias("fra"),
        F.year(F.max("periode_til")).alias("til"),
        F.countDistinct(ORG).alias("foretak"),
        F.count_if(F.col("kilde") == "brreg-api").alias("fra_api"),
        F.count_if(F.col("kilde") == "historikk").alias("fra_historikk"),
    )


def company_coverage(companies: DataFrame) -> DataFrame:
    """Active, filing, described, deleted and missing companies in one pass."""
    active = F.col("slettet_dato").isNull()
    return companies.agg(
        F.count_if(active).alias("foretak"),
        F.count_if(active & F.col("siste_innsendte_aarsregnskap").isNotNull()).alias("med_regnskap"),
        F.count_if(active & (F.length(C.description()) >= MIN_DESCRIPTION)).alias("med_beskrivelse"),
        F.count_if(~active).alias("slettet"),
        F.count_if(F.col("savnet_siden").isNotNull()).alias("savnet"),
    )


def coverage(companies: DataFrame, latest: DataFrame, history: DataFrame, attempts: DataFrame) -> DataFrame:
    """Coverage of the register with what is archived, excluded or failing, one row."""
    archived = history.select(F.count(F.lit(1))).scalar()
    archive_from = history.select(F.min("sist_sett")).scalar()
    implausible = latest.select(F.count_if(~F.col("rimelig"))).scalar()
    failed = attempts.select(F.count_if(F.col("status") == "feil")).scalar()
    empty = attempts.select(F.count_if(F.col("status") == "ingen_data")).scalar()
    return company_coverage(companies).select(
        "*", archived.alias("arkiverte_roller"), archive_from.alias("arkiv_fra"), implausible.alias("urimelige"),
        failed.alias("hentefeil"), empty.alias("ingen_regnskap"),
    )


def currency_mix(accounts: DataFrame) -> DataFrame:
    return accounts.groupBy("kilde", F.coalesce("valuta", F.lit("—")).alias("valuta")).agg(F.count(F.lit(1)).alias("rader"))


def currency_totals(mix: DataFrame) -> DataFrame:
    return mix.groupBy("valuta").agg(F.sum("rader").alias("rader")).orderBy(F.desc("rader"), "valuta")


def orphans(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """Rows whose company is not in the register."""
    return rows.join(companies.select(ORG), ORG, "left_anti")


def reference_violations(rows: DataFrame, column: str, reference: DataFrame, key: str) -> DataFrame:
    """Values of ``column`` the reference table lacks, with how many rows carry each.

    Values are counted first, so the join sees each value once.
    """
    used = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("verdi")).agg(F.count(F.lit(1)).alias("rader"))
    missing = used.join(reference.select(F.col(key).alias("verdi")), "verdi", "left_anti")
    return missing.select(F.lit(column).alias("kolonne"), "verdi", "rader")


def double_holders(roles: DataFrame) -> DataFrame:
    """Roles held by a person and a company at once."""
    return roles.filter(F.col("person_etternavn").isNotNull() & F.col("innehaver_orgnr").isNotNull())


def off_thousand(accounts: DataFrame) -> DataFrame:
    """Figures that are not whole thousands, per amount column; all should be zero."""
    present = [c for c in AMOUNTS if c in accounts.columns]
    counts = accounts.agg(*[F.count_if(F.col(c) % 1000 != 0).alias(c) for c in present])
    return counts.unpivot([], present, "kolonne", "antall")


def failure_rate(attempts: DataFrame, limit: float = 0.10) -> DataFrame:
    """Share of failed attempts and whether the job they belong to counts as failed."""
    failed = F.count_if(F.col("status") == "feil")
    return attempts.agg(
        F.count(F.lit(1)).alias("forsok"), failed.alias("feil"),
        (failed > F.count(F.lit(1)) * limit).alias("mislykket"),
    )


def require(check: DataFrame, failed: str, message: str) -> None:
    """Raise when the one-row check's ``failed`` column is true."""
    if check.first()[failed]:
        raise RuntimeError(message)


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows break each rule; a null result of a rule does not break it."""
    return df.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()]).unpivot([], list(rules), "regel", "brudd")
