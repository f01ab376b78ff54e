"""Annual accounts: the latest figures per company, changes over time, provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fjordbook.functions import cleaning as C
from fjordbook.operators.keyed import first_per_key
from fjordbook.schema import ACCOUNT_KEY, AMOUNTS, ORG

LATEST_AMOUNTS = [
    "sum_driftsinntekter", "sum_driftskostnad", "driftsresultat", "aarsresultat",
    "sum_eiendeler", "sum_egenkapital", "sum_gjeld",
]

#: Fields where a rise is not good news, so a change has no direction.
UNDIRECTED = {"sum_driftskostnad", "sum_finanskostnad", "sum_gjeld", "sum_kortsiktig_gjeld", "sum_langsiktig_gjeld"}


def plausible(current: Column, previous: Column, factor: int = 50) -> Column:
    """False where revenue grew more than ``factor`` times; null where that cannot be told."""
    return previous.isNull() | (previous <= 0) | (current <= previous * factor)


def growth_percent(current: Column, previous: Column) -> Column:
    return F.when(previous > 0, F.round(F.lit(100) * (current - previous) / previous, 1))


def latest_and_previous(accounts: DataFrame, currency: str = "NOK") -> DataFrame:
    """One row per company: newest accounts, the revenue of the period before, growth, plausibility.

    A company may hold two account types for one period; its own accounts come
    before the group's. Ranking by period first means at most two periods per
    company leave the map side.
    """
    needed = accounts.filter(F.col("valuta") == currency).select(ORG, "periode_til", "regnskapstype", *LATEST_AMOUNTS)
    period = F.dense_rank().over(Window.partitionBy(ORG).orderBy(F.desc("periode_til")))
    two = needed.withColumn("_period", period).filter("_period <= 2")

    own_first = F.when(F.col("regnskapstype") == "SELSKAP", 1).otherwise(0)
    latest = F.max_by(F.struct("periode_til", *LATEST_AMOUNTS), F.when(F.col("_period") == 1, own_first))
    before = F.max_by(F.struct("periode_til", "sum_driftsinntekter"), F.when(F.col("_period") == 2, own_first))
    rows = two.groupBy(ORG).agg(latest.alias("l"), before.alias("p"))

    current, previous = F.col("l.sum_driftsinntekter"), F.col("p.sum_driftsinntekter")
    return rows.select(
        ORG,
        "l.periode_til",
        F.year("l.periode_til").alias("aar"),
        *[f"l.{c}" for c in LATEST_AMOUNTS],
        previous.alias("forrige_inntekter"),
        F.col("p.periode_til").alias("forrige_periode"),
        growth_percent(current, previous).alias("vekst_prosent"),
        plausible(current, previous).alias("rimelig"),
    )


def newest_any_currency(accounts: DataFrame) -> DataFrame:
    """One row per company: its newest accounts whatever the currency."""
    order = [F.desc("periode_til"), F.desc(F.col("regnskapstype") == "SELSKAP"), F.asc("regnskapstype")]
    columns = [ORG, "periode_til", "regnskapstype", "sum_driftsinntekter", "aarsresultat"]
    return first_per_key(accounts.select(*columns), [ORG], *order)


def year_on_year(accounts: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Percent change from the previous period, per company, account type and currency.

    ``<field>_retning`` is ``opp``, ``ned`` or null; costs and debts have none.
    """
    series = Window.partitionBy(ORG, "regnskapstype", "valuta").orderBy("periode_til")
    fields = fields or ["sum_driftsinntekter", "aarsresultat"]
    columns = {}
    for field in fields:
        now, before = F.col(field), F.lag(field).over(series)
        change = F.when(before != 0, (now - before) / F.abs(before) * 100)
        columns[f"{field}_endring"] = change
        if field in UNDIRECTED:
            columns[f"{field}_retning"] = F.lit(None).cast("string")
        else:
            columns[f"{field}_retning"] = F.when(change > 0, "opp").when(change < 0, "ned")
    return accounts.withColumns(columns)


def share_of_max(accounts: DataFrame, field: str = "sum_driftsinntekter") -> DataFrame:
    """Bar width of each period: percent of the company's largest absolute value, at least 1.

    The maximum is an aggregate joined back, so no company's history has to sit
    in one task.
    """
    size = F.abs(F.col(field))
    top = accounts.groupBy(ORG).agg(F.greatest(F.max(size), F.lit(1)).alias("_max"))
    bar = F.greatest(F.lit(1.0), size.cast("double") / F.col("_max").cast("double") * 100)
    return accounts.join(top, ORG).withColumn("andel_av_maks", bar).drop("_max")


def round_to_thousand(accounts: DataFrame) -> DataFrame:
    return accounts.withColumns(C.round_amounts([c for c in AMOUNTS if c in accounts.columns]))


def merge_by_priority(sources: DataFrame, key: list[str], priority: Column, *then: Column) -> DataFrame:
    """One whole row per key: the source with the lowest ``priority`` wins with all its columns."""
    return first_per_key(sources, key, priority.asc(), *then)


def merge_accounts(stored: DataFrame, *arrivals: DataFrame) -> DataFrame:
    """Accounts after new rows arrived; a period the API answered for is taken from it whole.

    Of rows from equally good sources the later arrival wins, so a corrected
    figure replaces the stored one. Rows that also arrive together are told
    apart by their contents.
    """
    frames = [f.withColumn("_ankomst", F.lit(i)) for i, f in enumerate((stored, *arrivals))]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    from_api = F.when(F.col("kilde") == "brreg-api", 0).otherwise(1)
    contents = F.xxhash64(*[F.col(c) for c in rows.columns])
    return merge_by_priority(rows, ACCOUNT_KEY, from_api, F.desc("_ankomst"), contents).drop("_ankomst")


def insert_absent(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """``existing`` plus the incoming rows whose key it lacks."""
    return existing.unionByName(incoming.join(existing.select(*key), key, "left_anti"), allowMissingColumns=True)


def backfill_currency(accounts: DataFrame) -> DataFrame:
    """Currency for rows that state none.

    History rows take the currency of the company's newest API accounts; what
    is still empty is NOK.
    """
    api = accounts.filter((F.col("kilde") == "brreg-api") & F.col("valuta").isNotNull())
    newest = api.groupBy(ORG).agg(F.max_by("valuta", F.struct("periode_til", "valuta")).alias("_api"))
    history = F.when(F.col("kilde") == "historikk", F.col("_api"))
    return (
        accounts.join(newest, ORG, "left")
        .withColumn("valuta", F.coalesce(history, F.col("valuta"), F.lit("NOK")))
        .drop("_api")
    )


def latest_attempt(attempts: DataFrame) -> DataFrame:
    """Latest outcome per company from an append-only log of fetch attempts."""
    newest = F.max_by(F.struct("status", "http_status", "antall_perioder", "feilmelding"), F.col("forsokt_at"))
    rows = attempts.groupBy(ORG).agg(F.max("forsokt_at").alias("forsokt_at"), newest.alias("r"))
    return rows.select(ORG, "forsokt_at", "r.*")


def accounts_history(accounts: DataFrame) -> DataFrame:
    """All accounts with their place in the company's history, newest first, and their changes."""
    order = Window.partitionBy(ORG).orderBy(F.desc("periode_til"), F.asc("regnskapstype"))
    return year_on_year(accounts).withColumn("nr", F.row_number().over(order))


