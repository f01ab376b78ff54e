"""Profiles for every company at once: dossier, roles, accounts, geography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjordbook.functions import cleaning as C
from fjordbook.operators.holdings import subsidiary_counts
from fjordbook.operators.keyed import first_per_key, lookup, top_per_key
from fjordbook.plans.rankings import Register
from fjordbook.schema import ORG


def _count_per_company(rows: DataFrame, name: str, key: str = ORG) -> DataFrame:
    return rows.groupBy(F.col(key).alias(ORG)).agg(F.count(F.lit(1)).alias(name))


def dossier(register: Register) -> DataFrame:
    """Every company with the names of its place, industry and parent, its counts, and its latest accounts.

    Each count is one aggregate per table. All of them, and the few companies
    that have a parent, are joined on the company key, so the company table
    itself is shuffled once.
    """
    companies = register.companies
    places = register.municipalities.select(
        F.col("kommunenummer").alias("forretningsadresse_kommunenummer"), F.col("navn").alias("kommune"), "fylkesnummer"
    )
    counties = register.counties.select("fylkesnummer", F.col("navn").alias("fylke"))
    industries = register.industries.select(F.col("kode").alias("naeringskode1_kode"), F.col("navn").alias("naering"))
    children = companies.filter(F.col("overordnet_enhet").isNotNull()).select(ORG, "overordnet_enhet")
    names = companies.select(F.col(ORG).alias("overordnet_enhet"), F.col("navn").alias("morselskap"))
    parents = children.join(names, "overordnet_enhet").drop("overordnet_enhet")
    rows = lookup(companies, places, "forretningsadresse_kommunenummer", ORG)
    rows = lookup(rows, counties, "fylkesnummer", ORG)
    rows = lookup(rows, industries, "naeringskode1_kode", ORG)
    rows = rows.join(parents, ORG, "left")
    counts = {
        "antall_roller": _count_per_company(register.roles, "antall_roller"),
        "antall_regnskap": _count_per_company(register.accounts, "antall_regnskap"),
        "antall_aksjonaerer": _count_per_company(register.holdings, "antall_aksjonaerer"),
        "antall_datterselskap": subsidiary_counts(register.holdings).select(
            F.col("eier_orgnr").alias(ORG), F.col("datterselskap").alias("antall_datterselskap")
        ),
    }
    if register.history is not None:
        counts["antall_tidligere_roller"] = _count_per_company(register.history, "antall_tidligere_roller")
    for frame in counts.values():
        rows = rows.join(frame, ORG, "left")
    return rows.join(newest_accounts(register.accounts), ORG, "left").fillna(0, list(counts))


def newest_accounts(accounts: DataFrame) -> DataFrame:
    """The newest accounts of each company in any currency, for its summary card."""
    shown = ["periode_til", "valuta", "kilde", "sum_driftsinntekter", "driftsresultat", "aarsresultat",
             "sum_eiendeler", "sum_egenkapital", "sum_gjeld"]
    order = [F.desc("periode_til"), F.desc(F.col("regnskapstype") == "SELSKAP"), F.asc("regnskapstype")]
    return first_per_key(accounts.select(ORG, "regnskapstype", *shown), [ORG], *order)


def holder_name() -> Column:
    return F.coalesce("innehaver_navn", C.person_name(F.col("person_fornavn"), F.col("person_mellomnavn"), F.col("person_etternavn")))


def roles_of(roles: DataFrame) -> DataFrame:
    """Roles with the holder's name, in display order within each company.

    One global sort: its ranges split a company with very many roles.
    """
    order = [F.asc_nulls_last("rollegruppe_kode"), F.asc_nulls_last("rekkefolge"), F.asc("rolletype_kode"), F.asc_nulls_last("innehaver")]
    return roles.withColumn("innehaver", holder_name()).orderBy(ORG, *order)


def ended_roles_of(history: DataFrame, k: int | None = None) -> DataFrame:
    """The ended roles of each company, most recent first, all or ``k``."""
    named = history.withColumn("innehaver", holder_name())
    order = [F.desc("sist_sett"), F.asc_nulls_last("rolletype_kode"), F.asc_nulls_last("innehaver"), F.asc_nulls_last("rekkefolge")]
    return top_per_key(named, [ORG], order, k, rank="nr", spread=True)


def roles_by_group(roles: DataFrame) -> DataFrame:
    """Roles per company and group, with the group's place in the display and its members' names in order."""
    member = F.struct(F.col("rekkefolge").isNull().alias("sist"), "rekkefolge", "rolletype_kode", holder_name().alias("innehaver"))
    return roles.groupBy(ORG, "rollegruppe_kode").agg(
        F.count(F.lit(1)).alias("antall"), F.min("rekkefolge").alias("forste"), F.sort_array(F.collect_list(member))["innehaver"].alias("medlemmer")
    )


def geo_counts(register: Register) -> DataFrame:
    """Active companies per county and per municipality; places without any show zero."""
    used = register.active.groupBy(F.col("forretningsadresse_kommunenummer").alias("nr")).agg(F.count(F.lit(1)).alias("antall"))
    zero = F.lit(0).cast("long")
    places = register.municipalities.select(F.col("kommunenummer").alias("nr"), "navn", F.col("fylkesnummer").alias("fylke"))
    municipal = places.join(used, "nr", "left").withColumn("antall", F.coalesce("antall", zero))
    sums = municipal.groupBy(F.col("fylke").alias("nr")).agg(F.sum("antall").alias("antall"))
    regional = register.counties.select(F.col("fylkesnummer").alias("nr"), "navn", F.lit(None).cast("string").alias("fylke"))
    regional = regional.join(sums, "nr", "left").withColumn("antall", F.coalesce("antall", zero))
    columns = ["nivaa", "nr", "navn", "fylke", "antall"]
    return (
        regional.withColumn("nivaa", F.lit("fylke")).select(*columns)
        .unionByName(municipal.withColumn("nivaa", F.lit("kommune")).select(*columns))
    )
