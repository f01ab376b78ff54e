"""Shareholdings: typed rows, the public view, ownership edges, subsidiaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjordbook.functions import cleaning as C
from fjordbook.operators.keyed import lookup, scalar, top_per_key
from fjordbook.schema import ORG
from fjordbook.session import dealt

def classify_holders(raw: DataFrame, year: int | Column) -> DataFrame:
    """Raw shareholder rows of one year, typed. Duplicates are real holdings and are kept."""
    holder = F.trim("fodselsaar_orgnr")
    is_person = C.holder_kind(holder)
    address = F.trim("postnr_sted")
    shares = C.clean_text(F.col("antall_aksjer")).try_cast("bigint")
    total = C.clean_text(F.col("antall_aksjer_selskap")).try_cast("bigint")
    return raw.filter(F.trim("orgnr") != "").select(
        (F.lit(year) if isinstance(year, int) else year).cast("smallint").alias("regnskapsaar"),
        C.org_key(F.col("orgnr")).alias(ORG),
        C.clean_text(F.col("selskap")).alias("selskap_navn"),
        C.clean_text(F.col("aksjeklasse")).alias("aksjeklasse"),
        is_person.alias("er_person"),
        F.when(~is_person, holder).alias("eier_orgnr"),
        C.clean_text(F.col("eier_navn")).alias("eier_navn"),
        F.when(is_person, holder.try_cast("smallint")).alias("eier_fodselsaar"),
        C.post_code(address).alias("eier_postnr"),
        C.post_place(address).alias("eier_poststed"),
        C.clean_text(F.col("landkode")).alias("eier_landkode"),
        shares.alias("antall_aksjer"),
        total.alias("antall_aksjer_selskap"),
        C.share_percent(shares, total).alias("andel_prosent"),
    )


def public_holdings(holdings: DataFrame, strict: bool = False) -> DataFrame:
    """Holdings without personal columns: a person's name and country are masked.

    ``strict`` masks holders of unknown kind too.
    """
    hidden = F.col("er_person")
    if strict:
        hidden = F.coalesce(hidden, F.lit(True))

    def shown(column: str) -> Column:
        return F.when(F.coalesce(hidden, F.lit(False)), None).otherwise(F.col(column)).alias(column)

    return holdings.select(
        "regnskapsaar", ORG, "selskap_navn", "aksjeklasse", "er_person", "eier_orgnr",
        shown("eier_navn"), shown("eier_landkode"), "antall_aksjer", "antall_aksjer_selskap", "andel_prosent",
    )


def newest_year(holdings: DataFrame) -> DataFrame:
    """Rows of the newest year held. The maximum is a scalar subquery over a partition column."""
    return holdings.filter(F.col("regnskapsaar") == scalar(holdings, F.max("regnskapsaar")))


def owner_shares(holdings: DataFrame) -> DataFrame:
    """Summed share per (corporate owner, company) in the newest year; share classes add up."""
    rows, newest = holdings.agg(F.count(F.lit(1)), F.max("regnskapsaar")).first()  # in one reading
    corporate = holdings.filter((F.col("regnskapsaar") == F.lit(newest)) & F.col("eier_orgnr").isNotNull()).select("eier_orgnr", ORG, "andel_prosent")
    return dealt(corporate, rows, "eier_orgnr", ORG).groupBy("eier_orgnr", ORG).agg(F.sum("andel_prosent").alias("andel"))


def ownership_edges(holdings: DataFrame) -> DataFrame:
    """The ownership graph: one edge per owner and company."""
    return owner_shares(holdings).withColumn("andel", F.round("andel", 2).cast("decimal(20,2)"))


def subsidiary_counts(holdings: DataFrame) -> DataFrame:
    """Majority-owned companies per owner."""
    majority = owner_shares(holdings).filter(F.col("andel") > 50)
    return majority.groupBy("eier_orgnr").agg(F.count(F.lit(1)).alias("datterselskap"))


def subsidiaries(companies: DataFrame, holdings: DataFrame, industries: DataFrame, k: int | None = None) -> DataFrame:
    """Per parent: majority-owned companies and registered branches still in the register.

    The majority test is on the unrounded sum. They are numbered by size per parent,
    all or the largest ``k``; ``antall`` counts all of them.
    """
    owned = owner_shares(holdings).filter(F.col("andel") > 50).select(
        F.col("eier_orgnr").alias("mor"), ORG, F.round("andel", 2).cast("decimal(20,2)").alias("andel")
    )
    branches = companies.filter(F.col("overordnet_enhet").isNotNull()).select(
        F.col("overordnet_enhet").alias("mor"), ORG, F.lit(None).cast("decimal(20,2)").alias("andel")
    )
    links = owned.unionByName(branches).groupBy("mor", ORG).agg(F.max("andel").alias("andel"))
    details = companies.filter(F.col("slettet_dato").isNull()).select(
        ORG, "navn", "organisasjonsform_kode", "antall_ansatte", "har_registrert_antall_ansatte",
        "forretningsadresse_poststed", "konkurs", "under_avvikling", "naeringskode1_kode",
    )
    names = industries.select(F.col("kode").alias("naeringskode1_kode"), F.col("navn").alias("naering"))
    rows = lookup(links.join(details, ORG), names, "naeringskode1_kode", ORG)
    counts = rows.groupBy("mor").agg(F.count(F.lit(1)).alias("antall"))
    order = [F.desc_nulls_last("antall_ansatte"), F.asc("navn"), F.asc(ORG)]
    return top_per_key(rows, ["mor"], order, k, rank="nr").join(counts, "mor")


def degree_counts(edges: DataFrame) -> DataFrame:
    """Direct corporate owners of, and companies owned by, every company in the graph."""
    owners = edges.select(F.col(ORG).alias("node"), F.lit(1).alias("eiere"), F.lit(0).alias("eier_i"))
    owned = edges.select(F.col("eier_orgnr").alias("node"), F.lit(0).alias("eiere"), F.lit(1).alias("eier_i"))
    ends = owners.unionByName(owned).groupBy("node")
    return ends.agg(F.sum("eiere").alias("eiere"), F.sum("eier_i").alias("eier_i"))


def _largest_first(*ties: str) -> list[Column]:
    return [F.desc_nulls_last("andel_prosent"), *[F.asc_nulls_last(c) for c in ties]]


def holder_summary(holdings: DataFrame, k: int | None = None) -> DataFrame:
    """Per company: holdings in all, by persons, by others, how many a list of all or ``k`` shows."""
    everyone = F.count(F.lit(1))
    persons = F.count_if(F.coalesce("er_person", F.lit(False)))
    return holdings.groupBy(ORG).agg(
        everyone.alias("antall_eiere"),
        persons.alias("antall_personeiere"),
        (everyone - persons).alias("antall_foretakseiere"),
        (persons > 0).alias("personer_skjult"),
        (everyone if k is None else F.least(everyone, F.lit(k))).alias("vist"),
        (F.lit(False) if k is None else everyone > k).alias("avkortet"),
    )


def largest_holders(holdings: DataFrame, companies: DataFrame, k: int | None = None) -> DataFrame:
    """The holdings in each company, largest first, all or ``k``, with the holder's registered name."""
    columns = [ORG, "regnskapsaar", "er_person", "eier_orgnr", "eier_navn", "aksjeklasse",
               "antall_aksjer", "antall_aksjer_selskap", "andel_prosent"]
    ties = ["regnskapsaar", "eier_orgnr", "eier_navn", "aksjeklasse", "antall_aksjer"]
    top = top_per_key(public_holdings(holdings).select(*columns), [ORG], _largest_first(*ties), k, rank="nr", spread=True)
    names = companies.select(F.col(ORG).alias("eier_orgnr"), F.col("navn").alias("eier_foretaksnavn"))
    return lookup(top, names, "eier_orgnr", ORG)


def largest_positions(holdings: DataFrame, companies: DataFrame, k: int | None = None) -> DataFrame:
    """The holdings each company itself has in others, largest first, all or ``k``."""
    rows = holdings.filter(F.col("eier_orgnr").isNotNull())
    rows = rows.select("eier_orgnr", ORG, "regnskapsaar", "aksjeklasse", "andel_prosent", "antall_aksjer")
    ties = [ORG, "regnskapsaar", "aksjeklasse", "antall_aksjer"]
    top = top_per_key(rows, ["eier_orgnr"], _largest_first(*ties), k, rank="nr", spread=True)
    return top.join(companies.select(ORG, "navn"), ORG, "left")


def duplicate_holdings(holdings: DataFrame) -> DataFrame:
    """Holdings that look alike. They are reported, never dropped: the key has nullable parts."""
    key = ["regnskapsaar", ORG, "aksjeklasse", "eier_orgnr", "eier_navn", "eier_fodselsaar", "eier_postnr"]
    return holdings.groupBy(*key).agg(F.count(F.lit(1)).alias("antall")).filter("antall > 1")
