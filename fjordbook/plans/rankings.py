"""The ranking lists, each one declarative query over the register tables.

A list is a function of a :class:`Register`; ``RANKINGS`` maps its name to the
function and to what a page needs to show it. Every list ends its ordering in a
unique key, so equal figures always come out in the same order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjordbook.functions import cleaning as C
from fjordbook.operators.accounts import latest_and_previous
from fjordbook.operators.holdings import ownership_edges, subsidiary_counts
from fjordbook.operators.keyed import first_per_key
from fjordbook.schema import ORG

#: Rows of a list where a caller asks for no other number.
SIZE = 50


@dataclass
class Register:
    """The tables the lists and profiles read. ``as_of`` is the day they are made for."""

    companies: DataFrame
    accounts: DataFrame
    roles: DataFrame
    holdings: DataFrame
    municipalities: DataFrame
    counties: DataFrame
    industries: DataFrame
    first_names: DataFrame
    as_of: date
    history: DataFrame | None = None
    attempts: DataFrame | None = None
    stored: dict[str, DataFrame] = field(default_factory=dict)

    @cached_property
    def latest(self) -> DataFrame:
        """Latest accounts: the stored table when there is one, else derived."""
        return self.stored["latest"] if "latest" in self.stored else latest_and_previous(self.accounts)

    @cached_property
    def edges(self) -> DataFrame:
        return self.stored["edges"] if "edges" in self.stored else ownership_edges(self.holdings)

    @property
    def active(self) -> DataFrame:
        return self.companies.filter(F.col("slettet_dato").isNull())


@dataclass(frozen=True)
class Ranking:
    """A list: how to compute it and what its columns mean."""

    rows: Callable[..., DataFrame]
    title: str
    category: str
    columns: tuple[tuple[str, str], ...]

    @property
    def description(self) -> str:
        return DESCRIPTIONS.get(self.title, "")

    def shown(self) -> list[dict[str, str]]:
        """The columns as a page shows them: field, heading and format."""
        return [{"felt": c, "tittel": COLUMN_TITLES.get((self.title, c), COLUMN_TITLES.get(c, c)), "format": f} for c, f in self.columns]


# Headings by column, or by list and column where a list has its own.
COLUMN_TITLES: dict[str | tuple[str, str], str] = {
    "navn": "Company", "konkursdato": "Bankrupt since", "ansatte": "Employees", "sted": "Place", "registrert": "Registered", "form": "Form", "naering": "Industry",
    "omsetning": "Revenue", "resultat": "Profit", "aar": "Year", "vekst": "Growth", "fra": "From", "til": "To", "egenkapital": "Equity", "gjeld": "Debt", "kapital": "Share capital",
    "per_ansatt": "Per employee", "rolle": "Role", "datterselskap": "Subsidiaries", "verv": "Seats", "poeng": "Score", "fylke": "County", "andel": "Share of women",
    "kvinner": "Women", "totalt": "In all", "stiftet": "Founded", "eiere": "Holders", "foretakseiere": "Corporate holders", "klienter": "Clients", "kommune": "Municipality",
    "nye": "New", "konkurser": "Bankruptcies", ("Most influential women", "navn"): "Leads", ("Fastest falling revenue", "vekst"): "Change",
    ("Auditors with most clients", "navn"): "Auditor", ("Accountants with most clients", "navn"): "Accountant", ("Industries with most bankruptcies", "andel"): "Rate",
}

# What each list holds, by title.
DESCRIPTIONS = {
    "Latest bankruptcies": "Companies last registered as bankrupt, newest first.",
    "Newly registered companies": "Companies registered in the last thirty days, newest first.",
    "Largest revenue": "Highest revenue in the latest accounts, in NOK alone.",
    "Largest profit": "Highest profit of the year in the latest accounts, in NOK alone.",
    "Largest loss": "Lowest result of the year in the latest accounts, in NOK alone.",
    "Fastest growing revenue": "Growth between the two latest accounts, from ten million on; implausible figures are left out.",
    "Fastest falling revenue": "Decline between the two latest accounts, from ten million on.",
    "Negative equity": "Companies whose latest accounts show negative equity, lowest first; bankrupt ones are left out.",
    "Largest share capital": "Highest registered share capital, in NOK.",
    "Profit per employee": "Profit of the year over employees, of companies with twenty or more.",
    "Most influential women": "Women who lead a company or its board, by a score of its revenue, employees and subsidiaries and their own seats. Gender is taken from first names.",
    "Largest companies led by a woman": "Largest companies by employees whose manager has a woman's first name.",
    "Share of women among managers, by county": "Share of managers with a woman's first name in each county.",
    "Share of women among managers, by industry": "Share of managers with a woman's first name in each industry.",
    "Most subsidiaries": "Companies that own more than half of most others.",
    "Oldest active companies": "Companies founded longest ago that are still registered.",
    "Most shareholders": "Companies with most holders over all years.",
    "Auditors with most clients": "Auditors by number of companies they are registered for.",
    "Accountants with most clients": "Accountants by number of companies they are registered for.",
    "New companies by municipality": "Companies registered in the last year, for each municipality.",
    "Industries with most bankruptcies": "Bankrupt companies and their share in each industry with more than twenty.",
}

RANKINGS: dict[str, Ranking] = {}


def ranking(name: str, title: str, category: str, **columns: str):
    """Register the decorated function as a list. ``columns`` maps each shown column to its format."""
    def register(rows: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        RANKINGS[name] = Ranking(rows, title, category, tuple(columns.items()))
        return rows
    return register


def _employees() -> Column:
    """Headcount as shown: a reported zero is not."""
    return F.nullif(F.col("antall_ansatte"), F.lit(0)).alias("ansatte")


def _place() -> Column:
    return F.col("forretningsadresse_poststed").alias("sted")


def _top(rows: DataFrame, size: int, *order: Column, key: str = ORG) -> DataFrame:
    return rows.orderBy(*order, F.asc(key)).limit(size)


def _plausible_accounts(register: Register, *columns: str) -> DataFrame:
    """Plausible latest accounts of companies in the register."""
    figures = register.latest.filter("rimelig")
    companies = register.active.select(ORG, "navn", *columns)
    return figures.join(companies, ORG)


@ranking("siste-konkurser", "Latest bankruptcies", "Status", navn="lenke", konkursdato="dato", ansatte="tall", sted="tekst")
def latest_bankruptcies(register: Register, size: int = SIZE) -> DataFrame:
    rows = register.companies.filter(F.col("konkurs") & F.col("konkursdato").isNotNull())
    top = _top(rows, size, F.desc("konkursdato"), F.desc_nulls_last("antall_ansatte"))
    return top.select(ORG, "navn", "konkursdato", _employees(), _place())


@ranking("siste-nyetablerte", "Newly registered companies", "Status",
         navn="lenke", registrert="dato", form="tekst", naering="tekst", sted="tekst")
def newly_registered(register: Register, days: int = 30, size: int = SIZE) -> DataFrame:
    registered = F.col("registreringsdato_enhetsregisteret")
    rows = register.active.filter(registered >= F.lit(register.as_of - timedelta(days=days)))
    top = _top(rows, size, registered.desc(), F.asc_nulls_last("navn"))
    return top.select(
        ORG, "navn", registered.alias("registrert"), F.col("organisasjonsform_kode").alias("form"),
        F.col("naeringskode1_beskrivelse").alias("naering"), _place(),
    )


def _by_figure(register: Register, order: Column, size: int) -> DataFrame:
    rows = _plausible_accounts(register).select(
        ORG, "navn", F.col("sum_driftsinntekter").alias("omsetning"), F.col("aarsresultat").alias("resultat"),
        F.col("aar").cast("string").alias("aar"),
    )
    return _top(rows, size, order)


@ranking("storst-omsetning", "Largest revenue", "Regnskap", navn="lenke", omsetning="belop", resultat="belop", aar="tekst")
def largest_revenue(register: Register, size: int = SIZE) -> DataFrame:
    return _by_figure(register, F.desc_nulls_last("omsetning"), size)


@ranking("storst-overskudd", "Largest profit", "Regnskap", navn="lenke", resultat="belop", omsetning="belop", aar="tekst")
def largest_profit(register: Register, size: int = SIZE) -> DataFrame:
    return _by_figure(register, F.desc_nulls_last("resultat"), size)


@ranking("storst-underskudd", "Largest loss", "Regnskap", navn="lenke", resultat="belop", omsetning="belop", aar="tekst")
def largest_loss(register: Register, size: int = SIZE) -> DataFrame:
    return _by_figure(register, F.asc_nulls_last("resultat"), size)


def _revenue_change(register: Register, base: int) -> DataFrame:
    rows = _plausible_accounts(register).filter(F.col("forrige_inntekter") >= base)
    return rows.select(
        ORG, "navn", F.col("forrige_inntekter").alias("fra"), F.col("sum_driftsinntekter").alias("til"),
        F.col("vekst_prosent").alias("vekst"),
    )


@ranking("storst-vekst", "Fastest growing revenue", "Regnskap", navn="lenke", vekst="prosent", fra="belop", til="belop")
def fastest_growth(register: Register, base: int = 10_000_000, size: int = SIZE) -> DataFrame:
    rows = _revenue_change(register, base).filter("til > fra")
    return _top(rows, size, F.expr("(til - fra) / fra").desc())


@ranking("storst-fall", "Fastest falling revenue", "Regnskap", navn="lenke", vekst="prosent", fra="belop", til="belop")
def fastest_decline(register: Register, base: int = 10_000_000, size: int = SIZE) -> DataFrame:
    rows = _revenue_change(register, base).filter("til < fra and til >= 0")
    return _top(rows, size, F.expr("(til - fra) / fra").asc(), F.desc("fra"))


@ranking("negativ-egenkapital", "Negative equity", "Regnskap", navn="lenke", egenkapital="belop", gjeld="belop", ansatte="tall")
def negative_equity(register: Register, size: int = SIZE) -> DataFrame:
    rows = _plausible_accounts(register, "konkurs", "antall_ansatte").filter(~F.col("konkurs") & (F.col("sum_egenkapital") < 0))
    shown = rows.select(
        ORG, "navn", F.col("sum_egenkapital").alias("egenkapital"), F.col("sum_gjeld").alias("gjeld"), _employees()
    )
    return _top(shown, size, F.asc("egenkapital"))


@ranking("hoyest-aksjekapital", "Largest share capital", "Regnskap", navn="lenke", kapital="belop", form="tekst", sted="tekst")
def largest_capital(register: Register, size: int = SIZE) -> DataFrame:
    rows = register.active.filter(F.col("kapital_belop").isNotNull() & (F.col("kapital_valuta") == "NOK"))
    shown = rows.select(
        ORG, "navn", F.col("kapital_belop").alias("kapital"), F.col("organisasjonsform_kode").alias("form"), _place()
    )
    return _top(shown, size, F.desc("kapital"))


@ranking("resultat-per-ansatt", "Profit per employee", "Regnskap", navn="lenke", per_ansatt="belop", resultat="belop", ansatte="tall")
def profit_per_employee(register: Register, employees: int = 20, size: int = SIZE) -> DataFrame:
    rows = _plausible_accounts(register, "antall_ansatte").filter((F.col("antall_ansatte") >= employees) & (F.col("aarsresultat") > 0))
    each = F.col("aarsresultat") / F.col("antall_ansatte")
    top = _top(rows, size, each.desc())
    return top.select(
        ORG, "navn", F.col("antall_ansatte").alias("ansatte"), F.col("aarsresultat").alias("resultat"),
        F.round(each, 0).alias("per_ansatt"),
    )


def _roles_with_gender(register: Register, *genders: str) -> DataFrame:
    """Live roles held by a person whose first name is known for one of ``genders``."""
    names = register.first_names.filter(F.col("kjonn").isin(*genders)).select(F.col("fornavn").alias("_first"), "kjonn")
    live = register.roles.filter(~F.col("avregistrert"))
    return live.withColumn("_first", C.first_name_key(F.col("person_fornavn"))).join(names, "_first")


PERSON = ["person_fornavn", "person_etternavn", "person_fodselsdato"]


@ranking("mektigste-kvinner", "Most influential women", "Roller", navn="lenke", rolle="tekst", omsetning="belop",
         ansatte="tall", datterselskap="tall", verv="tall", poeng="tall")
def most_influential_women(register: Register, size: int = SIZE) -> DataFrame:
    """One row per woman who leads or chairs a company, shown as her largest company, never by name.

    The score adds the logarithms of revenue, headcount, subsidiaries and seats.
    A person without a birth date cannot be matched to her seats and drops out.
    """
    leads = _roles_with_gender(register, "K").filter(F.col("rolletype_kode").isin("DAGL", "LEDE")).dropna(subset=PERSON)
    leads = leads.select(ORG, F.col("rolletype_beskrivelse").alias("rolle"), *PERSON)

    seats = register.roles.filter(~F.col("avregistrert") & F.col("rollegruppe_kode").isin("STYR", "DAGL")).dropna(subset=PERSON)
    seats = seats.select(ORG, *PERSON).join(leads.select(*PERSON), PERSON, "left_semi")  # only of the women who lead
    seats = seats.groupBy(*PERSON).agg(F.countDistinct(ORG).alias("verv"))

    companies = register.active.filter(~F.col("konkurs")).select(ORG, "navn", "antall_ansatte")
    revenue = register.latest.filter("rimelig").select(ORG, F.col("sum_driftsinntekter").alias("omsetning"))
    owned = subsidiary_counts(register.holdings).withColumnRenamed("eier_orgnr", ORG)
    led = leads.join(companies, ORG).join(revenue, ORG, "left").join(owned, ORG, "left")

    zero = F.lit(0)
    weight = F.coalesce("omsetning", zero) + F.coalesce("antall_ansatte", zero) * 1_000_000
    flagship = first_per_key(led, PERSON, weight.desc(), F.asc(ORG), F.asc_nulls_last("rolle"))

    def log_of(amount: Column) -> Column:
        return F.ln(F.greatest(amount, F.lit(1)).cast("double"))

    score = (
        2 * log_of(F.coalesce("omsetning", zero)) + 3 * log_of(F.coalesce("antall_ansatte", zero))
        + 4 * log_of(F.coalesce("datterselskap", zero) + 1) + 4 * log_of(F.col("verv"))
    )
    rows = flagship.join(seats, PERSON).select(
        ORG, "navn", "rolle", "omsetning", _employees(), F.coalesce("datterselskap", zero).alias("datterselskap"), "verv",
        F.round(score, 1).alias("poeng"),
    )
    return rows.orderBy(F.desc("poeng"), F.asc(ORG), F.asc_nulls_last("rolle"), F.desc("verv")).limit(size)


@ranking("kvinner-daglig-leder", "Largest companies led by a woman", "Roller", navn="lenke", ansatte="tall", naering="tekst", sted="tekst")
def largest_led_by_women(register: Register, size: int = SIZE) -> DataFrame:
    led = _roles_with_gender(register, "K").filter(F.col("rolletype_kode") == "DAGL").select(ORG).distinct()
    rows = register.active.filter(F.col("antall_ansatte").isNotNull()).join(led, ORG, "left_semi")
    shown = rows.select(
        ORG, "navn", F.col("antall_ansatte").alias("ansatte"), _place(), F.col("naeringskode1_beskrivelse").alias("naering")
    )
    return _top(shown, size, F.desc("ansatte"))


def _managers(register: Register, *columns: str) -> DataFrame:
    managers = _roles_with_gender(register, "K", "M").filter(F.col("rolletype_kode") == "DAGL").select(ORG, "kjonn")
    counted = managers.groupBy(ORG, "kjonn").agg(F.count(F.lit(1)).alias("_n"))
    return counted.join(register.active.select(ORG, *columns), ORG)


def _municipality_names(register: Register) -> DataFrame:
    counties = register.counties.select("fylkesnummer", F.col("navn").alias("fylke"))
    places = register.municipalities.select(
        F.col("kommunenummer").alias("forretningsadresse_kommunenummer"), F.col("navn").alias("kommune"), "fylkesnummer"
    )
    return places.join(counties, "fylkesnummer")


def _weighted_share(rows: DataFrame, label: str, more_than: int) -> DataFrame:
    """Women's share of managers per ``label``, over rows that stand for ``_n`` managers each."""
    women = F.sum(F.when(F.col("kjonn") == "K", F.col("_n")).otherwise(0))
    shares = rows.groupBy(label).agg(women.alias("kvinner"), F.sum("_n").alias("totalt"))
    percent = F.round(F.lit(100).cast("decimal(20,0)") * F.col("kvinner") / F.col("totalt"), 1)
    return shares.filter(F.col("totalt") > more_than).withColumn("andel", percent)


@ranking("kvinneandel-fylke", "Share of women among managers, by county", "Roller",
         fylke="tekst", andel="prosent", kvinner="tall", totalt="tall")
def women_by_county(register: Register, more_than: int = 500) -> DataFrame:
    rows = _managers(register, "forretningsadresse_kommunenummer")
    named = rows.join(_municipality_names(register), "forretningsadresse_kommunenummer")
    return _weighted_share(named, "fylke", more_than).orderBy(F.desc("andel"), "fylke")


@ranking("kvinneandel-naering", "Share of women among managers, by industry", "Roller",
         naering="tekst", andel="prosent", kvinner="tall", totalt="tall")
def women_by_industry(register: Register, more_than: int = 300, size: int = SIZE) -> DataFrame:
    rows = _managers(register, "naeringskode1_kode").withColumnRenamed("naeringskode1_kode", "kode")
    named = rows.join(register.industries.select("kode", F.col("navn").alias("naering")), "kode")
    return _top(_weighted_share(named, "naering", more_than), size, F.desc("andel"), key="naering")


@ranking("flest-datterselskap", "Most subsidiaries", "Eierskap", navn="lenke", datterselskap="tall", sted="tekst")
def most_subsidiaries(register: Register, size: int = SIZE) -> DataFrame:
    counts = subsidiary_counts(register.holdings).withColumnRenamed("eier_orgnr", ORG)
    top = _top(counts, size, F.desc("datterselskap"))
    named = top.join(register.companies.select(ORG, "navn", "forretningsadresse_poststed"), ORG, "left")
    shown = named.select(ORG, F.coalesce("navn", F.lit("(ukjent)")).alias("navn"), "datterselskap", _place())
    return _top(shown, size, F.desc("datterselskap"))


@ranking("eldste-foretak", "Oldest active companies", "Status", navn="lenke", stiftet="dato", ansatte="tall", sted="tekst")
def oldest_companies(register: Register, size: int = SIZE) -> DataFrame:
    founded = F.col("stiftelsesdato")
    rows = register.active.filter((founded > "1000-01-01") & ~F.col("konkurs") & ~F.col("under_avvikling"))
    return _top(rows, size, founded.asc()).select(ORG, "navn", founded.alias("stiftet"), _employees(), _place())


@ranking("flest-aksjonarer", "Most shareholders", "Eierskap", navn="lenke", eiere="tall", foretakseiere="tall")
def most_shareholders(register: Register, size: int = SIZE) -> DataFrame:
    """Holdings of all years; holders of unknown kind count as owners but not as companies."""
    counts = register.holdings.groupBy(ORG, "selskap_navn").agg(
        F.count(F.lit(1)).alias("eiere"), F.count_if(~F.col("er_person")).alias("foretakseiere")
    )
    named = counts.join(register.companies.select(ORG, "navn"), ORG, "left")
    rows = named.groupBy(ORG, F.coalesce("navn", "selskap_navn").alias("navn")).agg(
        F.sum("eiere").alias("eiere"), F.sum("foretakseiere").alias("foretakseiere")
    )
    return rows.orderBy(F.desc("eiere"), F.asc(ORG), F.asc_nulls_last("navn")).limit(size)


def clients_of(register: Register, role: str, size: int = SIZE) -> DataFrame:
    """Holders of a role ranked by how many companies they hold it for."""
    held = register.roles.filter((F.col("rolletype_kode") == role) & F.col("innehaver_orgnr").isNotNull() & ~F.col("avregistrert"))
    pairs = held.select(F.col("innehaver_orgnr").alias("_holder"), "innehaver_navn", ORG).distinct()
    names = register.companies.select(F.col(ORG).alias("_holder"), "navn")
    label = F.coalesce("navn", "innehaver_navn").alias("navn")
    clients = pairs.join(names, "_holder", "left").groupBy(F.col("_holder").alias("innehaver"), label)
    rows = clients.agg(F.countDistinct(ORG).alias("klienter"))
    ranked = rows.orderBy(F.desc("klienter"), F.asc("innehaver"), F.asc_nulls_last("navn")).limit(size)
    return ranked.withColumnRenamed("innehaver", ORG)


@ranking("revisorer-klienter", "Auditors with most clients", "Eierskap", navn="lenke", klienter="tall")
def auditors(register: Register, size: int = SIZE) -> DataFrame:
    return clients_of(register, "REVI", size)


@ranking("regnskapsforere-klienter", "Accountants with most clients", "Eierskap", navn="lenke", klienter="tall")
def accountants(register: Register, size: int = SIZE) -> DataFrame:
    return clients_of(register, "REGN", size)


@ranking("nyetablering-kommune", "New companies by municipality", "Geografi", kommune="tekst", fylke="tekst", nye="tall")
def new_by_municipality(register: Register, days: int = 365, size: int = SIZE) -> DataFrame:
    """Companies registered in the last year, those since deleted included."""
    recent = register.companies.filter(
        F.col("registreringsdato_enhetsregisteret") >= F.lit(register.as_of - timedelta(days=days))
    )
    counts = recent.groupBy("forretningsadresse_kommunenummer").agg(F.count(F.lit(1)).alias("nye"))
    rows = counts.join(_municipality_names(register), "forretningsadresse_kommunenummer")
    rows = rows.groupBy("kommune", "fylke").agg(F.sum("nye").alias("nye"))
    return rows.orderBy(F.desc("nye"), "kommune", "fylke").limit(size)


@ranking("konkurser-naering", "Industries with most bankruptcies", "Geografi",
         naering="tekst", konkurser="tall", totalt="tall", andel="prosent")
def bankruptcies_by_industry(register: Register, more_than: int = 20, size: int = SIZE) -> DataFrame:
    counts = register.companies.groupBy(F.col("naeringskode1_kode").alias("kode")).agg(
        F.count_if("konkurs").alias("_k"), F.count(F.lit(1)).alias("_n")
    )
    named = counts.join(register.industries.select("kode", F.col("navn").alias("naering")), "kode")
    rows = named.groupBy("naering").agg(F.sum("_k").alias("konkurser"), F.sum("_n").alias("totalt"))
    percent = F.round(F.lit(100).cast("decimal(20,0)") * F.col("konkurser") / F.col("totalt"), 2)
    rows = rows.filter(F.col("konkurser") > more_than).withColumn("andel", percent)
    return _top(rows, size, F.desc("konkurser"), key="naering")
