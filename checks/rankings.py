"""The ranking lists. Thresholds that only fit the full register are passed explicitly.

The SQL side does not sort and cut: a row is on a list if fewer than fifty others
come before it, which :func:`first_fifty` says once for all lists.
"""

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from checks.registry import HOLDINGS, LATEST, ORACLES, check, half_up
from checks.standins import AS_OF, register
from fjordbook.plans import build
from fjordbook.plans import rankings as R
from fjordbook.schema import ORG
from fjordbook.session import checkpoint_root
from fjordbook.sources.tables import TableStore

DAY = f"DATE '{AS_OF}'"


def first_fifty(rows: str, *order: str, hide: str = "") -> str:
    """The rows of a query that stand before number fifty in an order, without the columns to hide."""
    hidden = ", ".join(["nummer", *hide.split()])
    return f"""
SELECT * EXCLUDE ({hidden}) FROM (SELECT alle.*, row_number() OVER (ORDER BY {', '.join(order)}) AS nummer FROM ({rows}) alle) WHERE nummer <= 50"""


#: Text of a company's column, looked up from its key.
def of_company(key: str, column: str) -> str:
    return f"(SELECT any_value(x.{column}) FROM enheter x WHERE x.organisasjonsnummer = {key})"


_STAFF = "CASE antall_ansatte WHEN 0 THEN NULL ELSE antall_ansatte END AS ansatte"
_PLACE = "forretningsadresse_poststed AS sted"


@check("rank_bankruptcies", tables="enheter", oracle=first_fifty(f"""
SELECT organisasjonsnummer, navn, strftime(konkursdato, '%Y-%m-%d') AS konkursdato, {_STAFF}, {_PLACE}, -coalesce(antall_ansatte, -1) AS storst
FROM enheter WHERE konkursdato > DATE '0001-01-01' AND konkurs""", "konkursdato DESC", "storst", "organisasjonsnummer", hide="storst"))
def bankruptcies(spark, sf_dir):
    return R.latest_bankruptcies(register(spark, sf_dir))


@check("rank_new", tables="enheter", oracle=first_fifty(f"""
SELECT organisasjonsnummer, navn, strftime(registreringsdato_enhetsregisteret, '%Y-%m-%d') AS registrert, organisasjonsform_kode AS form,
       naeringskode1_beskrivelse AS naering, {_PLACE}
FROM enheter WHERE slettet_dato IS NULL AND datediff('day', registreringsdato_enhetsregisteret, {DAY}) <= 30""", "registrert DESC", "navn", "organisasjonsnummer"))
def newly_registered(spark, sf_dir):
    return R.newly_registered(register(spark, sf_dir))


#: Plausible latest accounts of companies still registered, with the company's own columns.
_SOUND = """sunne AS (
  SELECT l.*, e.navn, e.antall_ansatte, e.konkurs FROM latest l, enheter e
  WHERE l.rimelig AND e.organisasjonsnummer = l.organisasjonsnummer AND e.slettet_dato IS NULL)"""
_SOUND_CTES = f"{LATEST},\n{_SOUND}"


def _figures(order: str) -> str:
    return first_fifty("""
SELECT organisasjonsnummer, navn, CAST(sum_driftsinntekter AS DOUBLE) AS omsetning, CAST(aarsresultat AS DOUBLE) AS resultat, CAST(aar AS VARCHAR) AS aar
FROM sunne""", f"{order} NULLS LAST", "organisasjonsnummer")


@check("rank_revenue", tables="enheter regnskap", ctes=_SOUND_CTES, oracle=_figures("omsetning DESC"))
def revenue(spark, sf_dir):
    return R.largest_revenue(register(spark, sf_dir))


@check("rank_profit", tables="enheter regnskap", ctes=_SOUND_CTES, oracle=_figures("resultat DESC"))
def profit(spark, sf_dir):
    return R.largest_profit(register(spark, sf_dir))


@check("rank_loss", tables="enheter regnskap", ctes=_SOUND_CTES, oracle=_figures("resultat ASC"))
def loss(spark, sf_dir):
    return R.largest_loss(register(spark, sf_dir))


def _change(condition: str, *order: str) -> str:
    return first_fifty(f"""
SELECT organisasjonsnummer, navn, CAST(forrige_inntekter AS DOUBLE) AS fra, CAST(sum_driftsinntekter AS DOUBLE) AS til, CAST(vekst_prosent AS DOUBLE) AS vekst,
       sum_driftsinntekter / forrige_inntekter - 1 AS forhold
FROM sunne WHERE NOT forrige_inntekter < 10000000 AND {condition}""", *order, "organisasjonsnummer", hide="forhold")


@check("rank_growth", tables="enheter regnskap", ctes=_SOUND_CTES, oracle=_change("sum_driftsinntekter - forrige_inntekter > 0", "(til - fra) / fra DESC"))
def growth(spark, sf_dir):
    return R.fastest_growth(register(spark, sf_dir))


@check("rank_decline", tables="enheter regnskap", ctes=_SOUND_CTES, oracle=_change(
    "sum_driftsinntekter - forrige_inntekter < 0 AND NOT sum_driftsinntekter < 0", "(til - fra) / fra", "fra DESC"))
def decline(spark, sf_dir):
    return R.fastest_decline(register(spark, sf_dir))


@check("rank_negative_equity", tables="enheter regnskap", ctes=_SOUND_CTES, oracle=first_fifty(f"""
SELECT organisasjonsnummer, navn, CAST(sum_egenkapital AS DOUBLE) AS egenkapital, CAST(sum_gjeld AS DOUBLE) AS gjeld, {_STAFF}
FROM sunne WHERE sign(sum_egenkapital) = -1 AND konkurs = false""", "egenkapital", "organisasjonsnummer"))
def negative_equity(spark, sf_dir):
    return R.negative_equity(register(spark, sf_dir))


@check("rank_capital", tables="enheter", oracle=first_fifty(f"""
SELECT organisasjonsnummer, navn, CAST(kapital_belop AS DOUBLE) AS kapital, organisasjonsform_kode AS form, {_PLACE}
FROM enheter WHERE (kapital_valuta, slettet_dato IS NULL, kapital_belop IS NULL) = ('NOK', true, false)""", "kapital DESC", "organisasjonsnummer"))
def capital(spark, sf_dir):
    return R.largest_capital(register(spark, sf_dir))


@check("rank_profit_per_employee", tables="enheter regnskap", ctes=_SOUND_CTES, oracle=first_fifty(f"""
SELECT organisasjonsnummer, navn, antall_ansatte AS ansatte, CAST(aarsresultat AS DOUBLE) AS resultat,
       CAST({half_up('aarsresultat', 'antall_ansatte', 0)} AS DOUBLE) AS per_ansatt
FROM sunne WHERE antall_ansatte > 19 AND sign(aarsresultat) = 1""", "resultat / ansatte DESC", "organisasjonsnummer"))
def profit_per_employee(spark, sf_dir):
    return R.profit_per_employee(register(spark, sf_dir))


#: First names that only women, or only men, have, and the roles in force with their holder's first name in capitals.
GENDER = """kvinnenavn AS (SELECT fornavn FROM navneliste GROUP BY fornavn HAVING bool_and(kjonn = 'K')),
mannsnavn AS (SELECT fornavn FROM navneliste GROUP BY fornavn HAVING bool_and(kjonn = 'M')),
gjeldende AS (
  SELECT *, upper(regexp_extract(person_fornavn, '^[^ ]*')) AS fornavn, {'f': person_fornavn, 'e': person_etternavn, 'd': person_fodselsdato} AS person
  FROM roller WHERE avregistrert = false)"""


@check("rank_influential_women", tables="enheter regnskap roller aksjonar_raw navneliste", ctes=f"{LATEST},\n{HOLDINGS},\n{GENDER}", oracle=", " + """
styrer AS (
  SELECT organisasjonsnummer, navn, antall_ansatte,
         (SELECT any_value(sum_driftsinntekter) FROM latest l WHERE l.rimelig AND l.organisasjonsnummer = e.organisasjonsnummer) AS inntekt,
         (SELECT count(*) FROM shares a WHERE a.eier_orgnr = e.organisasjonsnummer AND a.micro > 50000000) AS eide
  FROM enheter e WHERE slettet_dato IS NULL AND konkurs = false),
toppen AS (
  SELECT g.person, arg_min({'o': g.organisasjonsnummer, 'navn': b.navn, 'rolle': g.rolletype_beskrivelse, 'inntekt': b.inntekt, 'folk': b.antall_ansatte, 'eide': b.eide},
                           (-(coalesce(b.inntekt, 0) + 1000000 * coalesce(b.antall_ansatte, 0)), g.organisasjonsnummer, g.rolletype_beskrivelse)) AS t
  FROM gjeldende g JOIN styrer b USING (organisasjonsnummer)
  WHERE list_contains(['DAGL', 'LEDE'], g.rolletype_kode) AND g.person_etternavn IS NOT NULL AND g.person_fodselsdato IS NOT NULL AND g.fornavn IN (SELECT fornavn FROM kvinnenavn)
  GROUP BY g.person),
plasser AS (
  SELECT person, len(list(DISTINCT organisasjonsnummer)) AS verv FROM gjeldende WHERE list_contains(['STYR', 'DAGL'], rollegruppe_kode) GROUP BY person)""" + first_fifty("""
SELECT t.o AS organisasjonsnummer, t.navn AS navn, t.rolle AS rolle, CAST(t.inntekt AS DOUBLE) AS omsetning, CASE t.folk WHEN 0 THEN NULL ELSE t.folk END AS ansatte,
       t.eide AS datterselskap, verv,
       round(ln(pow(CAST(greatest(coalesce(t.inntekt, 0), 1) AS DOUBLE), 2)) + 3 * ln(greatest(coalesce(t.folk, 0), 1)) + 4 * (ln(t.eide + 1) + ln(verv)), 1) AS poeng
FROM toppen JOIN plasser USING (person)""", "poeng DESC", "organisasjonsnummer", "rolle", "verv DESC"))
def influential_women(spark, sf_dir):
    return R.most_influential_women(register(spark, sf_dir))


@check("rank_led_by_women", tables="enheter roller navneliste", ctes=GENDER, oracle=first_fifty(f"""
SELECT organisasjonsnummer, navn, antall_ansatte AS ansatte, {_PLACE}, naeringskode1_beskrivelse AS naering
FROM enheter e WHERE slettet_dato IS NULL AND antall_ansatte >= 0 AND EXISTS (
  FROM gjeldende g SEMI JOIN kvinnenavn USING (fornavn) WHERE g.organisasjonsnummer = e.organisasjonsnummer AND g.rolletype_kode = 'DAGL')""",
    "ansatte DESC", "organisasjonsnummer"))
def led_by_women(spark, sf_dir):
    return R.largest_led_by_women(register(spark, sf_dir))


def _women(label: str, named: str, having: int) -> str:
    """Managers told apart by first name, one number each, added up by the name of the place or trade."""
    return f"""
SELECT {label}, CAST(sum(k) AS BIGINT) AS kvinner, count(*) AS totalt, {half_up('100 * sum(k)', 'count(*)', 1)} AS andel FROM (
  SELECT {named} AS {label}, CASE WHEN g.fornavn IN (FROM kvinnenavn) THEN 1 WHEN g.fornavn IN (FROM mannsnavn) THEN 0 END AS k
  FROM gjeldende g JOIN enheter e ON e.organisasjonsnummer = g.organisasjonsnummer AND e.slettet_dato IS NULL
  WHERE g.rolletype_kode = 'DAGL') WHERE k IS NOT NULL AND {label} IS NOT NULL
GROUP BY {label} HAVING totalt > {having}"""


@check("share_by_region", tables="enheter roller navneliste kommuner fylker", ctes=GENDER, oracle=_women("fylke", """(
  SELECT any_value(navn) FROM fylker WHERE fylkesnummer = (SELECT any_value(fylkesnummer) FROM kommuner WHERE kommunenummer = e.forretningsadresse_kommunenummer))""", 50))
def women_by_county(spark, sf_dir):
    return R.women_by_county(register(spark, sf_dir), more_than=50)


@check("share_by_industry", tables="enheter roller navneliste naeringskoder", ctes=GENDER, oracle=first_fifty(
    _women("naering", "(SELECT any_value(navn) FROM naeringskoder WHERE kode = e.naeringskode1_kode)", 5), "andel DESC", "naering"))
def women_by_industry(spark, sf_dir):
    return R.women_by_industry(register(spark, sf_dir), more_than=5)


@check("most_subsidiaries", tables="enheter aksjonar_raw", ctes=HOLDINGS, oracle=first_fifty(f"""
SELECT eier_orgnr AS organisasjonsnummer, ifnull({of_company('eier_orgnr', 'navn')}, '(ukjent)') AS navn, len(list(micro)) AS datterselskap,
       {of_company('eier_orgnr', 'forretningsadresse_poststed')} AS sted
FROM shares WHERE micro > 50000000 GROUP BY eier_orgnr""", "datterselskap DESC", "organisasjonsnummer"))
def most_subsidiaries(spark, sf_dir):
    return R.most_subsidiaries(register(spark, sf_dir))


@check("rank_oldest", tables="enheter", oracle=first_fifty(f"""
SELECT organisasjonsnummer, navn, strftime(stiftelsesdato, '%Y-%m-%d') AS stiftet, {_STAFF}, {_PLACE}
FROM enheter WHERE year(stiftelsesdato) >= 1000 AND stiftelsesdato <> DATE '1000-01-01' AND slettet_dato IS NULL AND NOT (konkurs OR under_avvikling)""",
    "stiftet", "organisasjonsnummer"))
def oldest(spark, sf_dir):
    return R.oldest_companies(register(spark, sf_dir))


@check("most_shareholders", tables="enheter aksjonar_raw", ctes=HOLDINGS, oracle=first_fifty(f"""
SELECT organisasjonsnummer, navn, CAST(sum(n) AS BIGINT) AS eiere, CAST(sum(CASE er_person WHEN false THEN n ELSE 0 END) AS BIGINT) AS foretakseiere FROM (
  SELECT organisasjonsnummer, ifnull({of_company('a.organisasjonsnummer', 'navn')}, selskap_navn) AS navn, er_person, count(*) AS n FROM aksjonar a GROUP BY ALL)
GROUP BY organisasjonsnummer, navn""", "eiere DESC", "organisasjonsnummer", "navn"))
def most_shareholders(spark, sf_dir):
    return R.most_shareholders(register(spark, sf_dir))


def _clients(role: str) -> str:
    return first_fifty(f"""
SELECT innehaver_orgnr AS organisasjonsnummer, ifnull({of_company('r.innehaver_orgnr', 'navn')}, innehaver_navn) AS navn, len(list(DISTINCT r.organisasjonsnummer)) AS klienter
FROM roller r WHERE (rolletype_kode, avregistrert) = ('{role}', false) AND innehaver_orgnr > '' GROUP BY ALL""", "klienter DESC", "organisasjonsnummer", "navn")


@check("distinct_clients", tables="enheter roller", oracle=_clients("REVI"))
def auditors(spark, sf_dir):
    return R.auditors(register(spark, sf_dir))


@check("distinct_clients_accounting", tables="enheter roller", oracle=_clients("REGN"))
def accountants(spark, sf_dir):
    return R.accountants(register(spark, sf_dir))


@check("rank_new_by_municipality", tables="enheter kommuner fylker", oracle=first_fifty(f"""
SELECT kommune, fylke, CAST(sum(nye) AS BIGINT) AS nye FROM (
  SELECT k.navn AS kommune, (SELECT any_value(navn) FROM fylker f WHERE f.fylkesnummer = k.fylkesnummer) AS fylke,
         (SELECT count(*) FROM enheter e WHERE e.forretningsadresse_kommunenummer = k.kommunenummer
            AND datediff('day', e.registreringsdato_enhetsregisteret, {DAY}) <= 365) AS nye FROM kommuner k)
WHERE nye > 0 GROUP BY ALL""", "nye DESC", "kommune", "fylke"))
def new_by_municipality(spark, sf_dir):
    return R.new_by_municipality(register(spark, sf_dir))


@check("rank_bankruptcies_by_industry", tables="enheter naeringskoder", oracle=first_fifty(f"""
SELECT naering, CAST(sum(falt) AS BIGINT) AS konkurser, count(*) AS totalt, {half_up('100 * sum(falt)', 'count(*)', 2)} AS andel FROM (
  SELECT (SELECT any_value(navn) FROM naeringskoder WHERE kode = naeringskode1_kode) AS naering, konkurs::INT AS falt FROM enheter)
WHERE naering IS NOT NULL GROUP BY naering HAVING sum(falt) >= 1""", "konkurser DESC", "naering"))
def bankruptcies_by_industry(spark, sf_dir):
    return R.bankruptcies_by_industry(register(spark, sf_dir), more_than=0)


#: Lists that are built and stored, with the order of their rows in SQL.
_BUILT = {
    "storst-omsetning": ("rank_revenue", "omsetning DESC NULLS LAST, organisasjonsnummer"), "storst-underskudd": ("rank_loss", "resultat NULLS LAST, organisasjonsnummer"),
    "hoyest-aksjekapital": ("rank_capital", "kapital DESC, organisasjonsnummer"),
}
_LISTED = "\nUNION ALL ".join(
    f"SELECT '{name}' AS liste, cast(row_number() OVER (ORDER BY {order}) AS INT) AS nr, organisasjonsnummer, navn FROM ({ORACLES[query]})" for name, (query, order) in _BUILT.items())


def _built(spark, tables, *, broken=None, names=None, extra=()):
    """A store with the lists of a register, built as the nightly job does."""
    store = TableStore(spark, f"{checkpoint_root(spark)}/lister-{uuid.uuid4().hex}")
    lists = {name: R.RANKINGS[name] for name in _BUILT}
    for name in extra:
        store.publish(build.PREFIX + name, spark.createDataFrame([("x", 1)], "navn string, nr int"), {"tittel": name, "kategori": "Status", "kolonner": '[{"felt": "navn"}]'})
    outcomes = build.build_rankings(store, tables, names, lists)
    if broken:
        lists[broken] = replace(lists[broken], rows=lambda r: r.companies.select(F.raise_error(F.lit("broken list")).cast("string").alias("navn")))
        outcomes = build.build_rankings(store, tables, [broken], lists)
    return store, outcomes


@check("rankings_built", oracle=f"SELECT liste, nr, organisasjonsnummer, navn FROM ({_LISTED})")
def rankings_built(spark, sf_dir):
    """The stored rows of three lists; one of them failed when it was built again and keeps its rows."""
    store, _ = _built(spark, register(spark, sf_dir), broken="storst-underskudd")
    parts = [build.list_rows(store, name).select(F.lit(name).alias("liste"), F.col("nr").cast("int"), ORG, "navn") for name in _BUILT]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@check("rankings_index", oracle=f"""
SELECT v.*, n.antall FROM (VALUES ('storst-omsetning', 'Largest revenue', 'Regnskap', 'Company,Revenue,Profit,Year', ''), ('hoyest-aksjekapital', 'Largest share capital', 'Regnskap', 'Company,Share capital,Form,Place', ''),
  ('storst-underskudd', 'Largest loss', 'Regnskap', 'Company,Profit,Revenue,Year', 'broken list')) v (navn, tittel, kategori, titler, feil)
JOIN (SELECT liste AS navn, count(*) AS antall FROM ({_LISTED}) GROUP BY 1) n USING (navn)""")
def rankings_index(spark, sf_dir):
    """Titles, column headings, sizes and the last error of each stored list."""
    rows = build.ranking_index(_built(spark, register(spark, sf_dir), broken="storst-underskudd")[0])
    titles = F.from_json("kolonner", "array<struct<felt: string, tittel: string, format: string>>")["tittel"]
    fault = F.when(F.contains("feilmelding", F.lit("broken list")), "broken list").otherwise(F.coalesce("feilmelding", F.lit("")))
    return rows.select("navn", "tittel", "kategori", F.array_join(titles, ",").alias("titler"), fault.alias("feil"), "antall")


@check("rankings_teasers", oracle=f"SELECT liste AS navn, string_agg(navn, '|' ORDER BY nr) FILTER (WHERE nr <= 3) AS topp, 3 AS lister, true AS eldste_er_eldst FROM ({_LISTED}) GROUP BY 1")
def rankings_teasers(spark, sf_dir):
    """The first three companies of each list, and whether the time shown is that of the list made first."""
    store, _ = _built(spark, register(spark, sf_dir))
    oldest = build.ranking_index(store).agg(F.min("publisert")).first()[0]
    shown = build.teasers(store, list(_BUILT))
    return shown.select("navn", F.array_join("topp", "|").alias("topp"), F.col("lister").cast("int"), (F.col("eldste") == F.lit(oldest)).alias("eldste_er_eldst"))


@check("ranking_retired", oracle="SELECT * FROM (VALUES ('alle', 'hoyest-aksjekapital'), ('alle', 'storst-omsetning'), ('alle', 'storst-underskudd'), ('en', 'storst-omsetning'), ('en', 'gammel-liste')) v (bygget, navn)")
def ranking_retired(spark, sf_dir):
    """A list that is defined no more is gone after all lists are built, but stays when one is."""
    tables = register(spark, sf_dir)
    every = build.ranking_index(_built(spark, tables, extra=["gammel-liste"])[0])
    one = build.ranking_index(_built(spark, tables, names=["storst-omsetning"], extra=["gammel-liste"])[0])
    return every.select(F.lit("alle").alias("bygget"), "navn").unionByName(one.select(F.lit("en").alias("bygget"), "navn"))
