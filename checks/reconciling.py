"""Snapshots, deltas, role history, the change feed, work selection and quality reports.

The stored snapshot holds the companies registered before a day; the new one
holds those not deleted, with bankrupt companies renamed. Companies therefore
appear, change, stay and vanish by their own attributes.
"""

import uuid
from datetime import date, datetime

from pyspark.sql import functions as F

from checks.registry import HOLDINGS, LATEST, check
from checks.standins import AS_OF, load, register, table
from fjordbook.functions import cleaning as C
from fjordbook.operators import quality as Q
from fjordbook.operators import reconcile as R
from fjordbook.operators import selectors as W
from fjordbook.schema import ORG, ROLE_DOCUMENT
from fjordbook.session import checkpoint_root
from fjordbook.sources.files import explode_roles, gender_by_name

DAY = f"DATE '{AS_OF}'"
_FIELDS = ["navn", "antall_ansatte", "konkurs", "kapital_belop"]

SNAPSHOTS = """gammel AS (SELECT * FROM enheter WHERE registreringsdato_enhetsregisteret < DATE '2001-03-01'),
ny AS (SELECT * REPLACE (CASE WHEN konkurs THEN concat(navn, ' i konkurs') ELSE navn END AS navn) FROM enheter WHERE slettet_dato IS NULL),
begge AS (
  SELECT coalesce(g.organisasjonsnummer, n.organisasjonsnummer) AS organisasjonsnummer, n.organisasjonsnummer IS NOT NULL AS finnes,
         g.savnet_siden AS savnet, g.slettet_dato AS slettet, coalesce(n.navn, g.navn) AS navn,
         CASE WHEN g.organisasjonsnummer IS NULL THEN 'ny' WHEN n.organisasjonsnummer IS NULL THEN 'fravaerende'
              WHEN n.navn <> g.navn THEN 'endret' ELSE 'uendret' END AS utfall
  FROM gammel g FULL JOIN ny n ON n.organisasjonsnummer = g.organisasjonsnummer)"""

_SINCE = f"CASE WHEN finnes THEN NULL WHEN savnet IS NULL AND slettet IS NULL THEN {DAY} ELSE savnet END"
_GONE = f"CASE WHEN finnes THEN NULL WHEN slettet IS NULL AND savnet <= {DAY} - 7 THEN {DAY} ELSE slettet END"


def _snapshots(spark, sf_dir):
    companies = table(spark, sf_dir, "enheter")
    marks = ["savnet_siden", "slettet_dato"]
    old = companies.filter(F.col("registreringsdato_enhetsregisteret") < F.lit(date(2001, 3, 1)))
    renamed = F.when(F.col("konkurs"), F.concat("navn", F.lit(" i konkurs"))).otherwise(F.col("navn"))
    new = companies.filter("slettet_dato is null").withColumn("navn", renamed)
    columns = [ORG, *_FIELDS]
    old = R.add_content_hash(old.select(*columns, *marks), columns)
    return old, R.add_content_hash(new.select(*columns), columns)


@check("hash_upsert_counts", tables="enheter", ctes=SNAPSHOTS, oracle="""
SELECT count(*) FILTER (WHERE utfall <> 'fravaerende') AS lest, count(*) FILTER (WHERE utfall = 'ny') AS nye,
       count(*) FILTER (WHERE utfall = 'endret') AS endret, count(*) FILTER (WHERE utfall = 'uendret') AS uendret FROM begge""")
def hash_upsert_counts(spark, sf_dir):
    return R.hash_upsert(*_snapshots(spark, sf_dir))[1]


@check("hash_upsert_rows", tables="enheter", ctes=SNAPSHOTS, oracle="SELECT organisasjonsnummer, navn, utfall FROM begge")
def hash_upsert_rows(spark, sf_dir):
    return R.hash_upsert(*_snapshots(spark, sf_dir))[0].select(ORG, "navn", "utfall")


@check("load_snapshot", tables="enheter", ctes=SNAPSHOTS, oracle=f"""
SELECT organisasjonsnummer, navn, utfall, cast({_SINCE} AS VARCHAR) AS savnet_siden, cast({_GONE} AS VARCHAR) AS slettet_dato FROM begge""")
def load_snapshot(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return R.load_snapshot(old, new, AS_OF).select(ORG, "navn", "utfall", "savnet_siden", "slettet_dato")


@check("deletion_state", tables="enheter", ctes=SNAPSHOTS, oracle=f"""
SELECT organisasjonsnummer, cast({_SINCE} AS VARCHAR) AS savnet_siden, cast({_GONE} AS VARCHAR) AS slettet_dato,
       CASE WHEN finnes AND (savnet IS NOT NULL OR slettet IS NOT NULL) THEN 'tilbake'
            WHEN NOT finnes AND savnet IS NULL AND slettet IS NULL THEN 'savnet'
            WHEN NOT finnes AND slettet IS NULL AND savnet <= {DAY} - 7 THEN 'bekreftet' END AS overgang
FROM begge WHERE utfall <> 'ny'""")
def deletion_state(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return R.reconcile_deletions(old, new, AS_OF).select(ORG, "savnet_siden", "slettet_dato", "overgang")


LAST = """sist AS (
  SELECT organisasjonsnummer, max(oppdateringsid) AS oppdateringsid, arg_max(endringstype, oppdateringsid) AS endringstype FROM feed GROUP BY 1)"""


@check("feed_last_change", tables="feed", ctes=LAST, oracle="SELECT *, endringstype IN ('Sletting', 'Fjernet') AS slettes FROM sist")
def feed_last_change(spark, sf_dir):
    return R.last_changes(table(spark, sf_dir, "feed")).drop("dato")


@check("delta_soft_delete", tables="enheter feed", ctes=LAST, oracle=f"""
SELECT e.organisasjonsnummer, cast(coalesce(slettet_dato, CASE WHEN endringstype IN ('Sletting', 'Fjernet') THEN {DAY} END) AS VARCHAR) AS slettet_dato
FROM enheter e LEFT JOIN sist USING (organisasjonsnummer)""")
def delta_soft_delete(spark, sf_dir):
    deleted = R.last_changes(table(spark, sf_dir, "feed")).filter("slettes")
    return R.soft_delete(table(spark, sf_dir, "enheter"), deleted, AS_OF).select(ORG, "slettet_dato")


@check("delta_apply", tables="enheter feed", ctes=LAST, oracle=f"""
SELECT e.organisasjonsnummer, CASE WHEN endringstype IN ('Ny', 'Endring') THEN upper(navn) ELSE navn END AS navn,
       cast(CASE WHEN endringstype IN ('Ny', 'Endring') THEN NULL WHEN endringstype IS NULL THEN slettet_dato ELSE coalesce(slettet_dato, {DAY}) END AS VARCHAR) AS slettet_dato,
       cast(CASE WHEN endringstype IN ('Ny', 'Endring') THEN NULL ELSE savnet_siden END AS VARCHAR) AS savnet_siden
FROM enheter e LEFT JOIN sist USING (organisasjonsnummer)""")
def delta_apply(spark, sf_dir):
    companies = table(spark, sf_dir, "enheter")
    last = R.last_changes(table(spark, sf_dir, "feed"))
    changed = companies.join(last.filter("not slettes"), ORG, "left_semi").drop("savnet_siden", "slettet_dato")
    documents = changed.withColumn("navn", F.upper("navn"))
    rows = R.apply_changes(companies, documents, last.filter("slettes"), AS_OF)
    return rows.select(ORG, "navn", "slettet_dato", "savnet_siden")


_CURSOR, _MAX = 99, 60


@check("feed_capped_batch", tables="feed", oracle=f"""
, forste AS (SELECT organisasjonsnummer, min(oppdateringsid) AS f FROM feed WHERE oppdateringsid > {_CURSOR} GROUP BY 1),
stopp AS (SELECT min(f) AS s FROM (SELECT f, row_number() OVER (ORDER BY f) AS r FROM forste) t WHERE r > {_MAX})
SELECT oppdateringsid, organisasjonsnummer, endringstype FROM feed, stopp
WHERE oppdateringsid > {_CURSOR} AND (s IS NULL OR oppdateringsid < s)""")
def feed_capped_batch(spark, sf_dir):
    batch, _ = R.next_change_batch(table(spark, sf_dir, "feed"), _CURSOR, _MAX)
    return batch.select("oppdateringsid", ORG, "endringstype")


@check("feed_cursor_seed", tables="feed", oracle="SELECT min(oppdateringsid) - 1 AS siste_id FROM feed WHERE dato >= TIMESTAMP '2024-01-15'")
def feed_cursor_seed(spark, sf_dir):
    return R.seed_cursor(table(spark, sf_dir, "feed"), date(2024, 1, 15))


ROLES = """nokkel AS (
  SELECT *, concat_ws('|', organisasjonsnummer, rollegruppe_kode, rolletype_kode, coalesce(innehaver_orgnr, ''), coalesce(person_etternavn, ''),
    coalesce(person_fornavn, ''), coalesce(cast(person_fodselsdato - DATE '1970-01-01' AS VARCHAR), ''), coalesce(cast(rekkefolge AS VARCHAR), '')) AS n
  FROM roller),
naa AS (SELECT * FROM nokkel WHERE forst_sett < DATE '2001-01-01'),
inn AS (SELECT * FROM nokkel WHERE forst_sett >= DATE '1996-01-01')"""


def _role_sets(spark, sf_dir):
    roles = table(spark, sf_dir, "roller")
    current = roles.filter(F.col("forst_sett") < F.lit(date(2001, 1, 1)))
    incoming = roles.filter(F.col("forst_sett") >= F.lit(date(1996, 1, 1))).drop("forst_sett")
    return current, incoming


@check("scd2_closed", tables="roller", ctes=ROLES, oracle="SELECT o_orderkey, n AS rolle_nokkel FROM naa WHERE n NOT IN (SELECT n FROM inn)")
def scd2_closed(spark, sf_dir):
    return R.closed_roles(*_role_sets(spark, sf_dir)).select("o_orderkey", "rolle_nokkel")


@check("scd2_opened", tables="roller", ctes=ROLES, oracle="SELECT o_orderkey, n AS rolle_nokkel FROM inn WHERE n NOT IN (SELECT n FROM naa)")
def scd2_opened(spark, sf_dir):
    return R.opened_roles(*_role_sets(spark, sf_dir)).select("o_orderkey", "rolle_nokkel")


@check("scd2_current", tables="roller", ctes=ROLES, oracle=f"""
SELECT i.o_orderkey, cast(coalesce(f, {DAY}) AS VARCHAR) AS forst_sett FROM inn i LEFT JOIN (SELECT n, min(forst_sett) AS f FROM naa GROUP BY 1) USING (n)""")
def scd2_current(spark, sf_dir):
    current, incoming = _role_sets(spark, sf_dir)
    return R.reconcile_scd2(current, current.limit(0), incoming, AS_OF)[0].select("o_orderkey", "forst_sett")


@check("scd2_history", tables="roller", ctes=ROLES, oracle=f"""
SELECT o_orderkey, cast(forst_sett AS VARCHAR) AS forst_sett, cast({DAY} AS VARCHAR) AS sist_sett FROM naa WHERE n NOT IN (SELECT n FROM inn)""")
def scd2_history(spark, sf_dir):
    current, incoming = _role_sets(spark, sf_dir)
    return R.reconcile_scd2(current, current.limit(0), incoming, AS_OF)[1].select("o_orderkey", "forst_sett", "sist_sett")


@check("roles_flatten", tables="roller enheter", oracle="""
SELECT organisasjonsnummer, rollegruppe_kode, rolletype_kode, rekkefolge, avregistrert, person_fornavn, person_etternavn,
       cast(person_fodselsdato AS VARCHAR) AS person_fodselsdato, innehaver_orgnr, innehaver_navn || ' Ltd' AS innehaver_navn
FROM roller WHERE organisasjonsnummer IN (SELECT organisasjonsnummer FROM enheter WHERE slettet_dato IS NULL)""")
def roles_flatten(spark, sf_dir):
    """Each role as a nested document: written as JSON lines, read back and unnested."""
    roles = table(spark, sf_dir, "roller")
    person = F.when(F.col("person_fornavn").isNotNull(), F.struct(
        F.struct(F.col("person_fornavn").alias("fornavn"), F.col("person_mellomnavn").alias("mellomnavn"),
                 F.col("person_etternavn").alias("etternavn")).alias("navn"),
        F.coalesce(F.col("person_fodselsdato").cast("string"), F.lit("")).alias("fodselsdato")))
    unit = F.when(F.col("innehaver_navn").isNotNull(), F.struct(
        F.col("innehaver_orgnr").alias("organisasjonsnummer"), F.array("innehaver_navn", F.lit("Ltd")).alias("navn")))
    role = F.struct(
        F.struct(F.col("rolletype_kode").alias("kode"), F.col("rolletype_beskrivelse").alias("beskrivelse")).alias("type"),
        "rekkefolge", F.when(F.col("avregistrert"), True).alias("avregistrert"), person.alias("person"), unit.alias("enhet"))
    group = F.struct(F.struct(F.col("rollegruppe_kode").alias("kode")).alias("type"), F.array(role).alias("roller"))
    path = f"{checkpoint_root(spark)}/roller-{uuid.uuid4().hex}"
    roles.select(ORG, F.array(group).alias("rollegrupper")).write.json(path)
    documents = spark.read.schema(ROLE_DOCUMENT).json(path)
    flat = explode_roles(documents, table(spark, sf_dir, "enheter").filter("slettet_dato is null"))
    return flat.select(ORG, "rollegruppe_kode", "rolletype_kode", "rekkefolge", "avregistrert", "person_fornavn",
                       "person_etternavn", "person_fodselsdato", "innehaver_orgnr", "innehaver_navn")


@check("ambiguous_category", tables="navneliste", oracle="""
SELECT fornavn, CASE WHEN count(DISTINCT kjonn) > 1 THEN '?' ELSE min(kjonn) END AS kjonn FROM navneliste GROUP BY 1""")
def ambiguous_category(spark, sf_dir):
    return gender_by_name(table(spark, sf_dir, "navneliste"))


@check("reference_upsert", oracle="""
SELECT p_partkey AS kode, upper(p_name) AS navn FROM part WHERE p_size > 20
UNION ALL SELECT p_partkey, p_name FROM part WHERE p_size <= 20""")
def reference_upsert(spark, sf_dir):
    stored = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("kode"), F.col("p_name").alias("navn"), "p_size")
    incoming = stored.filter("p_size > 20").withColumn("navn", F.upper("navn"))
    return R.upsert_reference(stored.drop("p_size"), incoming.drop("p_size"), "kode")


@check("latest_run_per_source", tables="kjoringer", oracle="""
SELECT kilde, event_id, status, rader_lest, cast(epoch(TIMESTAMP '2024-02-01') - floor(epoch(startet_at)) AS BIGINT) AS alder_sek
FROM (SELECT *, row_number() OVER (PARTITION BY kilde ORDER BY startet_at DESC) AS r FROM kjoringer) t WHERE r = 1""")
def latest_run_per_source(spark, sf_dir):
    rows = Q.run_status(table(spark, sf_dir, "kjoringer"), datetime(2024, 2, 1))
    return rows.select("kilde", "event_id", "status", "rader_lest", "alder_sek")


ATTEMPTS = """siste_forsok AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY organisasjonsnummer ORDER BY forsokt_at DESC) AS r FROM forsok) t WHERE r = 1)"""


def _targets(name, mode, condition, joins="", first="", **options):
    @check(name, tables="enheter regnskap forsok", ctes=ATTEMPTS, oracle=f"""
SELECT e.organisasjonsnummer, row_number() OVER (ORDER BY {first} antall_ansatte DESC NULLS LAST, e.organisasjonsnummer) AS plass FROM enheter e {joins} WHERE {condition}""")
    def query(spark, sf_dir):
        r = register(spark, sf_dir)
        return W.targets(r.companies, r.accounts, r.attempts, mode, **options)
    return query


_targets("targets_new", "nye", "slettet_dato IS NULL AND siste_innsendte_aarsregnskap > coalesce(aar, 0)",
         "LEFT JOIN (SELECT organisasjonsnummer, max(year(periode_til)) AS aar FROM regnskap GROUP BY 1) USING (organisasjonsnummer)")
_targets("targets_all", "alle", "slettet_dato IS NULL AND siste_innsendte_aarsregnskap IS NOT NULL",
         "LEFT JOIN siste_forsok USING (organisasjonsnummer)", "forsokt_at NULLS FIRST,")
_targets("targets_seed", "seed", """slettet_dato IS NULL AND siste_innsendte_aarsregnskap >= 2000 AND antall_ansatte >= 50
  AND organisasjonsnummer NOT IN (SELECT organisasjonsnummer FROM forsok)""", seed_year=2000)


@check("stale_targets", tables="forsok", ctes=ATTEMPTS, oracle="""
SELECT organisasjonsnummer, row_number() OVER (ORDER BY forsokt_at, organisasjonsnummer) AS plass FROM siste_forsok WHERE status = 'ok' AND forsokt_at < TIMESTAMP '2024-01-30'""")
def stale_targets(spark, sf_dir):
    r = register(spark, sf_dir)
    return W.targets(r.companies, r.accounts, r.attempts, "gamle", as_of=date(2024, 2, 1), stale_days=2)


VECTORS = """beskrevet AS (
  SELECT organisasjonsnummer, concat(navn, '. ', coalesce(aktivitet, vedtektsfestet_formaal)) AS tekst, konkurs, antall_ansatte, slettet_dato
  FROM enheter WHERE length(coalesce(aktivitet, vedtektsfestet_formaal)) >= 12)"""


def _vectors(spark, sf_dir):
    """Vectors for companies with reported staff; bankrupt ones were embedded from another text, large ones by another model."""
    companies = table(spark, sf_dir, "enheter").filter("antall_ansatte is not null or konkurs")
    text = F.concat("navn", F.lit(". "), C.description())
    stale = F.when(F.col("konkurs"), F.lit("old")).otherwise(F.sha2(text, 256))
    model = F.when(F.col("antall_ansatte") > 150, "m0").otherwise("m1")
    return companies.filter(C.description().isNotNull()).select(ORG, stale.alias("tekst_hash"), model.alias("modell"))


@check("embedding_targets", tables="enheter", ctes=VECTORS, oracle="""
SELECT organisasjonsnummer, tekst FROM beskrevet WHERE slettet_dato IS NULL
  AND NOT (NOT konkurs AND antall_ansatte IS NOT NULL AND antall_ansatte <= 150)""")
def embedding_targets(spark, sf_dir):
    return W.needs_embedding(table(spark, sf_dir, "enheter"), _vectors(spark, sf_dir), "m1").select(ORG, "tekst")


@check("embedding_coverage", tables="enheter", ctes=VECTORS, oracle="""
SELECT count(*) FILTER (WHERE konkurs OR antall_ansatte IS NOT NULL) AS gjort, count(*) AS totalt,
       round(100.0 * count(*) FILTER (WHERE konkurs OR antall_ansatte IS NOT NULL) / count(*), 1) AS andel, false AS ferdig
FROM beskrevet WHERE slettet_dato IS NULL""")
def embedding_coverage(spark, sf_dir):
    return W.embedding_coverage(table(spark, sf_dir, "enheter"), _vectors(spark, sf_dir))


@check("table_counts", tables="enheter regnskap roller aksjonar_raw", oracle=" UNION ALL ".join(
    f"SELECT '{n}' AS tabell, count(*) AS rader FROM {t}" for n, t in
    [("enheter", "enheter"), ("regnskap", "regnskap"), ("roller", "roller"), ("aksjonar", "aksjonar_raw")]))
def table_counts(spark, sf_dir):
    r = register(spark, sf_dir)
    return Q.table_counts({"enheter": r.companies, "regnskap": r.accounts, "roller": r.roles, "aksjonar": r.holdings})


@check("accounts_extent", tables="regnskap", oracle="""
SELECT min(year(periode_til)) AS fra, max(year(periode_til)) AS til, count(DISTINCT organisasjonsnummer) AS foretak,
       count(*) FILTER (WHERE kilde = 'brreg-api') AS fra_api, count(*) FILTER (WHERE kilde = 'historikk') AS fra_historikk FROM regnskap""")
def accounts_extent(spark, sf_dir):
    return Q.accounts_extent(table(spark, sf_dir, "regnskap"))


@check("coverage_flags", tables="enheter regnskap roller forsok", ctes=f"{LATEST},\n{ROLES},\n{ATTEMPTS}", oracle="""
SELECT count(*) FILTER (WHERE slettet_dato IS NULL) AS foretak,
       count(*) FILTER (WHERE slettet_dato IS NULL AND siste_innsendte_aarsregnskap IS NOT NULL) AS med_regnskap,
       count(*) FILTER (WHERE slettet_dato IS NULL AND length(coalesce(aktivitet, vedtektsfestet_formaal)) >= 12) AS med_beskrivelse,
       count(*) FILTER (WHERE slettet_dato IS NOT NULL) AS slettet, count(*) FILTER (WHERE savnet_siden IS NOT NULL) AS savnet,
       (SELECT count(*) FROM naa WHERE n NOT IN (SELECT n FROM inn)) AS arkiverte_roller, '2001-08-02' AS arkiv_fra,
       (SELECT count(*) FROM latest WHERE NOT rimelig) AS urimelige,
       (SELECT count(*) FROM siste_forsok WHERE status = 'feil') AS hentefeil,
       (SELECT count(*) FROM siste_forsok WHERE status = 'ingen_data') AS ingen_regnskap
FROM enheter""")
def coverage_flags(spark, sf_dir):
    r = register(spark, sf_dir)
    current, incoming = _role_sets(spark, sf_dir)
    history = R.reconcile_scd2(current, current.limit(0), incoming, AS_OF)[1]
    return Q.coverage(r.companies, r.latest, history, r.attempts)


@check("mix_by_source", tables="regnskap", oracle="SELECT kilde, coalesce(valuta, '—') AS valuta, count(*) AS rader FROM regnskap GROUP BY 1, 2")
def mix_by_source(spark, sf_dir):
    return Q.currency_mix(table(spark, sf_dir, "regnskap"))


@check("currency_totals", tables="regnskap", oracle="SELECT coalesce(valuta, '—') AS valuta, count(*) AS rader FROM regnskap GROUP BY 1")
def currency_totals(spark, sf_dir):
    return Q.currency_totals(Q.currency_mix(table(spark, sf_dir, "regnskap")))


@check("orphans", tables="enheter aksjonar_raw", ctes=HOLDINGS, oracle="""
SELECT organisasjonsnummer, count(*) AS rader FROM aksjonar WHERE organisasjonsnummer NOT IN (SELECT organisasjonsnummer FROM enheter) GROUP BY 1""")
def orphans(spark, sf_dir):
    r = register(spark, sf_dir)
    return Q.orphans(r.holdings, r.companies).groupBy(ORG).agg(F.count(F.lit(1)).alias("rader"))


@check("reference_violations", tables="enheter kommuner", oracle="""
SELECT 'forretningsadresse_kommunenummer' AS kolonne, forretningsadresse_kommunenummer AS verdi, count(*) AS rader FROM enheter
WHERE forretningsadresse_kommunenummer NOT IN (SELECT kommunenummer FROM kommuner) GROUP BY 2""")
def reference_violations(spark, sf_dir):
    r = register(spark, sf_dir)
    return Q.reference_violations(r.companies, "forretningsadresse_kommunenummer", r.municipalities, "kommunenummer")


@check("rule_violations", tables="roller", oracle="""
SELECT 'en innehaver' AS regel, count(*) FILTER (WHERE person_etternavn IS NOT NULL AND innehaver_orgnr IS NOT NULL) AS brudd FROM roller
UNION ALL SELECT 'har innehaver', count(*) FILTER (WHERE person_etternavn IS NULL AND innehaver_orgnr IS NULL) FROM roller""")
def rule_violations(spark, sf_dir):
    person, unit = F.col("person_etternavn").isNotNull(), F.col("innehaver_orgnr").isNotNull()
    return Q.rule_counts(table(spark, sf_dir, "roller"), {"en innehaver": ~(person & unit), "har innehaver": person | unit})


@check("off_thousand", tables="regnskap", oracle=" UNION ALL ".join(
    f"SELECT '{c}' AS kolonne, count(*) FILTER (WHERE {c} % 1000 <> 0) AS antall FROM regnskap" for c in
    ["sum_driftsinntekter", "sum_driftskostnad", "driftsresultat", "aarsresultat", "sum_eiendeler", "sum_egenkapital", "sum_gjeld"]))
def off_thousand(spark, sf_dir):
    return Q.off_thousand(table(spark, sf_dir, "regnskap"))


@check("failure_rate", tables="forsok", oracle="""
SELECT count(*) AS forsok, count(*) FILTER (WHERE status = 'feil') AS feil, count(*) FILTER (WHERE status = 'feil') > 0.1 * count(*) AS mislykket FROM forsok""")
def failure_rate(spark, sf_dir):
    return Q.failure_rate(table(spark, sf_dir, "forsok"))
