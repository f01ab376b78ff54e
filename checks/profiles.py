"""Profiles of every company at once."""

from pyspark.sql import functions as F

from checks.reconciling import ROLES, _role_sets
from checks.registry import HOLDINGS, check
from checks.standins import AS_OF, register
from fjordbook.operators.reconcile import reconcile_scd2
from fjordbook.plans import profiles as P
from fjordbook.schema import ORG


@check("dossier", tables="enheter regnskap roller aksjonar_raw kommuner fylker naeringskoder", ctes=HOLDINGS, oracle="""
, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY organisasjonsnummer ORDER BY periode_til DESC, regnskapstype DESC) AS r FROM regnskap) t WHERE r = 1),
antall_r AS (SELECT organisasjonsnummer, count(*) AS n FROM roller GROUP BY 1),
antall_a AS (SELECT organisasjonsnummer, count(*) AS n FROM regnskap GROUP BY 1),
antall_e AS (SELECT organisasjonsnummer, count(*) AS n FROM aksjonar GROUP BY 1),
antall_d AS (SELECT eier_orgnr AS organisasjonsnummer, count(*) AS n FROM shares WHERE micro > 50000000 GROUP BY 1)
SELECT e.organisasjonsnummer, e.navn, k.navn AS kommune, f.navn AS fylke, i.navn AS naering, p.navn AS morselskap,
       coalesce(r.n, 0) AS antall_roller, coalesce(a.n, 0) AS antall_regnskap, coalesce(o.n, 0) AS antall_aksjonaerer, coalesce(d.n, 0) AS antall_datterselskap,
       cast(s.periode_til AS VARCHAR) AS periode_til, s.valuta, s.kilde, cast(s.sum_driftsinntekter AS DOUBLE) AS sum_driftsinntekter, cast(s.sum_gjeld AS DOUBLE) AS sum_gjeld
FROM enheter e LEFT JOIN kommuner k ON k.kommunenummer = e.forretningsadresse_kommunenummer LEFT JOIN fylker f USING (fylkesnummer)
LEFT JOIN naeringskoder i ON i.kode = e.naeringskode1_kode LEFT JOIN enheter p ON p.organisasjonsnummer = e.overordnet_enhet
LEFT JOIN antall_r r ON r.organisasjonsnummer = e.organisasjonsnummer LEFT JOIN antall_a a ON a.organisasjonsnummer = e.organisasjonsnummer
LEFT JOIN antall_e o ON o.organisasjonsnummer = e.organisasjonsnummer LEFT JOIN antall_d d ON d.organisasjonsnummer = e.organisasjonsnummer
LEFT JOIN newest s ON s.organisasjonsnummer = e.organisasjonsnummer""")
def dossier(spark, sf_dir):
    return P.dossier(register(spark, sf_dir)).select(
        ORG, "navn", "kommune", "fylke", "naering", "morselskap", "antall_roller", "antall_regnskap", "antall_aksjonaerer",
        "antall_datterselskap", "periode_til", "valuta", "kilde", "sum_driftsinntekter", "sum_gjeld")


@check("roles_listed", tables="roller", oracle="""
SELECT organisasjonsnummer, o_orderkey, rollegruppe_kode, rekkefolge, coalesce(innehaver_navn,
  concat_ws(' ', person_fornavn, person_mellomnavn, person_etternavn)) AS innehaver FROM roller""")
def roles_listed(spark, sf_dir):
    return P.roles_of(register(spark, sf_dir).roles).select(ORG, "o_orderkey", "rollegruppe_kode", "rekkefolge", "innehaver")


@check("roles_ended", tables="roller", ctes=ROLES, oracle="""
, endte AS (SELECT *, coalesce(innehaver_navn, concat_ws(' ', person_fornavn, person_mellomnavn, person_etternavn)) AS innehaver FROM naa WHERE n NOT IN (SELECT n FROM inn))
SELECT organisasjonsnummer, rolletype_kode, innehaver, rekkefolge,
       row_number() OVER (PARTITION BY organisasjonsnummer ORDER BY rolletype_kode, innehaver, rekkefolge NULLS LAST) AS nr FROM endte""")
def roles_ended(spark, sf_dir):
    current, incoming = _role_sets(spark, sf_dir)
    history = reconcile_scd2(current, current.limit(0), incoming, AS_OF)[1]
    return P.ended_roles_of(history).select(ORG, "rolletype_kode", "innehaver", "rekkefolge", "nr")


@check("roles_by_group", tables="roller", oracle="""
SELECT organisasjonsnummer, rollegruppe_kode, count(*) AS antall, min(rekkefolge) AS forste,
       string_agg(innehaver, ', ' ORDER BY rekkefolge NULLS LAST, rolletype_kode, innehaver) AS medlemmer
FROM (SELECT *, coalesce(innehaver_navn, concat_ws(' ', person_fornavn, person_mellomnavn, person_etternavn)) AS innehaver FROM roller) r GROUP BY 1, 2""")
def roles_by_group(spark, sf_dir):
    return P.roles_by_group(register(spark, sf_dir).roles).withColumn("medlemmer", F.array_join("medlemmer", ", "))


@check("geo_counts", tables="enheter kommuner fylker", oracle="""
, aktive AS (SELECT forretningsadresse_kommunenummer AS nr, 1 AS en FROM enheter WHERE slettet_dato IS NULL),
steder AS (
  SELECT kommunenummer AS nr, navn, fylkesnummer AS fylke, ifnull((SELECT sum(en) FROM aktive a WHERE a.nr = kommunenummer), 0)::BIGINT AS antall FROM kommuner)
SELECT 'kommune' AS nivaa, * FROM steder
UNION ALL BY NAME SELECT 'fylke' AS nivaa, fylkesnummer AS nr, navn, ifnull((SELECT sum(s.antall) FROM steder s WHERE s.fylke = fylkesnummer), 0)::BIGINT AS antall FROM fylker""")
def geo_counts(spark, sf_dir):
    return P.geo_counts(register(spark, sf_dir))
