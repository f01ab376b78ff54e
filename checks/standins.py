"""Register tables derived from the driver's tables.

Each register table is one SQL statement in the dialect Spark and DuckDB share,
so both sides of a check start from the same rows. What is checked is what the
package computes from them.
"""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordbook.operators.accounts import latest_attempt
from fjordbook.operators.holdings import classify_holders
from fjordbook.plans.rankings import Register
from fjordbook.schema import ORG
from fjordbook.sources.files import gender_by_name

AS_OF = date(2001, 8, 2)

_ORG = "lpad(cast({0} AS string), 9, '0')"
_PRICE = "cast(o_totalprice AS decimal(20,2)) * 100"


def _thousand(amount: str) -> str:
    return f"cast(round(({amount}) / 1000, 0) * 1000 AS decimal(20,2))"


_CODE = (
    "concat(substr(c_mktsegment, 1, 1), '.', cast(c_nationkey % 10 AS string), '.', cast(c_nationkey AS string), "
    "'.', cast(c_custkey % 3 AS string), '.', cast(c_custkey % 7 AS string))"
)


def _tree_level(level: int) -> str:
    code = "concat(" + ", '.', ".join("abcde"[:level]) + ")"
    parent = "concat(" + ", '.', ".join("abcde"[: level - 1]) + ")" if level > 1 else "cast(NULL AS string)"
    return f"SELECT DISTINCT {code} AS kode, concat('Industry ', {code}) AS navn, {level} AS niva, {parent} AS parent_kode FROM blad"


#: Every industry code is a path of five parts; its prefixes are the codes above it.
NAERINGSKODER = """
WITH blad AS (SELECT DISTINCT substr(c_mktsegment, 1, 1) AS a, cast(c_nationkey % 10 AS string) AS b, cast(c_nationkey AS string) AS c,
                     cast(c_custkey % 3 AS string) AS d, cast(c_custkey % 7 AS string) AS e FROM {customer})
""" + " UNION ALL ".join(_tree_level(i) for i in range(1, 6))

#: Companies are customers; their parts are spread by key and balance so every state occurs.
ENHETER = f"""
SELECT {_ORG.format('c_custkey')} AS organisasjonsnummer,
       c_name AS navn,
       substr(c_mktsegment, 1, 4) AS organisasjonsform_kode,
       CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE {_CODE} END AS naeringskode1_kode,
       CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE concat('Industry ', {_CODE}) END AS naeringskode1_beskrivelse,
       c_acctbal >= 1000 AS har_registrert_antall_ansatte,
       CASE WHEN c_acctbal >= 1000 THEN cast(floor(c_acctbal) AS int) % 200 END AS antall_ansatte,
       CASE WHEN c_custkey % 40 = 0 THEN '9999'
            ELSE concat(lpad(cast(c_nationkey % 5 + 1 AS string), 2, '0'), lpad(cast(c_nationkey AS string), 2, '0'))
       END AS forretningsadresse_kommunenummer,
       concat('PLACE ', cast(c_nationkey AS string)) AS forretningsadresse_poststed,
       date '1995-01-01' + cast((c_custkey * 7919) % 2404 AS int) AS registreringsdato_enhetsregisteret,
       CASE WHEN c_custkey % 13 <> 0 THEN date '1890-01-01' + cast((c_custkey * 104729) % 38000 AS int) END AS stiftelsesdato,
       CASE WHEN c_custkey % 4 <> 0 THEN cast(1996 + c_custkey % 7 AS int) END AS siste_innsendte_aarsregnskap,
       c_acctbal < -400 AS konkurs,
       CASE WHEN c_acctbal < -450 THEN date '1999-01-01' + cast((c_custkey * 31) % 700 AS int) END AS konkursdato,
       c_acctbal >= -400 AND c_acctbal < -200 AS under_avvikling,
       c_acctbal >= -200 AND c_acctbal < 0 AS under_tvangsavvikling,
       CASE WHEN c_custkey % 10 = 3 THEN {_ORG.format('cast(floor(c_custkey / 10) AS bigint)')} END AS overordnet_enhet,
       CASE WHEN c_custkey % 3 <> 0 THEN concat('Trading and servicing of ', lower(c_mktsegment), ' goods in region ', cast(c_nationkey % 5 AS string)) END AS aktivitet,
       CASE WHEN c_custkey % 5 <> 0 THEN concat('Owns shares; operates ', lower(c_mktsegment), ' stations, no. ', cast(c_nationkey AS string)) END AS vedtektsfestet_formaal,
       cast(abs(c_acctbal) AS decimal(20,2)) * 1000 AS kapital_belop,
       CASE WHEN c_custkey % 20 = 0 THEN 'USD' ELSE 'NOK' END AS kapital_valuta,
       CASE WHEN c_custkey % 50 = 7 THEN date '2001-01-01' + cast(c_custkey % 200 AS int) END AS slettet_dato,
       CASE WHEN c_custkey % 50 = 9 THEN date '2001-07-20' + cast(c_custkey % 13 AS int) END AS savnet_siden
FROM {{customer}}
"""

#: One account per customer, year and type; a third of the orders make the group's account.
REGNSKAP = f"""
SELECT {_ORG.format('o_custkey')} AS organisasjonsnummer,
       CASE WHEN o_orderstatus = 'P' THEN 'KONSERN' ELSE 'SELSKAP' END AS regnskapstype,
       make_date(cast(year(o_orderdate) AS int), 12, 31) AS periode_til,
       CASE WHEN o_custkey % 20 = 0 THEN 'USD' WHEN o_custkey % 20 = 1 THEN NULL ELSE 'NOK' END AS valuta,
       CASE WHEN year(o_orderdate) >= 1999 THEN 'brreg-api' ELSE 'historikk' END AS kilde,
       {_thousand(f'sum({_PRICE})')} AS sum_driftsinntekter,
       {_thousand(f'sum(CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE {_PRICE} END)')} AS sum_driftskostnad,
       {_thousand(f'sum(CASE WHEN o_orderkey % 4 = 0 THEN {_PRICE} ELSE 0 END)')} AS driftsresultat,
       {_thousand(f'sum(CASE WHEN o_orderkey % 2 = 0 THEN {_PRICE} ELSE -1 * {_PRICE} END)')} AS aarsresultat,
       {_thousand(f'sum(2 * {_PRICE})')} AS sum_eiendeler,
       {_thousand(f'sum(CASE WHEN o_orderkey % 3 = 0 THEN -1 * {_PRICE} ELSE {_PRICE} END)')} AS sum_egenkapital,
       {_thousand(f'sum(CASE WHEN o_orderkey % 3 = 0 THEN 3 * {_PRICE} ELSE {_PRICE} END)')} AS sum_gjeld
FROM {{orders}}
GROUP BY o_custkey, year(o_orderdate), CASE WHEN o_orderstatus = 'P' THEN 'KONSERN' ELSE 'SELSKAP' END
"""

#: Each order is one seat: managers, chairs and members are persons, auditors and accountants companies.
ROLLER = f"""
SELECT {_ORG.format('o_custkey')} AS organisasjonsnummer,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'DAGL' WHEN '2' THEN 'STYR' WHEN '3' THEN 'STYR' WHEN '4' THEN 'REVI' ELSE 'REGN' END AS rollegruppe_kode,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'DAGL' WHEN '2' THEN 'LEDE' WHEN '3' THEN 'MEDL' WHEN '4' THEN 'REVI' ELSE 'REGN' END AS rolletype_kode,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Manager' WHEN '2' THEN 'Chair' WHEN '3' THEN 'Member' WHEN '4' THEN 'Auditor' ELSE 'Accountant' END AS rolletype_beskrivelse,
       CASE WHEN o_orderkey % 9 <> 0 THEN cast(o_orderkey % 4 AS int) END AS rekkefolge,
       o_orderkey % 11 = 0 AS avregistrert,
       CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '3') THEN concat('Nation_', cast(o_orderkey % 23 AS string), ' Jo') END AS person_fornavn,
       CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '3') AND o_orderkey % 5 = 0 THEN 'Middle' END AS person_mellomnavn,
       CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '3') THEN concat('Family', cast(o_custkey % 40 AS string)) END AS person_etternavn,
       CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '3') AND o_orderkey % 17 <> 0 THEN date '1950-01-01' + cast(o_orderkey % 29 AS int) END AS person_fodselsdato,
       CASE WHEN substr(o_orderpriority, 1, 1) IN ('4', '5') AND o_orderkey % 31 <> 0 THEN {_ORG.format('(o_orderkey % 97) * 40')} END AS innehaver_orgnr,
       CASE WHEN substr(o_orderpriority, 1, 1) IN ('4', '5') THEN concat('Office ', cast(o_orderkey % 97 AS string)) END AS innehaver_navn,
       cast(o_orderdate AS date) AS forst_sett,
       o_orderkey
FROM {{orders}}
"""

#: Raw shareholder lines: holders are persons (a birth year), companies (a key) or neither.
AKSJONAR_RAW = """
SELECT cast(l_orderkey AS string) AS orgnr,
       concat('Company ', cast(l_orderkey AS string)) AS selskap,
       l_returnflag AS aksjeklasse,
       concat('Holder ', cast(l_suppkey AS string)) AS eier_navn,
       CASE WHEN l_suppkey % 11 = 4 THEN '' WHEN l_suppkey % 5 = 2 THEN cast(1930 + l_suppkey % 70 AS string)
            ELSE lpad(cast(l_suppkey AS string), 9, '0') END AS fodselsaar_orgnr,
       CASE WHEN l_linenumber = 7 THEN 'LONDON' ELSE concat(lpad(cast(l_partkey % 10000 AS string), 4, '0'), ' TOWN ', l_linestatus) END AS postnr_sted,
       CASE WHEN l_linenumber = 7 THEN 'GBR' ELSE 'NOR' END AS landkode,
       cast(cast(l_quantity AS int) AS string) AS antall_aksjer,
       cast(cast(t.total AS int) AS string) AS antall_aksjer_selskap,
       CASE WHEN l_returnflag = 'R' THEN 2023 ELSE 2024 END AS aar
FROM {lineitem} LEFT JOIN (SELECT l_orderkey AS k, sum(l_quantity) AS total FROM {lineitem} GROUP BY l_orderkey) t ON l_orderkey = t.k
"""

TABLES: dict[str, str] = {
    "enheter": ENHETER,
    "regnskap": REGNSKAP,
    "roller": ROLLER,
    "aksjonar_raw": AKSJONAR_RAW,
    "naeringskoder": NAERINGSKODER,
    "kommuner": """SELECT concat(lpad(cast(n_regionkey + 1 AS string), 2, '0'), lpad(cast(n_nationkey AS string), 2, '0')) AS kommunenummer,
                          n_name AS navn, lpad(cast(n_regionkey + 1 AS string), 2, '0') AS fylkesnummer FROM {nation}""",
    "fylker": "SELECT lpad(cast(r_regionkey + 1 AS string), 2, '0') AS fylkesnummer, r_name AS navn FROM {region}",
    "navneliste": """SELECT n_name AS fornavn, 'K' AS kjonn FROM {nation} WHERE n_nationkey % 5 IN (0, 1, 3)
                     UNION ALL SELECT n_name, 'M' FROM {nation} WHERE n_nationkey % 5 IN (0, 2, 4)""",
    "feed": f"""SELECT event_id AS oppdateringsid, ts AS dato, {_ORG.format('user_id')} AS organisasjonsnummer,
                       CASE event_type WHEN 'error' THEN 'Sletting' WHEN 'signup' THEN 'Ny' WHEN 'purchase' THEN 'Fjernet' ELSE 'Endring' END AS endringstype
                FROM {{events}}""",
    "forsok": f"""SELECT {_ORG.format('user_id')} AS organisasjonsnummer, ts AS forsokt_at,
                         CASE event_type WHEN 'error' THEN 'feil' WHEN 'view' THEN 'ingen_data' ELSE 'ok' END AS status,
                         CASE event_type WHEN 'error' THEN 500 WHEN 'view' THEN 404 ELSE 200 END AS http_status,
                         cast(floor(value) AS int) AS antall_perioder,
                         CASE event_type WHEN 'error' THEN props END AS feilmelding
                  FROM {{events}}""",
    "kjoringer": """SELECT concat('kilde-', cast(user_id % 12 AS string)) AS kilde, ts AS startet_at, event_id,
                           CASE event_type WHEN 'error' THEN 'feilet' ELSE 'ok' END AS status, cast(floor(value) AS int) AS rader_lest
                    FROM {events}""",
}


SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A register table derived from the driver's tables."""
    text = TABLES[name]
    used = {t: load(spark, sf_dir, t) for t in SCHEMAS if "{" + t + "}" in text}
    return spark.sql(text, **used)


class StandinRegister(Register):
    """A register over the driver's tables; each table is set up when a query first asks for it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._get = lambda name: table(spark, sf_dir, name)
        self.as_of = AS_OF
        self.history = None
        self.stored = {}

    companies = cached_property(lambda self: self._get("enheter"))
    accounts = cached_property(lambda self: self._get("regnskap"))
    roles = cached_property(lambda self: self._get("roller"))
    holdings = cached_property(lambda self: classify_holders(self._get("aksjonar_raw"), F.col("aar")))
    municipalities = cached_property(lambda self: self._get("kommuner"))
    counties = cached_property(lambda self: self._get("fylker"))
    industries = cached_property(lambda self: self._get("naeringskoder"))
    first_names = cached_property(lambda self: gender_by_name(self._get("navneliste")))
    attempts = cached_property(lambda self: latest_attempt(self._get("forsok")))


def register(spark: SparkSession, sf_dir: str) -> Register:
    return StandinRegister(spark, sf_dir)


def duck(*names: str) -> str:
    """``WITH`` clause giving DuckDB the named register tables and those they build on."""
    plain = {t: t for t in SCHEMAS}
    return "WITH " + ",\n".join(f"{n} AS ({TABLES[n].format(**plain)})" for n in names)


def write_arrays(documents: DataFrame, keys: DataFrame, path: str, shares: int, opening: str, between: str, closing: str) -> None:
    """Files of ``(key, d)`` documents, one for each share of the companies: all of a share between ``opening`` and ``closing``.

    The writer ends a line with the file's last character, and a line ends where this
    stands last in a document; all documents end in a list and a brace. So the files
    have no other character, and no row is as long as a share. ``keys`` has all keys.
    """
    ends = closing[-1:] or "}"
    rest = "}" if ends == "]" else ""
    share = F.pmod(F.xxhash64(ORG), F.lit(shares)).alias("del")
    least = {r["del"]: r.least for r in keys.groupBy(share).agg(F.min(ORG).alias("least")).collect()}  # one for each share
    first = F.coalesce(F.col(ORG).isin([key for key in least.values() if key is not None]), F.lit(None in least.values()))
    head = F.when(first, F.lit(opening)).otherwise(F.lit(rest + between))
    lines = documents.select(share, F.lit(False).alias("bak"), ORG, F.concat(head, F.col("d").substr(F.lit(1), F.length("d") - len(ends + rest))).alias("value"))
    if closing:
        last = documents.sparkSession.createDataFrame([(n, True, None, rest + closing[:-1]) for n in least], lines.schema)
        lines = lines.unionByName(last)
    _write_lines(lines.repartition(shares, "del").sortWithinPartitions("del", "bak", F.asc_nulls_last(ORG)), path, ends)


def write_empty(keys: DataFrame, path: str, shares: int, text: str) -> None:
    """Files of ``text`` alone, one for each share that has companies."""
    share = F.pmod(F.xxhash64(ORG), F.lit(shares)).alias("del")
    _write_lines(keys.select(share).distinct().withColumn("value", F.lit(text[:-1])), path, text[-1])


def _write_lines(lines: DataFrame, path: str, ends: str) -> None:
    lines.select("del", "value").write.partitionBy("del").text(path, lineSep=ends)
