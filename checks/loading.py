"""Loads that meet bad rows, repeated keys and failures half-way."""

import uuid
from contextlib import suppress
from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.reconciling import DAY, LAST, ROLES, SNAPSHOTS, _GONE, _SINCE, _role_sets, _snapshots
from checks.registry import check
from checks.standins import AS_OF, table, write_arrays
from fjordbook.operators import reconcile as R
from fjordbook.plans import jobs
from fjordbook.schema import COMPANY_MAPPING, ORG
from fjordbook.session import checkpoint_root
from fjordbook.sources.files import company_documents
from fjordbook.sources.runs import RunLog
from fjordbook.sources.tables import TableStore

_SEEN = SNAPSHOTS.replace("n.organisasjonsnummer IS NOT NULL AS finnes", "n.organisasjonsnummer IS NOT NULL OR s.organisasjonsnummer IS NOT NULL AS finnes").replace(
    "WHEN n.organisasjonsnummer IS NULL THEN 'fravaerende'", "WHEN s.organisasjonsnummer IS NOT NULL THEN 'avvist' WHEN n.organisasjonsnummer IS NULL THEN 'fravaerende'").replace(
    "FROM gammel g FULL JOIN ny n ON n.organisasjonsnummer = g.organisasjonsnummer)",
    "FROM gammel g FULL JOIN (SELECT * FROM ny WHERE organisasjonsnummer NOT LIKE '%3') n ON n.organisasjonsnummer = g.organisasjonsnummer "
    "LEFT JOIN (SELECT organisasjonsnummer FROM ny WHERE organisasjonsnummer LIKE '%3') s ON s.organisasjonsnummer = g.organisasjonsnummer)")


@check("snapshot_with_rejects", tables="enheter", ctes=_SEEN, oracle=f"""
SELECT organisasjonsnummer, navn, utfall, cast({_SINCE} AS VARCHAR) AS savnet_siden, cast({_GONE} AS VARCHAR) AS slettet_dato FROM begge""")
def snapshot_with_rejects(spark, sf_dir):
    """Rows of keys ending in 3 do not fit: their companies are in the file and keep what is stored."""
    old, new = _snapshots(spark, sf_dir)
    bad = F.col(ORG).endswith("3")
    loaded = R.load_snapshot(old, new.filter(~bad), AS_OF, rejected=new.filter(bad).select(ORG))
    return loaded.select(ORG, "navn", "utfall", "savnet_siden", "slettet_dato")


@check("snapshot_duplicate_keys", tables="enheter", ctes=SNAPSHOTS, oracle="""
SELECT organisasjonsnummer, 1 AS beholdt, CASE WHEN organisasjonsnummer LIKE '%5' THEN 2 ELSE 0 END AS avvist FROM ny""")
def snapshot_duplicate_keys(spark, sf_dir):
    """Keys ending in 5 come three times, twice alike: one row of each enters, the others are rejects."""
    new = _snapshots(spark, sf_dir)[1]
    twice = new.filter(F.col(ORG).endswith("5"))
    renamed = R.add_content_hash(twice.drop("content_hash").withColumn("navn", F.concat("navn", F.lit(" x"))))
    kept, others = R.one_per_key(new.unionAll(twice).unionAll(renamed.select(*new.columns)))
    counted = kept.select(ORG, F.lit(1).alias("k"), F.lit(0).alias("a")).unionAll(others.select(ORG, F.lit(0), F.lit(1)))
    return counted.groupBy(ORG).agg(F.sum("k").alias("beholdt"), F.sum("a").alias("avvist"))


@check("delta_rejects", tables="enheter feed", ctes=LAST, oracle=f"""
SELECT e.organisasjonsnummer, CASE WHEN endret AND NOT daarlig THEN upper(navn) ELSE navn END AS navn,
       CASE WHEN endret AND NOT daarlig THEN 12 ELSE antall_ansatte END AS antall_ansatte,
       CASE WHEN NOT endret OR NOT daarlig THEN '' WHEN e.organisasjonsnummer LIKE '%1' THEN 'antall_ansatte' WHEN e.organisasjonsnummer LIKE '%2' THEN 'organisasjonsnummer' ELSE 'organisasjonsnummer' END AS feil
FROM (SELECT e.*, coalesce(s.endringstype IN ('Ny', 'Endring'), false) AS endret, right(e.organisasjonsnummer, 1) IN ('1', '2', '3') AS daarlig
      FROM enheter e LEFT JOIN sist s USING (organisasjonsnummer)) e""")
def delta_rejects(spark, sf_dir):
    """Documents with an unreadable number, another company's key, or no JSON: stored rows stay, faults are named."""
    companies = table(spark, sf_dir, "enheter")
    changed = companies.join(R.last_changes(table(spark, sf_dir, "feed")).filter("not slettes"), ORG, "left_semi")
    digit = F.right(ORG, F.lit(1))
    stated = F.when(digit == "2", F.lit("000000000")).otherwise(F.col(ORG))
    staff = F.when(digit == "1", "12x").otherwise("12")
    body = F.to_json(F.struct(stated.alias(ORG), F.upper("navn").alias("navn"), staff.alias("antallAnsatte")))
    documents = changed.select(ORG, F.when(digit == "3", "{no json").otherwise(body).alias("doc"))
    rows, rejects = company_documents(documents)
    applied = R.apply_changes(companies, rows, rows.limit(0).select(ORG), AS_OF)
    faults = rejects.select(ORG, F.array_join("feil_kolonner", ",").alias("feil"))
    return applied.join(faults, ORG, "left").select(ORG, "navn", "antall_ansatte", F.coalesce("feil", F.lit("")).alias("feil"))


@check("roles_interrupted_load", tables="roller", ctes=ROLES, oracle=f"""
SELECT o_orderkey, cast(forst_sett AS VARCHAR) AS forst_sett, cast({DAY} AS VARCHAR) AS sist_sett FROM naa WHERE n NOT IN (SELECT n FROM inn)""")
def roles_interrupted_load(spark, sf_dir):
    """A load that fails while its second table is written, and a clean retry: ended roles are archived once."""
    store = TableStore(spark, f"{checkpoint_root(spark)}/roller-{uuid.uuid4().hex}")
    current, incoming = _role_sets(spark, sf_dir)
    store.publish("roller", current)

    def load(broken: bool) -> None:
        now, archive = R.reconcile_scd2(store.read("roller"), current.limit(0), incoming, AS_OF)
        if broken:
            archive = archive.withColumn("sist_sett", F.raise_error(F.lit("lost")).cast("date"))
        store.publish_together({"roller": now, "roller_historikk": archive})

    try:
        load(True)
    except Exception as error:
        if "lost" not in str(error):
            raise
    load(False)
    return store.read("roller_historikk").select("o_orderkey", "forst_sett", "sist_sett")


def _write_companies(spark, companies):
    """A company file of the columns that the stand-ins have."""
    path = f"{checkpoint_root(spark)}/fil-{uuid.uuid4().hex}"
    cells = [F.coalesce(F.col(name).cast("string") if name in companies.columns else F.lit(""), F.lit("")).alias(header) for header, name, _ in COMPANY_MAPPING]
    companies.select(*cells).write.csv(path, header=True, quote='"', escape='"', quoteAll=True, compression="gzip")
    return path


def _write_roles(spark, roles):
    """Role documents as arrays, one for each share of the companies."""
    path = f"{checkpoint_root(spark)}/fil-{uuid.uuid4().hex}"
    role = F.struct(F.struct(F.col("rolletype_kode").alias("kode")).alias("type"), F.col("rekkefolge"))
    group = F.struct(F.struct(F.lit("STYR").alias("kode")).alias("type"), F.collect_list(role).alias("roller"))
    documents = roles.groupBy(ORG).agg(F.to_json(F.struct(ORG, F.array(group).alias("rollegrupper"))).alias("d"))
    write_arrays(documents, roles, path, 8, "[", ",", "]")
    return path


def _loads(spark, sf_dir, roles=True):
    """The company and role jobs run twice, and a job that fails: the store and the run log."""
    root = f"{checkpoint_root(spark)}/last-{uuid.uuid4().hex}"
    store, runs = TableStore(spark, f"{root}/lager"), RunLog(spark, f"{root}/logg")
    companies = table(spark, sf_dir, "enheter")
    later = companies.filter(~F.col(ORG).endswith("9")).withColumn("navn", F.when(F.col(ORG).endswith("5"), F.concat("navn", F.lit(" ny"))).otherwise(F.col("navn")))
    numbered = table(spark, sf_dir, "roller").withColumn("rekkefolge", F.row_number().over(Window.partitionBy(ORG).orderBy("o_orderkey")))
    for number, (company_rows, role_rows) in enumerate([(companies, numbered), (later, numbered.filter("rekkefolge <= 2"))]):
        jobs.load_companies(store, runs, _write_companies(spark, company_rows), AS_OF + timedelta(days=number))
        if roles:
            jobs.load_roles(store, runs, _write_roles(spark, role_rows), AS_OF + timedelta(days=number))
    with suppress(ValueError), runs.run("feil"):
        raise ValueError("no such file")
    return store, runs


_RUNS = """tall AS (
  SELECT count(*) AS alle, count(*) FILTER (WHERE organisasjonsnummer NOT LIKE '%9') AS igjen, count(*) FILTER (WHERE organisasjonsnummer LIKE '%5') AS endret FROM enheter),
roller_nr AS (SELECT organisasjonsnummer, row_number() OVER (PARTITION BY organisasjonsnummer ORDER BY o_orderkey) AS nr FROM roller JOIN enheter USING (organisasjonsnummer)),
roller_tall AS (SELECT count(DISTINCT organisasjonsnummer) AS dokumenter, count(*) AS alle, count(*) FILTER (WHERE nr <= 2) AS igjen FROM roller_nr)"""


@check("run_log", tables="enheter roller", ctes=_RUNS, oracle="""
SELECT 'enheter' AS kilde, 1 AS nr, 'ok' AS status, alle AS lest, alle AS nye, 0 AS endret, 0 AS uendret, 0 AS slettet, '' AS feilmelding FROM tall
UNION ALL SELECT 'enheter', 2, 'ok', igjen, 0, endret, igjen - endret, 0, '' FROM tall
UNION ALL SELECT 'roller', 1, 'ok', dokumenter, alle, NULL, 0, 0, '' FROM roller_tall
UNION ALL SELECT 'roller', 2, 'ok', dokumenter, 0, NULL, igjen, alle - igjen, '' FROM roller_tall
UNION ALL SELECT 'feil', 1, 'feilet', NULL, NULL, NULL, NULL, NULL, 'no such file'""")
def run_log(spark, sf_dir):
    """Each run once, with what it counted while it wrote and how it ended."""
    rows = _loads(spark, sf_dir)[1].runs()
    number = F.row_number().over(Window.partitionBy("kilde").orderBy("startet_at")).alias("nr")
    counted = [F.col(f"rader_{c}").alias(c) for c in ("lest", "nye", "endret", "uendret", "slettet")]
    return rows.select("kilde", number, "status", *counted, F.coalesce("feilmelding", F.lit("")).alias("feilmelding"))


@check("load_counters", tables="enheter", oracle="""
SELECT CASE WHEN organisasjonsnummer LIKE '%9' THEN 'fravaerende' WHEN organisasjonsnummer LIKE '%5' THEN 'endret' ELSE 'uendret' END AS utfall, count(*) AS antall, any_value(n) AS lagret
FROM enheter, (SELECT count(*) AS n FROM enheter) GROUP BY 1""")
def load_counters(spark, sf_dir):
    """The stored rows by what the second load did to them, and the size that the manifest has of the table."""
    store, _ = _loads(spark, sf_dir, roles=False)
    return store.read("enheter").groupBy("utfall").agg(F.count(F.lit(1)).alias("antall")).withColumn("lagret", F.lit(store.size("enheter")))
