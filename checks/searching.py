"""Search: filters, sorts, pages, counts, filter specs."""

from pyspark.sql import functions as F

from checks.registry import LATEST, check
from checks.standins import AS_OF, load, register
from fjordbook.operators import keyed as K
from fjordbook.operators import search as S
from fjordbook.operators import spec as P
from fjordbook.operators.search import SearchSpec
from fjordbook.schema import ORG

DAY = f"DATE '{AS_OF}'"
_SHOWN = [ORG, "navn", "organisasjonsform_kode", "antall_ansatte", "konkurs"]
_SHOWN_SQL = "organisasjonsnummer, navn, organisasjonsform_kode, antall_ansatte, konkurs"


def _search(spark, sf_dir, spec):
    r = register(spark, sf_dir)
    latest = r.latest if spec.needs_accounts else None
    return S.search(r.companies, spec, AS_OF, latest, r.municipalities, r.counties, r.industries)


def _searched(name, spec, condition, tables="enheter", ctes="", joins=""):
    """A search over all companies, checked as a set."""
    @check(name, tables=tables, ctes=ctes, oracle=f"SELECT {_SHOWN_SQL} FROM enheter e {joins} WHERE e.slettet_dato IS NULL AND {condition}")
    def query(spark, sf_dir):
        return _search(spark, sf_dir, spec).select(*_SHOWN)
    return query


_searched("search_name", SearchSpec(q="mer#00000001"), "navn ILIKE '%mer#00000001%'")
_searched("search_key", SearchSpec(q="000000042"), "organisasjonsnummer = '000000042'")
_searched("search_all", SearchSpec(), "true")
_searched("search_municipality", SearchSpec(kommune="0312"), "forretningsadresse_kommunenummer = '0312'")
_searched("search_municipality_prefix", SearchSpec(kommune="03"), "forretningsadresse_kommunenummer LIKE '03%'")
_searched("search_municipality_name", SearchSpec(kommune="tion_1"),
          "forretningsadresse_kommunenummer IN (SELECT kommunenummer FROM kommuner WHERE navn ILIKE '%tion_1%')", tables="enheter kommuner")
_searched("search_county", SearchSpec(fylke="2"), "substr(forretningsadresse_kommunenummer, 1, 2) = '02'")
_searched("search_county_name", SearchSpec(fylke="asi"),
          "forretningsadresse_kommunenummer IN (SELECT kommunenummer FROM kommuner JOIN fylker f USING (fylkesnummer) WHERE f.navn ILIKE '%asi%')",
          tables="enheter kommuner fylker")
_searched("search_industry", SearchSpec(nace=["M", "F.3"]), "(naeringskode1_kode LIKE 'M.%' OR naeringskode1_kode LIKE 'F.3.%')")
_searched("search_form_and_size", SearchSpec(orgform="MACH", ansatte=20, ansatte_maks=120),
          "organisasjonsform_kode = 'MACH' AND antall_ansatte BETWEEN 20 AND 120")
_searched("search_status_any", SearchSpec(konkurs=True, nye=True), f"(konkurs OR registreringsdato_enhetsregisteret >= {DAY} - 90)")
_searched("search_liquidating", SearchSpec(avvikling=True), "(under_avvikling OR under_tvangsavvikling)")
_searched("search_active", SearchSpec(aktive=True), "NOT konkurs AND NOT under_avvikling AND NOT under_tvangsavvikling")
_searched("search_amounts", SearchSpec(belop={"omsetning": S.in_kroner((20_000, 60_000)), "resultat": S.in_kroner((0, None))}),
          "rimelig AND sum_driftsinntekter BETWEEN 20000000 AND 60000000 AND aarsresultat >= 0",
          tables="enheter regnskap", ctes=LATEST, joins="JOIN latest USING (organisasjonsnummer)")
_searched("search_keywords", SearchSpec(gjor='"trading and servicing" goods -machinery'),
          "contains(lower(aktivitet), 'trading and servicing') AND organisasjonsform_kode <> 'MACH'")
_searched("search_keywords_or", SearchSpec(gjor="household stations or furniture goods"),
          "((organisasjonsform_kode = 'HOUS' AND vedtektsfestet_formaal IS NOT NULL) OR (organisasjonsform_kode = 'FURN' AND aktivitet IS NOT NULL))")


@check("search_exact_count", tables="enheter", oracle="""
SELECT count(*) AS antall FROM enheter WHERE slettet_dato IS NULL AND NOT konkurs AND NOT under_avvikling AND NOT under_tvangsavvikling""")
def exact_count(spark, sf_dir):
    return _search(spark, sf_dir, SearchSpec(aktive=True)).agg(F.count(F.lit(1)).alias("antall"))


@check("search_capped_count", tables="enheter", oracle="""
SELECT least(count(*), 1000) AS antall, count(*) > 1000 AS flere FROM enheter WHERE slettet_dato IS NULL""")
def capped_count(spark, sf_dir):
    return K.capped_count(_search(spark, sf_dir, SearchSpec()), 1000)


def _paged(name, sort, order, size, number):
    """A page plus its probe row; an accounts sort also limits the list to plausible accounts."""
    spec = SearchSpec(sorter=sort)
    joins = "JOIN latest USING (organisasjonsnummer)" if spec.needs_accounts else ""
    extra = "AND rimelig" if spec.needs_accounts else ""
    @check(name, tables="enheter regnskap", ctes=LATEST, oracle=f"""
SELECT {_SHOWN_SQL} FROM enheter {joins} WHERE slettet_dato IS NULL {extra}
ORDER BY {order} organisasjonsnummer LIMIT {size + 1} OFFSET {size * (number - 1)}""")
    def query(spark, sf_dir):
        return K.page(_search(spark, sf_dir, spec), S.sort_order(sort), size, number).select(*_SHOWN)
    return query


_paged("search_page", "ansatte", "antall_ansatte DESC NULLS LAST, navn,", 25, 3)
_paged("search_page_by_name", "navn", "navn,", 10, 7)
_paged("search_page_newest", "nyest", "registreringsdato_enhetsregisteret DESC NULLS LAST, navn,", 10, 2)
_paged("search_page_oldest", "eldst", "stiftelsesdato ASC NULLS LAST, navn,", 10, 2)
_paged("search_page_revenue", "omsetning", "sum_driftsinntekter DESC NULLS LAST, navn,", 20, 2)
_paged("search_page_result", "resultat", "aarsresultat DESC NULLS LAST, navn,", 20, 1)


@check("search_semantic", tables="enheter", oracle="""
, punkt AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
midt AS (SELECT i, avg(x) AS m FROM punkt GROUP BY 1),
naer AS (SELECT lpad(cast(vec_id AS VARCHAR), 9, '0') AS organisasjonsnummer, round(1 - sum(x * m) / sqrt(sum(x * x)) / sqrt(sum(m * m)), 6) AS avstand
         FROM punkt JOIN midt USING (i) GROUP BY vec_id)
SELECT organisasjonsnummer, navn, avstand, left(coalesce(aktivitet, vedtektsfestet_formaal), 160) AS utdrag
FROM enheter JOIN naer USING (organisasjonsnummer)
WHERE slettet_dato IS NULL AND NOT konkurs AND NOT under_avvikling AND NOT under_tvangsavvikling AND avstand < 1
ORDER BY avstand, navn LIMIT 26""")
def semantic(spark, sf_dir):
    """Active companies near the middle of all vectors; a vector's id is its company's key. Another model's vectors, turned round, are not compared."""
    stored = load(spark, sf_dir, "embeddings")
    points = stored.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    middle = points.select(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda e: e["m"])).scalar()
    key = F.lpad(F.col("vec_id").cast("string"), 9, "0").alias(ORG)
    vectors = stored.select(key, "embedding", F.lit("a").alias("modell"))
    other = stored.select(key, F.transform("embedding", lambda x: -x).alias("embedding"), F.lit("b").alias("modell"))
    found = S.semantic(_search(spark, sf_dir, SearchSpec(aktive=True)), vectors.unionByName(other), middle, 1.0, "a")
    found = found.withColumn("avstand", F.round("avstand", 6))
    return K.page(found, S.sort_order("relevans"), 25).select(ORG, "navn", "avstand", "utdrag")


@check("place_picker", tables="kommuner", oracle="""
SELECT kommunenummer, navn, fylkesnummer FROM kommuner WHERE fylkesnummer = '02' AND (contains(lower(navn), 'n_1') OR kommunenummer LIKE 'n_1%')""")
def place_picker(spark, sf_dir):
    return S.pick_places(register(spark, sf_dir).municipalities, "n_1", "02").select("kommunenummer", "navn", "fylkesnummer")


SPEC_SQL = """newest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY organisasjonsnummer ORDER BY periode_til DESC, regnskapstype DESC) AS r FROM regnskap) t WHERE r = 1),
rader AS (
  SELECT e.*, k.navn AS kommune, f.navn AS fylke, n.navn AS naering, s.sum_driftsinntekter, s.aarsresultat, s.periode_til
  FROM enheter e LEFT JOIN kommuner k ON k.kommunenummer = e.forretningsadresse_kommunenummer
  LEFT JOIN fylker f ON f.fylkesnummer = k.fylkesnummer LEFT JOIN naeringskoder n ON n.kode = e.naeringskode1_kode
  LEFT JOIN newest s ON s.organisasjonsnummer = e.organisasjonsnummer)"""


def _spec(name, spec, condition, order, limit):
    @check(name, tables="enheter regnskap kommuner fylker naeringskoder", ctes=SPEC_SQL, oracle=f"""
SELECT organisasjonsnummer, navn, organisasjonsform_kode, antall_ansatte, har_registrert_antall_ansatte, forretningsadresse_poststed, kommune, fylke,
       naeringskode1_kode, naering, konkurs, under_avvikling, cast(kapital_belop AS DOUBLE) AS kapital_belop,
       cast(sum_driftsinntekter AS DOUBLE) AS sum_driftsinntekter, cast(aarsresultat AS DOUBLE) AS aarsresultat,
       cast(periode_til AS VARCHAR) AS regnskapsaar, count(*) OVER () AS totalt
FROM rader WHERE slettet_dato IS NULL AND {condition} ORDER BY rader.{order} NULLS LAST, organisasjonsnummer LIMIT {limit}""")
    def query(spark, sf_dir):
        r = register(spark, sf_dir)
        rows = P.spec_rows(r.companies, r.municipalities, r.counties, r.industries, r.accounts)
        return P.run_spec(rows, spec)
    return query


_spec("spec_filter", {"filtre": [
    {"felt": "fylke", "op": "er", "verdi": "ASIA"}, {"felt": "ansatte", "op": "minst", "verdi": "10"},
    {"felt": "driftsinntekter", "op": "mellom", "verdi": [10_000_000, 80_000_000]}], "sorter": "driftsinntekter", "grense": 40},
    "(fylke ILIKE 'ASIA' OR fylke ILIKE 'ASIA - %') AND antall_ansatte >= 10 AND sum_driftsinntekter BETWEEN 10000000 AND 80000000",
    "sum_driftsinntekter DESC", 40)
_spec("spec_text_ops", {"filtre": [
    {"felt": "naeringskode", "op": "starter_med", "verdi": "M."}, {"felt": "kommune", "op": "inneholder", "verdi": "nation"},
    {"felt": "konkurs", "op": "er", "verdi": False}], "sorter": "stiftet", "retning": "asc"},
    "naeringskode1_kode LIKE 'M.%' AND kommune ILIKE '%nation%' AND NOT konkurs", "stiftelsesdato ASC", 25)
_spec("spec_founded_year", {"filtre": [
    {"felt": "stiftet_aar", "op": "mellom", "verdi": [1950, 1980]}, {"felt": "aksjekapital", "op": "hoyst", "verdi": 5e6},
    {"felt": "organisasjonsform", "op": "er", "verdi": "mach"}], "sorter": "aksjekapital", "grense": 500},
    "year(stiftelsesdato) BETWEEN 1950 AND 1980 AND kapital_belop <= 5000000 AND organisasjonsform_kode ILIKE 'mach'", "kapital_belop DESC", 500)


_REPLIES = """replies AS (
  SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN concat('No idea about ', c_name)
    ELSE concat('Sure: {"filtre": [{"felt": "', CASE WHEN c_mktsegment = 'BUILDING' THEN 'alder' ELSE 'ansatte' END,
                '", "op": "minst", "verdi": "', cast(c_nationkey AS string), '"}], "grense": 10} - done') END AS text
  FROM {customer})"""


def _replies(spark, sf_dir):
    return spark.sql("WITH " + _REPLIES.replace('{"', '{{"').replace('"}', '"}}').replace("10}", "10}}")
                     + " SELECT * FROM replies", customer=load(spark, sf_dir, "customer"))


@check("spec_from_text", oracle="""
SELECT c_custkey, 'ansatte' AS felt, cast(c_nationkey AS VARCHAR) AS verdi, 10 AS grense
FROM customer WHERE c_acctbal >= 0 AND c_mktsegment <> 'BUILDING'""")
def spec_from_text(spark, sf_dir):
    specs, _ = P.parse_specs(_replies(spark, sf_dir))
    first = F.col("spec.filtre")[0]
    return specs.select("c_custkey", first["felt"].alias("felt"), first["verdi"].alias("verdi"), F.col("spec.grense").alias("grense"))


@check("spec_rejects", oracle="""
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'ingen spesifikasjon' ELSE 'ukjent felt eller operator' END AS grunn
FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING'""")
def spec_rejects(spark, sf_dir):
    return P.parse_specs(_replies(spark, sf_dir))[1].select("c_custkey", "grunn")
