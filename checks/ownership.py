"""Holdings, the ownership graph and the industry tree."""

from pyspark.sql import functions as F

from checks.registry import HOLDINGS, check
from checks.standins import register, table
from fjordbook.functions import cleaning as C
from fjordbook.operators import graph as G
from fjordbook.operators import holdings as H
from fjordbook.operators import tree as T
from fjordbook.schema import ORG
from fjordbook.session import durable


def _holdings(spark, sf_dir):
    return H.classify_holders(table(spark, sf_dir, "aksjonar_raw"), F.col("aar"))


@check("holding_share", tables="aksjonar_raw", ctes=HOLDINGS, oracle="""
SELECT * EXCLUDE (andel), cast(andel AS DOUBLE) AS andel_prosent FROM aksjonar""")
def holding_share(spark, sf_dir):
    return _holdings(spark, sf_dir)


@check("public_holdings", tables="aksjonar_raw", ctes=HOLDINGS, oracle="""
SELECT regnskapsaar, organisasjonsnummer, selskap_navn, aksjeklasse, er_person, eier_orgnr,
       CASE WHEN er_person THEN NULL ELSE eier_navn END AS eier_navn, CASE WHEN er_person THEN NULL ELSE eier_landkode END AS eier_landkode,
       antall_aksjer, antall_aksjer_selskap, cast(andel AS DOUBLE) AS andel_prosent FROM aksjonar""")
def public_holdings(spark, sf_dir):
    return H.public_holdings(_holdings(spark, sf_dir))


@check("ownership_edges", tables="aksjonar_raw", ctes=HOLDINGS, oracle="""
SELECT eier_orgnr, organisasjonsnummer, ((2 * micro + 10000) // 20000) / 100.0 AS andel FROM shares""")
def ownership_edges(spark, sf_dir):
    return H.ownership_edges(_holdings(spark, sf_dir))


@check("subsidiaries", tables="enheter aksjonar_raw naeringskoder", ctes=HOLDINGS, oracle="""
, links AS (
  SELECT eier_orgnr AS mor, organisasjonsnummer, ((2 * micro + 10000) // 20000) / 100.0 AS andel FROM shares WHERE micro > 50000000
  UNION SELECT overordnet_enhet, organisasjonsnummer, NULL FROM enheter WHERE overordnet_enhet IS NOT NULL AND slettet_dato IS NULL),
kids AS (
  SELECT mor, e.organisasjonsnummer, e.navn, e.antall_ansatte, n.navn AS naering, max(andel) AS andel
  FROM links JOIN enheter e USING (organisasjonsnummer) LEFT JOIN naeringskoder n ON n.kode = e.naeringskode1_kode
  WHERE e.slettet_dato IS NULL GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY mor ORDER BY antall_ansatte DESC NULLS LAST, navn, organisasjonsnummer) AS nr,
                    count(*) OVER (PARTITION BY mor) AS antall FROM kids)
SELECT * FROM numbered""")
def subsidiaries(spark, sf_dir):
    r = register(spark, sf_dir)
    return H.subsidiaries(r.companies, r.holdings, r.industries).select(
        "mor", ORG, "navn", "antall_ansatte", "naering", "andel", "nr", "antall")


@check("holder_summary", tables="aksjonar_raw", ctes=HOLDINGS, oracle="""
SELECT organisasjonsnummer, count(*) AS antall_eiere, count(*) FILTER (WHERE er_person) AS antall_personeiere,
       count(*) - count(*) FILTER (WHERE er_person) AS antall_foretakseiere, count(*) FILTER (WHERE er_person) > 0 AS personer_skjult,
       least(count(*), 200) AS vist, count(*) > 200 AS avkortet
FROM aksjonar GROUP BY 1""")
def holder_summary(spark, sf_dir):
    return H.holder_summary(_holdings(spark, sf_dir), 200)


_TIES = "regnskapsaar NULLS LAST, eier_orgnr NULLS LAST, vist_navn NULLS LAST, aksjeklasse NULLS LAST, antall_aksjer NULLS LAST"


@check("largest_holders", tables="enheter aksjonar_raw", ctes=HOLDINGS, oracle=f"""
, shown AS (SELECT *, CASE WHEN er_person THEN NULL ELSE eier_navn END AS vist_navn FROM aksjonar),
ranked AS (SELECT *, row_number() OVER (PARTITION BY organisasjonsnummer ORDER BY andel DESC NULLS LAST, {_TIES}) AS nr FROM shown)
SELECT organisasjonsnummer, nr, eier_orgnr, vist_navn AS eier_navn, cast(andel AS DOUBLE) AS andel_prosent, e.navn AS eier_foretaksnavn
FROM ranked LEFT JOIN (SELECT organisasjonsnummer AS eier_orgnr, navn FROM enheter) e USING (eier_orgnr)""")
def largest_holders(spark, sf_dir):
    r = register(spark, sf_dir)
    return H.largest_holders(r.holdings, r.companies).select(
        ORG, "nr", "eier_orgnr", "eier_navn", "andel_prosent", "eier_foretaksnavn")


@check("largest_positions", tables="enheter aksjonar_raw", ctes=HOLDINGS, oracle="""
, ranked AS (SELECT *, row_number() OVER (PARTITION BY eier_orgnr ORDER BY andel DESC NULLS LAST, organisasjonsnummer, regnskapsaar, aksjeklasse, antall_aksjer) AS nr
             FROM aksjonar WHERE eier_orgnr IS NOT NULL)
SELECT eier_orgnr, nr, organisasjonsnummer, navn, antall_aksjer, cast(andel AS DOUBLE) AS andel_prosent
FROM ranked LEFT JOIN (SELECT organisasjonsnummer, navn FROM enheter) e USING (organisasjonsnummer)""")
def largest_positions(spark, sf_dir):
    r = register(spark, sf_dir)
    return H.largest_positions(r.holdings, r.companies).select(
        "eier_orgnr", "nr", ORG, "navn", "antall_aksjer", "andel_prosent")


@check("duplicate_holdings", tables="aksjonar_raw", ctes=HOLDINGS, oracle="""
SELECT regnskapsaar, organisasjonsnummer, aksjeklasse, eier_orgnr, eier_navn, eier_fodselsaar, eier_postnr, count(*) AS antall
FROM aksjonar GROUP BY ALL HAVING count(*) > 1""")
def duplicate_holdings(spark, sf_dir):
    return H.duplicate_holdings(_holdings(spark, sf_dir))


@check("degree_counts", tables="aksjonar_raw", ctes=HOLDINGS, oracle="""
SELECT node, cast(sum(a) AS BIGINT) AS eiere, cast(sum(b) AS BIGINT) AS eier_i FROM (
  SELECT organisasjonsnummer AS node, 1 AS a, 0 AS b FROM shares UNION ALL SELECT eier_orgnr, 0, 1 FROM shares) t GROUP BY 1""")
def degree_counts(spark, sf_dir):
    return H.degree_counts(H.ownership_edges(_holdings(spark, sf_dir)))


def _walk_sql(here: str, ahead: str) -> str:
    """Level by level from every company in the graph: a hop keeps one row per start and node."""
    levels = f"""{HOLDINGS},
kanter AS (SELECT eier_orgnr, organisasjonsnummer, ((2 * micro + 10000) // 20000) / 100.0 AS andel FROM shares),
h0 AS (SELECT DISTINCT {here} AS fra, {here} AS node, 100.0 AS andel FROM kanter)"""
    for i in (1, 2, 3):
        levels += f""",
h{i} AS (SELECT h.fra, k.{ahead} AS node, max(k.andel) AS andel FROM (SELECT fra, node FROM h{i - 1}) h JOIN kanter k ON k.{here} = h.node GROUP BY 1, 2)"""
    reached = " UNION ALL ".join(f"SELECT *, {i} AS niva FROM h{i}" for i in range(4))
    return f"""{levels},
noder AS (SELECT fra, node, min(niva) AS niva, max(andel) AS andel FROM ({reached}) r GROUP BY 1, 2),
valgt AS MATERIALIZED (SELECT * FROM noder)"""


_SHOWN = """, vist AS MATERIALIZED (SELECT * FROM valgt QUALIFY row_number() OVER (PARTITION BY fra ORDER BY niva, andel DESC NULLS LAST, node) <= 120)"""


_UP = _walk_sql("organisasjonsnummer", "eier_orgnr")
_DOWN = _walk_sql("eier_orgnr", "organisasjonsnummer")


def _edges(spark, sf_dir):
    return durable(H.ownership_edges(_holdings(spark, sf_dir)))


_NODES = "SELECT fra, node, niva, cast(andel AS DOUBLE) AS andel FROM valgt WHERE niva > 0"


@check("network_up", tables="aksjonar_raw", ctes=_UP, oracle=_NODES)
def network_up(spark, sf_dir):
    """From every company that has owners."""
    return G.reach(_edges(spark, sf_dir), direction="opp")


@check("network_down", tables="aksjonar_raw", ctes=_DOWN, oracle=_NODES)
def network_down(spark, sf_dir):
    """From every company that owns others."""
    return G.reach(_edges(spark, sf_dir), direction="ned")


@check("induced_edges", tables="aksjonar_raw", ctes=_UP, oracle="""
SELECT b.fra, k.eier_orgnr, k.organisasjonsnummer, cast(k.andel AS DOUBLE) AS andel
FROM valgt b JOIN kanter k ON b.node = k.organisasjonsnummer WHERE (b.fra, k.eier_orgnr) IN (SELECT fra, node FROM valgt)""")
def induced_edges(spark, sf_dir):
    return G.walk(H.ownership_edges(_holdings(spark, sf_dir)))[1]


@check("network_list", tables="aksjonar_raw enheter", ctes=_UP, oracle=_SHOWN + """
, liste AS (
  SELECT v.fra, v.node, v.niva, cast(v.andel AS DOUBLE) AS andel, e.navn, nullif(e.antall_ansatte, 0) AS ansatte,
         count(*) OVER (PARTITION BY v.fra) >= 119 AS avkortet,
         row_number() OVER (PARTITION BY v.fra ORDER BY v.niva, e.antall_ansatte DESC NULLS LAST, e.navn NULLS LAST, v.node) AS nr
  FROM vist v LEFT JOIN enheter e ON e.organisasjonsnummer = v.node WHERE v.niva > 0),
kant AS (SELECT a.fra, a.node, string_agg(k.eier_orgnr || '>' || k.organisasjonsnummer || '=' || cast(cast(k.andel AS DOUBLE) AS VARCHAR), ' ' ORDER BY k.organisasjonsnummer) AS kanter
         FROM kanter k JOIN vist a ON a.node = k.eier_orgnr JOIN vist b ON b.node = k.organisasjonsnummer AND b.fra = a.fra GROUP BY 1, 2)
SELECT liste.*, coalesce(kanter, '') AS kanter FROM liste LEFT JOIN kant USING (fra, node)""")
def network_list(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    shown = G.network(G.reach(edges), edges, table(spark, sf_dir, "enheter"), 120)
    edge = F.from_json("kanter", "array<struct<eier:string,selskap:string,andel:double>>")
    told = F.array_join(F.transform(edge, lambda e: F.concat(e["eier"], F.lit(">"), e["selskap"], F.lit("="), e["andel"].cast("string"))), " ")
    return shown.select("fra", "node", "niva", "andel", "navn", "ansatte", "avkortet", "nr", told.alias("kanter"))


@check("nodes_by_depth", tables="aksjonar_raw", ctes=_DOWN, oracle="""
SELECT fra, niva, string_agg(node, ',' ORDER BY andel DESC, node) AS noder FROM valgt WHERE niva > 0 GROUP BY 1, 2""")
def nodes_by_depth(spark, sf_dir):
    nodes = G.reach(_edges(spark, sf_dir), direction="ned", together=True)
    return G.nodes_by_depth(nodes).withColumn("noder", F.array_join("noder", ","))


CLOSURE = """closure AS (
  WITH RECURSIVE c AS (SELECT kode AS etterkommer, kode AS forfader, 0 AS avstand FROM naeringskoder
    UNION ALL SELECT c.etterkommer, n.parent_kode, avstand + 1 FROM c JOIN naeringskoder n ON n.kode = c.forfader WHERE n.parent_kode IS NOT NULL)
  SELECT * FROM c)"""


def _tree(spark, sf_dir):
    return table(spark, sf_dir, "naeringskoder")


@check("tree_closure", tables="naeringskoder", ctes=CLOSURE, oracle="SELECT forfader, etterkommer, avstand FROM closure")
def tree_closure(spark, sf_dir):
    return T.tree_closure(_tree(spark, sf_dir))


@check("tree_leaves", tables="naeringskoder", ctes=CLOSURE, oracle="""
SELECT DISTINCT etterkommer AS kode FROM closure JOIN naeringskoder n ON n.kode = etterkommer
WHERE forfader IN ('M', 'F.3', 'B.1.11') AND niva = 5""")
def tree_leaves(spark, sf_dir):
    return T.expand_to_leaves(_tree(spark, sf_dir), ["M", "F.3", "B.1.11"])


@check("tree_rollup", tables="enheter naeringskoder", ctes=CLOSURE, oracle="""
SELECT n.kode, n.navn, n.niva, n.parent_kode, coalesce(s.antall, 0) AS antall
FROM naeringskoder n LEFT JOIN (
  SELECT forfader AS kode, count(*) AS antall FROM closure JOIN enheter e ON e.naeringskode1_kode = etterkommer
  WHERE e.slettet_dato IS NULL GROUP BY 1) s USING (kode) WHERE n.niva <= 4""")
def tree_rollup(spark, sf_dir):
    return T.rollup(_tree(spark, sf_dir), table(spark, sf_dir, "enheter"))


@check("tree_ancestors", tables="naeringskoder", ctes=CLOSURE, oracle="""
SELECT forfader AS kode, min(avstand) AS avstand FROM closure JOIN naeringskoder n ON n.kode = etterkommer
WHERE lower(n.kode) LIKE '.2.%' OR contains(lower(n.navn), '.2.12') GROUP BY 1""")
def tree_ancestors(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    return T.ancestors_of(tree, T.matching_nodes(tree, ".2.12"))


@check("tree_redundant", tables="naeringskoder", ctes=CLOSURE, oracle="""
, ticked AS (SELECT kode FROM naeringskoder WHERE kode LIKE 'A%')
SELECT kode FROM ticked t WHERE NOT EXISTS (
  SELECT 1 FROM closure c JOIN ticked o ON o.kode = c.forfader WHERE c.etterkommer = t.kode AND c.avstand > 0)""")
def tree_redundant(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    return T.without_redundant(tree, tree.filter(F.col("kode").startswith("A")).select("kode"))


@check("holder_addresses", tables="aksjonar_raw", oracle="""
SELECT orgnr, postnr_sted, CASE WHEN regexp_matches(postnr_sted, '^[0-9]{4}\\s') THEN substr(postnr_sted, 1, 4) END AS postnr,
       CASE WHEN regexp_matches(postnr_sted, '^[0-9]{4}\\s') THEN substr(postnr_sted, 6) END AS poststed
FROM aksjonar_raw""")
def holder_addresses(spark, sf_dir):
    address = F.trim("postnr_sted")
    return table(spark, sf_dir, "aksjonar_raw").select(
        "orgnr", "postnr_sted", C.post_code(address).alias("postnr"), C.post_place(address).alias("poststed"))
