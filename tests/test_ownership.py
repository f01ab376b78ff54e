import json
import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fjordbook.operators import graph as G
from fjordbook.operators import holdings as H
from fjordbook.operators import tree as T
from fjordbook.operators.keyed import first_per_key, top_per_key
from fjordbook.schema import ORG

RAW = "orgnr string, selskap string, aksjeklasse string, eier_navn string, fodselsaar_orgnr string, postnr_sted string, landkode string, antall_aksjer string, antall_aksjer_selskap string"


def raw(spark, *records):
    return spark.createDataFrame(list(records), RAW)


def test_holders_are_classified_and_masked(spark):
    frame = H.classify_holders(raw(
        spark,
        ("1", "A AS", "A", "Ola", "1970", "4020 STAVANGER", "NOR", "1", "3"),
        ("1", "A AS", "A", "Eier AS", "000000002", "LONDON", "GBR", "2", "3"),
        ("1", "A AS", "A", "Ukjent", "", "", "", "x", "0"),
        (" ", "B", "A", "C", "", "", "", "1", "1"),
    ), 2023)
    got = {r.eier_navn: r for r in frame.collect()}
    assert set(got) == {"Ola", "Eier AS", "Ukjent"} and got["Ola"][ORG] == "000000001"
    assert (got["Ola"].er_person, got["Ola"].eier_fodselsaar, got["Ola"].eier_orgnr, got["Ola"].eier_poststed) == (True, 1970, None, "STAVANGER")
    assert (got["Eier AS"].er_person, got["Eier AS"].eier_orgnr, got["Eier AS"].eier_postnr) == (False, "000000002", None)
    assert (got["Ukjent"].er_person, got["Ukjent"].antall_aksjer, got["Ukjent"].andel_prosent) == (None, None, None)
    assert got["Ola"].andel_prosent == Decimal("33.333333")
    assert sorted(map(str, (r.eier_navn for r in H.public_holdings(frame).collect()))) == ["Eier AS", "None", "Ukjent"]
    assert sorted(map(str, (r.eier_navn for r in H.public_holdings(frame, strict=True).collect()))) == ["Eier AS", "None", "None"]


def test_share_classes_add_up_and_duplicates_stay(spark):
    holding = ("1", "A", "A", "E", "000000002", "", "", "30", "100")
    frame = H.classify_holders(raw(spark, holding, holding[:2] + ("B",) + holding[3:]), 2023)
    old = frame.withColumn("regnskapsaar", F.lit(2022).cast("smallint"))
    both = frame.unionByName(old)
    assert [(r.eier_orgnr, r.andel) for r in H.ownership_edges(both).collect()] == [("000000002", Decimal("60.00"))]
    assert H.subsidiary_counts(both).first().datterselskap == 1
    same = H.classify_holders(raw(spark, holding, holding), 2023)
    assert same.count() == 2 and H.duplicate_holdings(same).first().antall == 2


def edges_frame(spark, pairs):
    return spark.createDataFrame([(a, b, Decimal(s)) for a, b, s in pairs], f"eier_orgnr string, {ORG} string, andel decimal(20,2)")


def brute_walk(pairs, seed, direction, depth):
    """All steps, level by level: smallest depth and largest share of each node."""
    level, best = {seed}, {seed: (0, 100)}
    for d in range(1, depth + 1):
        nxt = set()
        for owner, company, share in pairs:
            here, ahead = (company, owner) if direction == "opp" else (owner, company)
            if here in level:
                nxt.add(ahead)
                old = best.get(ahead, (d, share))
                best[ahead] = (min(old[0], d), max(old[1], share))
        level = nxt
    return best


@pytest.mark.parametrize("direction", ["opp", "ned"])
def test_walk_matches_brute_force_with_cycles(spark, direction):
    rng = random.Random(1)
    nodes = [f"n{i:02d}" for i in range(30)]
    pairs = sorted({(a, b): s for a, b, s in ((rng.choice(nodes), rng.choice(nodes), rng.randint(1, 99)) for _ in range(60)) if a != b}.items())
    pairs = [(a, b, s) for (a, b), s in pairs] + [("n00", "n01", 55), ("n01", "n00", 44)]
    pairs = list({(a, b): (a, b, s) for a, b, s in pairs}.values())
    edges = edges_frame(spark, pairs)
    seeds = spark.createDataFrame([(n,) for n in nodes], f"{ORG} string")
    got_nodes, got_edges = G.walk(edges, seeds, direction, 3)
    near_nodes, near_edges = G.nearest(got_nodes, got_edges, 12)
    found = defaultdict(dict)
    for r in got_nodes.collect():
        found[r.fra][r.node] = (r.niva, r.andel)
    for seed in nodes:
        best = brute_walk(pairs, seed, direction, 3)
        assert found[seed] == {n: v for n, v in best.items() if v[0] > 0}
        chosen = {n for n, _ in sorted(best.items(), key=lambda i: (i[1][0], -i[1][1], i[0]))[:12]}
        if seed in ("n00", "n07"):
            assert {r.node for r in near_nodes.filter(F.col("fra") == seed).collect()} == chosen - {seed}
            for got, inside in ((got_edges, set(best)), (near_edges, chosen)):
                induced = {(r.eier_orgnr, r[ORG]) for r in got.filter(F.col("fra") == seed).collect()}
                assert induced == {(a, b) for a, b, _ in pairs if a in inside and b in inside}
    for depth in (0, 5):
        with pytest.raises(ValueError):
            G.walk(edges, seeds, direction, depth)


def test_network_lists_nodes_with_their_edges(spark):
    edges = edges_frame(spark, [("a", "b", 60), ("b", "c", 70), ("a", "c", 10)])
    nodes, induced = G.walk(edges, spark.createDataFrame([("c",)], f"{ORG} string"), "opp")
    companies = spark.createDataFrame([("a", "Alfa", 5), ("b", "Beta", 0)], f"{ORG} string, navn string, antall_ansatte int").withColumns(
        {"organisasjonsform_kode": F.lit("AS"), "konkurs": F.lit(False), "under_avvikling": F.lit(False), "forretningsadresse_poststed": F.lit("X")})
    got = {r.node: r for r in G.network(nodes, induced, companies, 120).collect()}
    assert [got[n].nr for n in "ab"] == [1, 2] and got["b"].ansatte is None and not got["a"].avkortet
    assert {(k["eier"], k["selskap"]) for k in json.loads(got["a"].kanter)} == {("a", "b"), ("a", "c")}
    assert got["a"].niva == 1 and got["a"].andel == 60
    by_depth = {(r.fra, r.niva): r.noder for r in G.nodes_by_depth(nodes).collect()}
    assert by_depth == {("c", 1): ["b", "a"]}


def test_shown_edges_are_taken_from_the_whole_graph(spark, rows):
    edges = edges_frame(spark, [("a", "b", 60), ("b", "c", 70), ("a", "c", 10), ("d", "a", 5), ("c", "a", 9)])
    nodes, induced = G.walk(edges, spark.createDataFrame([("c",), ("a",)], f"{ORG} string"), "opp")
    for k in (2, 3, 120):
        assert rows(G.nearest(nodes, edges, k)[1]) == rows(G.nearest(nodes, induced, k)[1]) != []


def test_a_walk_hops_over_nodes_that_are_led_to_and_groups_bounded_parts(spark, monkeypatch):
    """Later hops read only steps of nodes that a step leads to; parts of the last grouping follow the rows, however well these pack."""
    from fjordbook import session
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    edges = edges_frame(spark, [(f"o{i % 3}", f"c{i:03d}", 10 + i % 7) for i in range(300)] + [("p", "o0", 50), ("q", "p", 60), ("o0", "o0", 5)])
    assert {r.node for r in G._inner(G._steps(edges, "opp")).collect()} == {"o0", "p"}
    nodes = G.reach(edges)
    assert nodes.rdd.getNumPartitions() >= 50
    assert sorted((r.node, r.niva, r.andel) for r in nodes.filter("fra = 'c003'").collect()) == [("o0", 1, 13), ("p", 2, 50), ("q", 3, 60)]
    assert nodes.count() == 300 + 100 * 2 + 2 + 1
    assert sorted(map(tuple, G.walk(edges)[0].collect())) == sorted(map(tuple, nodes.collect()))
    assert G.walk(edges, depth=1)[0].count() == 302


def test_an_edge_without_an_end_is_no_edge_of_a_walk(spark):
    edges = spark.createDataFrame([(None, "c", Decimal(5)), ("o", "c", Decimal(7))], f"eier_orgnr string, {ORG} string, andel decimal(20,2)")
    assert [(r.fra, r.eier_orgnr, r[ORG]) for r in G.walk(edges)[1].collect()] == [("c", "o", "c")]


@pytest.fixture
def tree(spark):
    nodes = [("A", None, 1), ("01", "A", 2), ("01.1", "01", 3), ("01.11", "01.1", 4), ("01.111", "01.11", 5), ("01.112", "01.11", 5),
             ("B", None, 1), ("05", "B", 2), ("05.1", "05", 3), ("05.10", "05.1", 4), ("05.101", "05.10", 5)]
    return spark.createDataFrame([(k, f"Navn {k}", n, p) for k, p, n in nodes], "kode string, navn string, niva int, parent_kode string")


def codes(df):
    return sorted(r.kode for r in df.collect())


def test_tree_operations(spark, tree):
    assert codes(T.expand_to_leaves(tree, ["A"])) == ["01.111", "01.112"]
    assert codes(T.expand_to_leaves(tree, ["01.111", "B", "05"])) == ["01.111", "05.101"]
    chosen = spark.createDataFrame([("A",), ("01.1",), ("05",)], "kode string")
    assert codes(T.expand_to_leaves(tree, chosen)) == ["01.111", "01.112", "05.101"]
    assert codes(T.without_redundant(tree, chosen)) == ["05", "A"]
    assert codes(T.ancestors_of(tree, T.matching_nodes(tree, "01.111"))) == ["01", "01.1", "01.11", "01.111", "A"]
    companies = spark.createDataFrame([("01.111", None), ("01.111", None), ("01.112", None), ("01.112", "x"), (None, None)], "naeringskode1_kode string, slettet_dato string")
    counts = {r.kode: r.antall for r in T.rollup(tree, companies).collect()}
    assert counts["A"] == counts["01.11"] == 3 and counts["B"] == counts["05.10"] == 0 and "01.111" not in counts


def test_closure_of_any_depth(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None) for i in range(7)], "kode string, parent_kode string")
    got = {(r.forfader, r.etterkommer, r.avstand) for r in T.tree_closure(chain).collect()}
    assert got == {(f"n{a}", f"n{b}", b - a) for b in range(7) for a in range(b + 1)}
    with pytest.raises(ValueError):
        T.tree_closure(spark.createDataFrame([("a", "b"), ("b", "a")], "kode string, parent_kode string"))


def test_top_rows_of_a_hot_key(spark):
    rng = random.Random(2)
    data = [("hot" if i % 3 == 0 else f"k{i % 50}", rng.randint(0, 300), i) for i in range(6000)]
    frame = spark.createDataFrame(data, "k string, v int, id int").repartition(8)
    order = [F.desc("v"), F.asc("id")]
    expected = sorted(sorted(((v, i) for k, v, i in data if k == "hot"), key=lambda x: (-x[0], x[1]))[:150])
    got = top_per_key(frame, ["k"], order, 150, rank="nr").filter("k = 'hot'")
    assert sorted((r.v, r.id) for r in got.collect()) == expected and got.agg(F.max("nr")).first()[0] == 150
    assert top_per_key(frame, ["k"], order, rank="nr").filter("k = 'hot'").agg(F.max("nr")).first()[0] == 2000


def test_limits_reach_the_map_side(spark):
    frame = spark.range(1000).selectExpr("id % 3 as k", "id as v").repartition(4)
    plan = first_per_key(frame, ["k"], F.desc("v"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_shares_are_added_up_in_parts_of_bounded_rows(spark, monkeypatch):
    """Parts follow the number of rows, not the bytes they pack to, and nothing is added up before they are dealt."""
    from fjordbook import session
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    held = spark.range(300).selectExpr("cast(2024 as smallint) regnskapsaar", "cast(id % 50 as string) eier_orgnr", "cast(id % 30 as string) organisasjonsnummer", "cast(1 as decimal(20,6)) andel_prosent")
    shares = H.owner_shares(held)
    assert shares.rdd.getNumPartitions() == 30
    assert sum(r.andel for r in shares.collect()) == 300
