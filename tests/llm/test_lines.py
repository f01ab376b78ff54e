import duckdb
from pyspark.sql import functions as F

from fjordbook.llm import lines as L


def by_hand(rows, ratio=L.RATIO, least=L.LEAST_PAGES):
    totals, seen = {}, {}
    cut = lambda t: [] if t is None else t.split("\n")
    for _, text, host in rows:
        totals[host] = totals.get(host, 0) + 1
        for line in {x.strip(" \t\r") for x in cut(text)} - {""}:
            seen[host, line] = seen.get((host, line), 0) + 1
    out = []
    for key, text, host in rows:
        keep = [x for x in cut(text) if not x.strip(" \t\r") or seen[host, x.strip(" \t\r")] < least or seen[host, x.strip(" \t\r")] <= ratio * totals[host]]
        n = sum(bool(x.strip(" \t\r")) for x in cut(text))
        out.append((key, None if text is None else "\n".join(keep), n, n - sum(bool(x.strip(" \t\r")) for x in keep)))
    return sorted(out, key=repr)


def test_site_relative_frequency(documents):
    rows = [(i, f"own {i}\n\nMenu\t\nshared by few {i % 30}\nmenu", "big") for i in range(60)]
    rows += [(100 + i, f"Menu\nother {i}" if i < 3 else f"other {i}", "small") for i in range(40)]
    rows += [(200 + i, "Menu\r\nMenu", None) for i in range(5)] + [(300, None, "big"), (301, "", "big"), (301, "", "big")]
    got = L.without_boilerplate(documents(rows), F.col("source")).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got), key=repr) == by_hand(rows)
    assert {r.n_removed for r in got if r.doc_id < 60} == {2} and {r.n_removed for r in got if 100 <= r.doc_id < 200} == {0}


def test_edges(edges, none):
    got = L.without_boilerplate(edges, F.col("source"), ratio=0.3, least_pages=2)
    rows = [(r.doc_id, r.text, r.source) for r in edges.collect()]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=repr) == by_hand(rows, 0.3, 2)
    assert set(got.columns) == set(edges.columns) | {"n_removed"}
    assert L.without_boilerplate(none, F.col("source")).count() == 0


def test_plan_is_native(documents):
    plan = L.without_boilerplate(documents([(1, "a\nb")]), F.col("source"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_oracle_sees_the_same_edges(edges):
    c = duckdb.connect()
    documents = edges.select("doc_id", "text", "source").toPandas()
    c.register("documents", documents)
    expected = sorted((tuple(None if x != x else x for x in r) for r in c.execute(L.ORACLE).df()[["doc_id", "text", "n_lines", "n_removed"]].astype(object).itertuples(index=False)), key=repr)
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in L.without_boilerplate(edges, F.col("source")).collect()), key=repr)
    assert [(e[1], e[2], e[3]) for e in expected] == [(g[1], g[2], g[3]) for g in got]


def test_hosts(spark):
    urls = ["http://A.b.c:80/x", "https://u:p@h.de?q", "ftp://x#y", "nothing", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(L.host_of(F.col("u"))).collect()] == ["a.b.c", "h.de", "x", None, None]


def test_copies_are_one_page_where_asked(documents):
    rows = [(i, "Menu\nhot line\nits other line", "s") for i in range(10)] + [(100 + i, f"Menu\nown {i}", "s") for i in range(20)]
    rows += [(200 + i, "Menu\nalone", None) for i in range(6)] + [(300, None, "s"), (301, "", "s")]
    texts = {r.doc_id: r.text for r in L.without_boilerplate(documents(rows), F.col("source"), copies=False).collect()}
    assert {texts[i] for i in range(10)} == {"hot line\nits other line"} and {texts[200 + i] for i in range(6)} == {"Menu\nalone"}
    assert all(texts[100 + i] == f"own {i}" for i in range(20)) and texts[300] is None and texts[301] == ""
    counts = {r.pages: r.total for r in L.boilerplate(documents(rows), F.col("source"), copies=False).collect()}
    assert counts == {21: 22}
