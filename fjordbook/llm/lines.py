"""Line dedup by site-relative frequency, in DataFrame functions only.

A line's frequency at a host is the share of the host's pages that contain it.
Lines above a ratio are boilerplate there and are dropped from the host's pages;
the same line stays at hosts where it is rare. Lines are compared without the
spaces, tabs and returns around them, by two hashes; blank lines are no lines.

Pages are counted one by one, copies too, unless ``copies`` is off: then pages of a
host with the same lines count as one, and a group of copies larger than the ratio
does not make its own text boilerplate.

Each page counts a line once, before the shuffle, so a hot line or host is one row
per task. A host has at most its mean lines per page divided by the ratio of such
lines. They are stored, and Spark joins them to the pages as their stored size
allows: a small table is broadcast, a large one is a join on the host that adaptive
execution splits where a host is hot.

Defined cases: a null text stays null and counts as a page without lines; a null
host is a host of its own; rows alike are pages of their own; texts of boilerplate
only become empty; hosts with fewer than ``least_pages`` pages with a line keep it;
an empty table stays empty; other columns pass unchanged, but for columns named
``n_lines`` and ``n_removed``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordbook.llm.common import table, whole_row
from fjordbook.session import durable

#: A line on more than this share of a host's pages, and on at least so many, is boilerplate.
RATIO, LEAST_PAGES = 0.1, 4
EDGES = " \t\r"


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(EDGES))


def _key(line: Column) -> Column:
    bare = _bare(line)
    return F.struct(F.xxhash64(bare).alias("one"), F.hash(bare).alias("two"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(pages: DataFrame, host: Column, text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, copies: bool = True) -> DataFrame:
    """``(host, line, pages, total)``: keys of the lines that exceed the ratio at their host.

    Without ``copies``, pages of a host that have the same lines are one page.
    """
    kept = F.filter(_lines(F.col(f"`{text}`")), lambda x: _bare(x) != "")
    pages = pages.select(host.alias("host"), F.array_distinct(F.transform(kept, _key)).alias("lines"))
    if not copies:
        body = F.struct(F.xxhash64("lines").alias("one"), F.hash("lines").alias("two"))
        pages = pages.groupBy("host", body.alias("body")).agg(F.first("lines").alias("lines"))
    seen = pages.select("host", F.explode("lines").alias("line"))
    counts = seen.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= least_pages)
    totals = pages.groupBy(F.col("host").alias("_host")).agg(F.count(F.lit(1)).alias("total"))
    return counts.join(totals, F.col("host").eqNullSafe(F.col("_host"))).filter(F.col("pages") > F.lit(ratio) * F.col("total")).drop("_host")


def without_boilerplate(pages: DataFrame, host: Column, text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, copies: bool = True) -> DataFrame:
    """``pages`` with boilerplate lines dropped from the text, ``n_lines`` before and ``n_removed``."""
    common = boilerplate(pages, host, text, ratio, least_pages, copies)
    by_host = durable(common.groupBy(F.col("host").alias("known")).agg(F.collect_set("line").alias("common")))
    body, found = F.col("body"), F.col("common")
    rows = pages.select(whole_row(pages).alias("row"), host.alias("host"), F.col(f"`{text}`").alias("body"))
    joined = rows.join(by_host, F.col("host").eqNullSafe(F.col("known")), "left")
    kept = F.filter(_lines(body), lambda x: (_bare(x) == "") | ~F.array_contains(found, _key(x)))
    named = joined.withColumn("kept", F.when(found.isNull(), body).otherwise(F.array_join(kept, "\n")))
    count = lambda c: F.greatest(F.coalesce(F.size(F.filter(_lines(c), lambda x: _bare(x) != "")), F.lit(0)), F.lit(0))
    out = [F.col("kept").alias(c) if c == text else F.col(f"row.`{c}`") for c in pages.columns if c not in ("n_lines", "n_removed")]
    return named.select(*out, count(body).alias("n_lines"), (count(body) - count(F.col("kept"))).alias("n_removed"))


def host_of(url: Column) -> Column:
    """The host of an address, in lower case; null where there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return without_boilerplate(pages, F.col("source"))


ORACLE = f"""
WITH cut AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS lines,
         list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS bare
  FROM documents),
seen AS (SELECT source, unnest(list_distinct(bare)) AS line FROM cut),
common AS (
  SELECT s.source, list(s.line) AS found FROM (SELECT source, line, count(*) AS n FROM seen GROUP BY 1, 2) s
  JOIN (SELECT source, count(*) AS total FROM cut GROUP BY 1) t ON s.source IS NOT DISTINCT FROM t.source
  WHERE s.n >= {LEAST_PAGES} AND s.n > {RATIO} * t.total GROUP BY 1)
SELECT c.doc_id, c.source,
  CASE WHEN k.found IS NULL THEN c.text ELSE array_to_string(list_filter(c.lines, lambda x: trim(x, ' ' || chr(9) || chr(13)) = '' OR NOT list_contains(k.found, trim(x, ' ' || chr(9) || chr(13)))), chr(10)) END AS text,
  coalesce(len(c.bare), 0)::INT AS n_lines,
  CASE WHEN k.found IS NULL THEN 0 ELSE coalesce(len(list_filter(c.bare, lambda x: list_contains(k.found, x))), 0) END::INT AS n_removed
FROM cut c LEFT JOIN common k ON c.source IS NOT DISTINCT FROM k.source
"""
