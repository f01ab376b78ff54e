"""Many keyword queries over one positional index: required words, alternatives, exclusions, phrases, fields."""

from pyspark.sql import functions as F

from checks.registry import check
from checks.standins import load
from checks.texts import tokens_cte
from fjordbook.operators import textindex as I

#: Queries made of each benchmark text, and the words of it that one query uses.
PER_ITEM, STEP = 10, 3

# The terms of each kind of query as (group, excluded, words), by number modulo five; number nine has exclusions alone.
KINDS = {
    0: [(0, False, "w0"), (0, False, "w1")],
    1: [(0, False, "w0 w1")],
    2: [(0, False, "w0"), (1, False, "w2")],
    3: [(0, False, "w0"), (0, True, "w1")],
    4: [(0, False, "w0 w1"), (0, False, "w2"), (0, True, "w3"), (1, True, "w1"), (1, False, "w3")],
    9: [(0, True, "w0"), (0, True, "w1")],
}


def _kind(number: int) -> list[tuple[int, bool, str]]:
    return KINDS[9] if number == 9 else KINDS[number % 5]


def _terms_sql() -> str:
    """The terms of every query as rows, from the table of kinds and not from the query's text."""
    rows = []
    for number in range(PER_ITEM):
        for at, (group, excluded, words) in enumerate(_kind(number)):
            text = " || ' ' || ".join(words.split())
            rows.append(f"SELECT query_id * 100 + {group * 10 + at} AS lk, query_id, felt, {group} AS grp, {str(excluded).lower()} AS uten, {text} AS t FROM sp WHERE j = {number}")
    return "\n  UNION ALL ".join(rows)


_WORDS = "list_filter(string_split(regexp_replace(text, '[^\\p{L}]+', ' ', 'g'), ' '), lambda x: length(x) > 2)"
_INDEX = f"""felter AS (
  SELECT doc_id * 4 AS fk, split_part(text, chr(10), 1) AS t FROM documents
  UNION ALL SELECT doc_id * 4 + 1, substr(text, length(split_part(text, chr(10), 1)) + 2) FROM documents
  UNION ALL SELECT doc_id * 4 + 2, source FROM documents),
{tokens_cte('tok', 'felter', 'fk', 't')},
sp AS (
  SELECT item_id * {PER_ITEM} + j AS query_id, j, CASE item_id % 3 WHEN 0 THEN 'B' WHEN 2 THEN 'AC' END AS felt,
         w[{STEP} * j + 1] AS w0, w[{STEP} * j + 2] AS w1, w[{STEP} * j + 3] AS w2, w[{STEP} * j + 4] AS w3
  FROM (SELECT item_id, {_WORDS} AS w, unnest(range({PER_ITEM})) AS j FROM benchmark) a WHERE len(w) >= {STEP} * j + 4),
ledd AS ({_terms_sql()}),
{tokens_cte('lt', 'ledd', 'lk', 't')},
lengde AS (SELECT lk, count(*) AS n FROM lt GROUP BY 1),
truffet AS (
  SELECT lk, fk, lt_start FROM (SELECT lt.lk, tok.fk, tok.pos - lt.pos AS lt_start FROM lt JOIN tok USING (token)) m
  GROUP BY 1, 2, 3 HAVING count(*) = (SELECT n FROM lengde l WHERE l.lk = m.lk)),
treff AS (
  SELECT l.lk, l.query_id, l.grp, l.uten, fk // 4 AS doc_id, max(CASE fk % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.4 ELSE 0.2 END) AS vekt
  FROM truffet t JOIN ledd l USING (lk) WHERE felt IS NULL OR contains(felt, CASE fk % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END)
  GROUP BY ALL),
grupper AS (
  SELECT query_id, grp, count(*) FILTER (WHERE NOT uten) AS krav FROM ledd JOIN lengde USING (lk) GROUP BY 1, 2),
fulle AS (SELECT query_id, grp, doc_id, count(*) AS n, sum(vekt) AS vekt FROM treff WHERE NOT uten GROUP BY 1, 2, 3)"""


@check("keyword_batch", ctes=_INDEX, oracle="""
SELECT query_id, doc_id, round(max(coalesce(f.vekt, 0)), 6) AS vekt
FROM grupper g CROSS JOIN (SELECT doc_id FROM documents) d LEFT JOIN fulle f USING (query_id, grp, doc_id)
WHERE coalesce(f.n, 0) = g.krav AND (query_id, grp, doc_id) NOT IN (SELECT (query_id, grp, doc_id) FROM treff WHERE uten)
GROUP BY 1, 2""")
def keyword_batch(spark, sf_dir):
    """Ten queries of each benchmark text over first lines (A), the rest of the texts (B) and sources (C)."""
    documents = load(spark, sf_dir, "documents")
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    rest = F.substr("text", F.length(first) + 2)
    index = I.build_index(documents, "doc_id", [("A", first), ("B", rest), ("C", F.col("source"))], language="engelsk")
    words = F.filter(F.split(F.regexp_replace("text", r"[^\p{L}]+", " "), " "), lambda w: F.length(w) > 2)
    cut = load(spark, sf_dir, "benchmark").select("item_id", words.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(PER_ITEM - 1))).alias("j"))
    cut = cut.filter(F.size("w") >= STEP * F.col("j") + 4)
    word = {f"w{i}": F.element_at("w", STEP * F.col("j") + i + 1) for i in range(4)}

    def written(kind):
        """A query as its user writes it."""
        parts, group = [], 0
        for g, excluded, names in kind:
            quote = '"' if " " in names else ""
            text = F.concat_ws(" ", *[word[n] for n in names.split()])
            parts.append(F.concat(F.lit(("or " if g > group else "") + ("-" if excluded else "") + quote), text, F.lit(quote)))
            group = g
        return F.concat_ws(" ", *parts)

    tekst = F.when(F.col("j") == 9, written(KINDS[9]))
    for kind in range(5):
        tekst = tekst.when(F.col("j") % 5 == kind, written(KINDS[kind]))
    only = F.when(F.col("item_id") % 3 == 0, "B").when(F.col("item_id") % 3 == 2, "AC")
    queries = cut.select((F.col("item_id") * PER_ITEM + F.col("j")).alias("query_id"), tekst.alias("tekst"), only.alias("felt"))
    return I.keyword_search(index, queries, only="felt").withColumn("vekt", F.round("vekt", 6))
