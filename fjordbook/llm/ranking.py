"""Ranked lexical search: accumulators of short lists as one more iterator beside skipping over long lists.

1. Every document's occurrences of the items' terms are counted once, inside the
   task that reads its text, and stored with its number of terms. From that table
   come the corpus counts: documents, terms, documents per term.
2. A task turns documents it reads into inverted lists of bounded size, in order of
   doc_id. For each item, the short lists are summed term at a time into
   accumulators; these are then one iterator with the largest sum as its bound.
   Together with the long lists it is read document at a time, a window of documents
   after another: iterators whose bounds cannot reach the lowest kept score bring up
   no candidates, and are only looked up, by blocks with a largest score each, for
   candidates that can still reach it.
3. A task keeps the best ``k`` documents of an item over all its lists, so what is
   shuffled is at most ``k`` rows an item and task.

The items' terms are sent to all tasks in blocks of about ``BLOCK`` rows; further
blocks take further passes, so what is sent has a bound that does not grow with the
items. Postings are never shuffled, so no term is a hot key.

Defined cases: a null or blank text has no terms, is no document of the corpus and is
never returned; items without terms, or whose terms no document has, return no
rows; rows alike are documents, and items, of their own; equal scores go to the
smaller doc_id, rows without one last; fewer than ``k`` documents above 0 give
all; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordbook.llm import words as W
from fjordbook.llm.common import table
from fjordbook.operators.keyed import top_per_key
from fjordbook.session import durable

#: A term, as a pattern of characters; in UTF-8 it is a run of the bytes marked in ``TERM``.
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM = np.zeros(256, bool)
TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Results an item; saturation, length share and scale of the score.
K, SCALE, SATURATION, SHARE = 20, 1_000_000_000, 12, 25
#: (item, term) rows sent to the tasks at once; bytes of text cut into terms at once.
BLOCK, CHUNK = 500_000, 8 << 20
#: Postings of the lists a task holds at once; postings summed into accumulators per item;
#: documents of a window; postings of a block of a long list.
LISTS, SUMMED, SPAN, SKIP = 2_000_000, 4096, 8192, 128


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All texts' terms as one array, and the number of the first of each text (and of the end)."""
    inside = TERM[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    borders = offsets[(offsets > 0) & (offsets < len(data))]
    opens[borders] = inside[borders]
    starts = np.flatnonzero(opens)
    packed = LOWER[data[inside]]
    ends = np.append((np.cumsum(inside)[starts] - 1) if len(starts) else starts, len(packed)).astype(np.int64)
    values = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
    return values, np.searchsorted(starts, offsets)


def term_counts(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``(doc_id, n, terms, counts)`` of the documents with a term: all their terms with repeats, and those of the vocabulary."""
    wanted = pa.array([t.encode() for t in vocabulary], pa.large_binary())

    def run(batches):
        for batch in batches:
            data, offsets = W.buffer(batch.column("text"))
            for low, high in W.slices(offsets, CHUNK):
                found, first = terms(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                n = np.diff(first)
                owner = np.repeat(np.arange(high - low), n)
                number = pc.index_in(found, value_set=wanted).fill_null(-1).to_numpy().astype(np.int64)
                known = number >= 0
                pair, count = np.unique(owner[known] * max(1, len(wanted)) + number[known], return_counts=True)
                doc, term = np.divmod(pair, max(1, len(wanted)))
                at = np.searchsorted(doc, np.arange(high - low + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(v.astype(np.int32))) for v in (term, count)]
                out = pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(n.astype(np.int64)), *lists], ["doc_id", "n", "terms", "counts"])
                yield out.filter(pa.array(n > 0))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(W.lean(run), "doc_id long, n long, terms array<int>, counts array<int>")


def document_frequencies(counted: DataFrame) -> dict[int, int]:
    """Documents per term number, of a vocabulary that is one block."""
    def run(batches):
        seen = np.zeros(0, np.int64)
        for batch in batches:
            here = np.bincount(batch.column("terms").flatten().to_numpy())
            if len(here) > len(seen):
                seen, here = here, seen
            seen[:len(here)] += here
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(seen[at].astype(np.int64))], ["term", "docs"])

    partial = counted.select("terms").mapInArrow(run, "term long, docs long")
    return {r["term"]: r["docs"] for r in partial.groupBy("term").agg(F.sum("docs").alias("docs")).collect()}


def length_norms(n: np.ndarray, documents: int, occurrences: int) -> np.ndarray:
    """``100 - SHARE + (SHARE * n * documents) div occurrences`` of each document; beyond 64 bits by Python's integers."""
    if len(n) and SHARE * int(n.max()) * documents >= 1 << 63:
        return np.array([100 - SHARE + (SHARE * int(x) * documents) // occurrences for x in n], np.int64)
    return 100 - SHARE + (SHARE * n * documents) // max(1, occurrences)


@dataclass
class Query:
    """What all tasks know of a block of items."""

    items: list[tuple[int, np.ndarray, np.ndarray]]  # number, term numbers, repeats in the item
    weights: np.ndarray
    documents: int
    occurrences: int
    k: int


class Postings:
    """A list in order of documents, with the largest score of every ``SKIP`` postings."""

    def __init__(self, docs: np.ndarray, scores: np.ndarray):
        self.docs, self.scores = docs, scores
        self.bound = int(scores.max()) if len(scores) else 0
        self._most: np.ndarray | None = None

    def times(self, n: int) -> Postings:
        """The list of a term that an item holds ``n`` times."""
        return self if n == 1 else Postings(self.docs, self.scores * n)

    def within(self, low: int, high: int) -> slice:
        return slice(*np.searchsorted(self.docs, [low, high]).tolist())

    def added(self, docs: np.ndarray, sums: np.ndarray, needed: int) -> tuple[np.ndarray, np.ndarray]:
        """The candidates that can reach ``needed`` here, and their sums with this list's scores."""
        if self._most is None:
            self._most = np.maximum.reduceat(self.scores, np.arange(0, len(self.scores), SKIP))
        at = np.minimum(np.searchsorted(self.docs, docs), len(self.docs) - 1)
        alive = sums + self._most[at // SKIP] >= needed  # whole blocks are skipped by their largest score
        docs, sums, at = docs[alive], sums[alive], at[alive]
        return docs, sums + np.where(self.docs[at] == docs, self.scores[at], 0)


def accumulated(lists: list[Postings]) -> Postings:
    """Short lists summed term at a time, as one list."""
    docs, where = np.unique(np.concatenate([p.docs for p in lists]), return_inverse=True)
    sums = np.zeros(len(docs), np.int64)
    at = 0
    for p in lists:
        sums[where[at:at + len(p.docs)]] += p.scores
        at += len(p.docs)
    return Postings(docs, sums)


def best_of(docs: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by document."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= edge)
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort([docs[kept], -scores[kept]])[:k]]


def search(lists: list[Postings], n_docs: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best documents with at least ``floor`` (and more than 0), of lists in order of documents."""
    lists = sorted((p for p in lists if p.bound > 0), key=lambda p: len(p.docs))
    summed, size = 0, 0
    while summed < len(lists) and size + len(lists[summed].docs) <= SUMMED:
        size += len(lists[summed].docs)
        summed += 1
    iterators = ([accumulated(lists[:summed])] if summed else []) + lists[summed:]
    iterators.sort(key=lambda p: p.bound)
    reach = np.cumsum([p.bound for p in iterators]).tolist()  # the most that this iterator and those before it add up to
    top, top_scores = np.empty(0, np.int64), np.empty(0, np.int64)
    low = max(1, floor)
    for start in range(0, n_docs, SPAN):
        first = next((i for i, r in enumerate(reach) if r >= low), None)
        if first is None:
            break  # no document can reach the lowest kept score any more
        sums, seen = np.zeros(SPAN, np.int64), np.zeros(SPAN, bool)
        for p in iterators[first:]:
            part = p.within(start, start + SPAN)
            sums[p.docs[part] - start] += p.scores[part]
            seen[p.docs[part] - start] = True
        at = np.flatnonzero(seen)
        docs, scores = at + start, sums[at]
        for i in range(first - 1, -1, -1):
            alive = scores + reach[i] >= low
            docs, scores = docs[alive], scores[alive]
            if not len(docs):
                break
            docs, scores = iterators[i].added(docs, scores, low - (reach[i - 1] if i else 0))
        alive = scores >= low
        if alive.any():
            docs, scores = np.concatenate([top, docs[alive]]), np.concatenate([top_scores, scores[alive]])
            kept = best_of(docs, scores, k)
            top, top_scores = docs[kept], scores[kept]
            if len(top) == k:
                low = max(low, int(top_scores[-1]))
    return top, top_scores


def ranked(counted: DataFrame, query: Query) -> DataFrame:
    """``(item, doc_id, score)``: of every item, the best documents of each task."""
    def run(batches):
        best = {number: (np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)) for number, _, _ in query.items}

        def take(held: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids, missing = rows.column("doc_id").fill_null(0).to_numpy(), rows.column("doc_id").is_null().to_numpy()
            lists = [rows.column(c).combine_chunks() for c in ("terms", "counts")]
            owner = np.repeat(np.arange(len(ids)), pc.list_value_length(lists[0]).to_numpy())
            term, tf = (x.flatten().to_numpy().astype(np.int64) for x in lists)
            order = np.lexsort([ids, missing])  # places in the order that breaks ties
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            norm = length_norms(rows.column("n").to_numpy(), query.documents, query.occurrences)
            score = query.weights[term] * ((SCALE * tf) // (1000 * tf + SATURATION * norm[owner]))
            by_list = np.lexsort([place[owner], term])
            term, doc, score = term[by_list], place[owner][by_list], score[by_list]
            starts = np.searchsorted(term, np.arange(len(query.weights) + 1))
            known: dict[int, Postings] = {}
            for number, of, times in query.items:
                chosen = []
                for t, n in zip(of.tolist(), times.tolist(), strict=True):
                    low, high = starts[t], starts[t + 1]
                    if low < high:
                        if t not in known:
                            known[t] = Postings(doc[low:high], score[low:high])
                        chosen.append(known[t].times(n))
                held_ids, held_missing, held_scores = best[number]
                floor = int(held_scores[-1]) if len(held_scores) == query.k else 0
                found, scores = search(chosen, len(ids), query.k, floor)
                if len(found):
                    i = np.concatenate([held_ids, ids[order[found]]])
                    m = np.concatenate([held_missing, missing[order[found]]])
                    s = np.concatenate([held_scores, scores])
                    kept = np.lexsort([i, m, -s])[:query.k]
                    best[number] = i[kept], m[kept], s[kept]

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch) + len(batch.column("terms").flatten())
            if size >= LISTS:
                take(held)
                held, size = [], 0
        if held:
            take(held)
        numbers = np.repeat(np.array([n for n, _, _ in query.items], np.int64), [len(best[n][0]) for n, _, _ in query.items])
        ids, missing, scores = (np.concatenate([best[n][c] for n, _, _ in query.items]) if query.items else np.empty(0, np.int64) for c in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(ids, pa.int64(), mask=missing.astype(bool)), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    return counted.mapInArrow(W.lean(run), "item long, doc_id long, score long")


def weight(documents: int, with_term: int) -> int:
    """A term's weight: ``floor(1000 * ln((2N + 2) / (2 df + 1)))``, in doubles."""
    return math.floor(1000.0 * math.log((2.0 * documents + 2.0) / (2.0 * with_term + 1.0)))


def best_documents(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents ``(doc_id, text)`` of every item ``(item_id, text)``."""
    numbered = durable(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"))
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.explode(F.regexp_extract_all(lowered, F.lit(f"({PATTERN})"), 1))
    held = durable(numbered.select("item", found.alias("term")).groupBy("item", "term").agg(F.count(F.lit(1)).alias("times")))
    blocks = max(1, -(-held.count() // BLOCK))
    found = []
    for block in range(blocks):
        rows = held.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).orderBy("item", "term").toArrow()
        vocabulary = sorted(set(rows.column("term").to_pylist()))
        numbers = {t: i for i, t in enumerate(vocabulary)}
        counted = durable(term_counts(docs, vocabulary))
        total = counted.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        df = document_frequencies(counted)
        weights = np.array([weight(total["docs"], df.get(i, 0)) for i in range(len(vocabulary))], np.int64)
        item = rows.column("item").to_numpy()
        term = np.array([numbers[t] for t in rows.column("term").to_pylist()], np.int64)
        times = rows.column("times").to_numpy()
        at = np.append(np.flatnonzero(np.diff(item, prepend=-1)), len(item))
        listed = [(int(item[a]), term[a:b], times[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        found.append(durable(ranked(counted, Query(listed, weights, total["docs"], total["terms"], k))))
    everything = found[0]
    for more in found[1:]:
        everything = everything.unionByName(more)
    # ranked twice: first over shares of an item's rows, so that no task gets what all tasks found
    share = everything.withColumn("share", F.pmod(F.xxhash64("doc_id", "score"), F.lit(64)))
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    few = top_per_key(share, ["item", "share"], order, k).drop("share")
    top = top_per_key(few, ["item"], order, k, rank="rank")
    return top.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


#: The same for DuckDB, where the character class is written the other way round.
ORACLE = f"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term
  FROM documents),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term
    FROM benchmark)
  GROUP BY 1, 2),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY 1),
corpus AS (SELECT count(*) AS n_docs, cast(sum(n) AS BIGINT) AS n_terms FROM sizes),
postings AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2),
weights AS (
  SELECT term, cast(floor(1000.0 * ln((2.0 * n_docs + 2.0)::DOUBLE / (2.0 * count(*) + 1.0)::DOUBLE)) AS BIGINT) AS w
  FROM postings, corpus GROUP BY term, n_docs),
scores AS (
  SELECT item_id, doc_id, cast(sum(times * w * (({SCALE} * tf) // (1000 * tf + {SATURATION} * (100 - {SHARE} + ({SHARE} * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), corpus
  GROUP BY 1, 2),
ranks AS (
  SELECT item_id, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS "rank", doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, "rank", doc_id, score FROM ranks WHERE "rank" <= {K}
"""
