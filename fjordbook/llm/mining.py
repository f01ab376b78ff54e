"""Hard-negative mining: exact integer scores by Strassen products of tiles, mergeable heaps of positives and windows.

Vectors become whole numbers, so every score is an exact integer and ties are real
ties. Anchors and candidates are dealt into blocks of even size by their place in
the stored table, and every block of anchors meets every block of candidates in one
task, as a stated set of queries meets all rows. There:

1. Scores of anchors and candidates of the same label are the entries of integer
   products, computed by Strassen's recursion: each halving of all three sides costs
   seven products instead of eight. Sides are padded with zeros to even lengths,
   additions are those of 64-bit integers.
2. What a task returns are heaps: the best positives of each anchor, then, once
   these are known, the best negatives inside each positive's window of scores.
   Heaps of tiles merge into one heap a task, and heaps of tasks into the result.

A row is sent to as many tasks as there are blocks of the other side: candidates once
for every ``ANCHORS`` anchors, anchors once for every ``ROWS`` candidates. Blocks
follow row numbers and not labels or keys, so a hot label or a group of copies fills
no block more than another.

Defined cases: rows with a null label or vector, a component that is null or not
finite, no id, or another length than most vectors take no part, nor do rows whose
scores cannot be held by 64 bits (their norm, after scaling, is 2**31 or more). A row
is another row than the anchor if its id differs. Rows alike are candidates of their
own, and anchors of their own. An anchor without positives gives no rows, nor does a
positive whose window is empty. An empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordbook.llm.common import table
from fjordbook.llm.words import lean
from fjordbook.operators.keyed import top_per_key
from fjordbook.session import durable

#: Positives an anchor, negatives a positive; a negative's score in hundredths of the positive's, from and to.
POSITIVES, NEGATIVES, LEAST, MOST = 5, 5, 80, 100
#: Anchors and candidates of a block; of a tile within it; the shortest side that is still halved.
ANCHORS, ROWS = 4096, 4096
TILE_ANCHORS, TILE_ROWS, LEAF = 512, 2048, 32


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of 64-bit integers, by Strassen's recursion on rows of ``a``, rows of ``b`` and columns of both."""
    m, d = a.shape
    n = b.shape[0]
    if min(m, n, d) <= LEAF:
        return np.einsum("ik,jk->ij", np.ascontiguousarray(a), np.ascontiguousarray(b))
    pad = lambda x: np.pad(x, [(0, s & 1) for s in x.shape])  # noqa: E731  a row or column of zeros where a side is odd
    a, b = pad(a), pad(b)
    i, j, k = a.shape[0] // 2, b.shape[0] // 2, a.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :k], a[:i, k:], a[i:, :k], a[i:, k:]
    # b is held by rows of its transpose, so its upper right quarter lies lower left
    b11, b12, b21, b22 = b[:j, :k], b[j:, :k], b[:j, k:], b[j:, k:]
    out = np.empty((2 * i, 2 * j), np.int64)
    c11, c12, c21, c22 = out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:]
    one = product(a11 + a22, b11 + b22)
    c11[:] = one
    c22[:] = one
    two = product(a21 + a22, b11)
    c21[:] = two
    c22 -= two
    three = product(a11, b12 - b22)
    c12[:] = three
    c22 += three
    four = product(a22, b21 - b11)
    c11 += four
    c21 += four
    five = product(a11 + a12, b22)
    c11 -= five
    c12 += five
    c22 += product(a21 - a11, b11 + b12)
    c11 += product(a12 - a22, b21 + b22)
    return out[:m, :n]


def entries(rows: DataFrame, scale: int, key: str, vector: str, label: Column) -> DataFrame:
    """``(id, label, place, vector)``: the rows that take part, stored, with whole-number vectors and a row number."""
    v = F.col(f"`{vector}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.pow(F.abs(F.lit(float(scale)) * x.cast("double")) + 1, F.lit(2.0)))
    fits = F.col(f"`{key}`").isNotNull() & label.isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & (norm < float(1 << 62))
    kept = rows.filter(fits).select(
        F.col(f"`{key}`").cast("long").alias("id"), label.cast("long").alias("label"), F.monotonically_increasing_id().alias("place"), whole.alias("vector"))
    stored = durable(kept)
    widths = stored.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return stored.filter(F.size("vector") == (widths["n"] if widths else 0))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


class Heaps:
    """The first ``k`` candidates of every slot, by higher score and then smaller id; heaps are merged by adding."""

    def __init__(self, k: int):
        self.k = k
        self.slot = np.empty(0, np.int64)
        self.score = np.empty(0, np.int64)
        self.id = np.empty(0, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort([ids, -score, slot])
        slot = slot[order]
        opens = np.flatnonzero(np.diff(slot, prepend=-1))
        rank = np.arange(len(slot)) - np.repeat(opens, np.diff(np.append(opens, len(slot))))
        kept = rank < self.k
        self.slot, self.score, self.id = slot[kept], score[order][kept], ids[order][kept]

    def add_tile(self, slots: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """A tile's rows, one slot each: of the allowed entries, those that reach the row's ``k``-th highest."""
        if not allowed.any():
            return
        held = np.where(allowed, scores, np.iinfo(np.int64).min)
        if held.shape[1] > self.k:
            edge = np.partition(held, held.shape[1] - self.k, axis=1)[:, held.shape[1] - self.k]
            allowed = allowed & (held >= edge[:, None])
        row, at = np.nonzero(allowed)
        self.add(slots[row], scores[row, at], ids[at])


def tiles(n: int, size: int) -> Iterator[slice]:
    for i in range(0, n, size):
        yield slice(i, min(n, i + size))


def dealt(anchors: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every block of anchors beside every block of candidates, as rows of one group each."""
    a_blocks = max(1, -(-anchors.count() // ANCHORS))
    c_blocks = max(1, -(-candidates.count() // ROWS))
    block = lambda n: F.pmod(F.xxhash64("place"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = ["id", "label", "place", "vector"]
    sent_a = anchors.select(block(a_blocks).cast("int").alias("a"), every(c_blocks).alias("c"), F.lit(True).alias("asks"), *own, "bounds")
    sent_c = candidates.select(every(a_blocks).alias("a"), block(c_blocks).cast("int").alias("c"), F.lit(False).alias("asks"), *own, F.lit(None).cast("array<long>").alias("bounds"))
    return sent_a.unionByName(sent_c).withColumn("pair", F.col("a").cast("long") * c_blocks + F.col("c")).drop("a", "c")


def halves(rows: pa.Table) -> tuple[pa.Table, pa.Table]:
    asks = rows.column("asks")
    return rows.filter(asks), rows.filter(pc.invert(asks))


def nearest_alike(k: int):
    """Tiles of one pair of blocks to ``(place, other, score)``: each anchor's best others of its label."""
    def run(rows: pa.Table) -> pa.Table:
        ask, other = halves(rows)
        ids, x, place = ask.column("id").to_numpy(), matrix(ask.column("vector")), ask.column("place").to_numpy()
        c_ids, y = other.column("id").to_numpy(), matrix(other.column("vector"))
        labels, c_labels = ask.column("label").to_numpy(), other.column("label").to_numpy()
        heaps = Heaps(k)
        by, c_by = np.argsort(labels, kind="stable"), np.argsort(c_labels, kind="stable")
        for label in np.intersect1d(labels, c_labels).tolist():
            mine = by[slice(*np.searchsorted(labels[by], [label, label + 1]))]
            theirs = c_by[slice(*np.searchsorted(c_labels[c_by], [label, label + 1]))]
            for s in tiles(len(mine), TILE_ANCHORS):
                for t in tiles(len(theirs), TILE_ROWS):
                    a, c = mine[s], theirs[t]
                    heaps.add_tile(a, product(x[a], y[c]), ids[a][:, None] != c_ids[c][None, :], c_ids[c])
        return pa.table({"place": place[heaps.slot], "other": heaps.id, "score": heaps.score})

    return run


def nearest_in_windows(k: int, least: int, most: int):
    """Tiles of one pair of blocks to ``(place, window, other, score)``: the best others inside each window of scores."""
    def run(rows: pa.Table) -> pa.Table:
        ask, other = halves(rows)
        x, place = matrix(ask.column("vector")), ask.column("place").to_numpy()
        c_ids, y = other.column("id").to_numpy(), matrix(other.column("vector"))
        labels, c_labels = ask.column("label").to_numpy(), other.column("label").to_numpy()
        lists = ask.column("bounds").combine_chunks()
        n = lists.value_lengths().to_numpy() if len(ask) else np.empty(0, np.int64)
        width = int(n.max()) if len(n) else 0
        known = np.arange(width)[None, :] < n[:, None]
        bounds = np.zeros((len(ask), width), np.int64)
        bounds[known] = lists.flatten().to_numpy()
        heaps = Heaps(k)
        for s in tiles(len(x), TILE_ANCHORS):
            for t in tiles(len(y), TILE_ROWS):
                scores = product(x[s], y[t])
                unlike = labels[s][:, None] != c_labels[t][None, :]
                for w in range(width):
                    whole, rest = np.divmod(bounds[s, w], 100)  # least * p <= 100 * score <= most * p, without products that could overflow
                    low, high = whole * least - (-rest * least) // 100, whole * most + (rest * most) // 100
                    inside = unlike & (scores >= low[:, None]) & (scores <= high[:, None]) & known[s, w][:, None]
                    heaps.add_tile(np.arange(s.start, s.stop) * width + w, scores, inside, c_ids[t])
        slot, window = np.divmod(heaps.slot, max(1, width))
        return pa.table({"place": place[slot], "window": window.astype(np.int32), "other": heaps.id, "score": heaps.score})

    return run


def mined(rows: DataFrame, is_anchor: Column, label: Column, scale: int = 256, positives: int = POSITIVES, negatives: int = NEGATIVES,
          least: int = LEAST, most: int = MOST, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``is_anchor`` is a condition on the column ``id``, ``label`` an expression on ``rows``.
    """
    stored = entries(rows, scale, key, vector, label)
    anchors = stored.filter(is_anchor).withColumn("bounds", F.lit(None).cast("array<long>"))
    best = [F.desc("score"), F.col("other")]
    met = dealt(anchors, stored).groupBy("pair").applyInArrow(lean_group(nearest_alike(positives)), "place long, other long, score long")
    found = durable(top_per_key(met, ["place"], best, positives, rank="window"))
    windows = found.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("window", "score"))).alias("w"))  # at most ``positives`` a row
    asking = durable(stored.filter(is_anchor).join(windows, "place").withColumn("bounds", F.col("w.score")).drop("w"))
    held = dealt(asking, stored).groupBy("pair").applyInArrow(lean_group(nearest_in_windows(negatives, least, most)), "place long, window int, other long, score long")
    top = top_per_key(held, ["place", "window"], best, negatives, rank="rank")
    named = found.select("place", (F.col("window") - 1).alias("window"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    return top.join(named, ["place", "window"]).join(stored.select("place", F.col("id").alias("anchor_id")), "place").select(
        "anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def lean_group(run):
    """A function of one group that gives free memory back to the machine at its end."""
    def wrapped(rows: pa.Table) -> pa.Table:
        return next(lean(lambda tables: (run(t) for t in tables))([rows]))

    return wrapped


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


#: The same for DuckDB.
ORACLE = f"""
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * cast(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other, a.label = c.label AS alike, cast(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM kept a, kept c WHERE a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES})
SELECT p.anchor_id, positive_id, cast(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INT) AS "rank",
       other AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT alike
     AND {LEAST} * positive_score <= 100 * score AND 100 * score <= {MOST} * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) <= {NEGATIVES}
"""
