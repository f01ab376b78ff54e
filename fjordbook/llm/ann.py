"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Codes are signs of principal directions after a rotation that brings the vectors
close to the corners of a cube (iterative quantisation), fitted on a bounded sample.
A code is cut into substrings and every substring is indexed. Two codes within a
radius differ by at most the radius over the number of substrings in some
substring, so a query probes, for each substring, the buckets in that ball, and
finds every code within the radius. Their vectors are ranked by exact distance.

Buckets are held together by leading bits: a query is sent to the parts that its
ball reaches, and looks there only at the first substring that brings a pair
together, so no pair is ranked twice. Parts are split by their counted size; a hot
code is shared out over as many tasks as it needs. Each task returns at most ``k``
rows a query. The radius is the one that finds the wanted share of the sample's own
neighbours. Queries that find fewer than ``k`` rows in it are searched with the
widest radius, which is every row.

Defined cases: vectors that are null, zero, of another length than most, or hold a
null or a number that is not finite take no part, nor rows without a vec_id; rows
alike are candidates of their own; ties go to the smaller vec_id; fewer rows than
``k`` give all of them; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fjordbook.llm.common import table
from fjordbook.llm.words import lean
from fjordbook.session import durable

#: Vectors fitted at most; of those, how many serve as queries for the radius; share of neighbours it must find.
SAMPLE, TRIALS, FOUND = 10_000, 500, 0.97
SUBSTRINGS, SUB_BITS, STEPS = 4, 16, 30
BITS = SUBSTRINGS * SUB_BITS
#: Index rows per part.
ROWS = 20_000


@dataclass
class Coder:
    """Turns vectors into codes: signs of ``(x - mean) @ turn``."""

    mean: np.ndarray
    turn: np.ndarray
    radius: int = BITS

    def codes(self, x: np.ndarray) -> np.ndarray:
        signs = (x - self.mean) @ self.turn > 0
        return np.packbits(signs, axis=1, bitorder="little").view(np.uint64)[:, 0]


def fit(x: np.ndarray, k: int, seed: int = 7) -> Coder:
    """Learn the rotations on a sample, and the radius that finds its own neighbours."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    if not len(x):
        return Coder(np.zeros(dim), rng.standard_normal((dim, BITS)))
    mean = x.mean(0)
    _, directions = np.linalg.eigh((x - mean).T @ (x - mean))
    kept = directions[:, ::-1][:, :min(dim, BITS)]
    y = (x - mean) @ kept
    turns = []
    for _ in range(ceil(BITS / kept.shape[1])):
        turn = np.linalg.qr(rng.standard_normal((kept.shape[1],) * 2))[0]
        for _ in range(STEPS):
            u, _, v = np.linalg.svd(np.sign(y @ turn).T @ y)
            turn = (u @ v).T
        turns.append(kept @ turn)
    coder = Coder(mean, np.hstack(turns)[:, :BITS])
    codes, trials = coder.codes(x), rng.permutation(len(x))[:TRIALS]
    far = []
    for q in trials:
        distance = ((x - x[q]) ** 2).sum(1)
        distance[q] = np.inf
        near = np.argsort(distance, kind="stable")[:min(k, len(x) - 1)]
        far.append(np.bitwise_count(codes[near] ^ codes[q]))
    far = np.concatenate(far) if far else np.empty(0)
    coder.radius = int(np.quantile(far, FOUND, method="higher")) if len(far) else BITS
    return coder


def usable(rows: DataFrame, vector: str) -> Column:
    """Whether a vector takes part, but for its length."""
    v = F.col(f"`{vector}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id, vector)`` of the rows that take part; floats stay floats, all other numbers become doubles."""
    kind = "array<float>" if rows.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    kept = rows.filter(F.col(f"`{key}`").isNotNull() & usable(rows, vector)).select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast(kind).alias("vector"))
    common = kept.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return kept.filter(F.size("vector") == (common["n"] if common else 0))


def kind_of(rows: DataFrame) -> str:
    return rows.schema["vector"].dataType.simpleString()


def matrix(column) -> np.ndarray:
    """A list column of one length as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _masks(bits: int, most: int) -> list[int]:
    return [sum(1 << i for i in c) for n in range(min(most, bits) + 1) for c in combinations(range(bits), n)]


def coded(rows: DataFrame, coder: Coder) -> DataFrame:
    """``(id, vector, code)``."""
    def run(batches):
        for batch in batches:
            codes = coder.codes(matrix(batch.column("vector")).astype(np.float64)) if len(batch) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes.view(np.int64))], ["id", "vector", "code"])

    return rows.mapInArrow(lean(run), f"id long, vector {kind_of(rows)}, code long")


def substring(code: np.ndarray, j: int) -> np.ndarray:
    return (code >> np.uint64(j * SUB_BITS)) & np.uint64((1 << SUB_BITS) - 1)


def nearest(index: DataFrame, queries: DataFrame, k: int, radius: int, total: int) -> DataFrame:
    """``(query_id, vec_id, score)``: the ``k`` nearest found of every query, from stored ``(id, vector, code)`` tables."""
    lead = max(0, min(SUB_BITS - 4, ceil(log2(max(1, total / ROWS)))))
    tables, reach = 1 if radius >= BITS else SUBSTRINGS, radius // SUBSTRINGS  # within the widest radius the first table has every pair
    shift = SUB_BITS - lead
    part = lambda c, j: F.shiftrightunsigned(c, j * SUB_BITS + shift).bitwiseAND(F.lit((1 << lead) - 1)) + F.lit(j << lead)
    own = F.array(*[part(F.col("code"), j) for j in range(tables)])
    counted = index.select(F.explode(own).alias("part")).groupBy("part").count().collect()  # at most 4 * 2**12 rows
    shares = np.ones(tables << lead, np.int64)
    for row in counted:
        shares[row["part"]] = max(1, -(-row["count"] // ROWS))
    first = np.concatenate([[0], np.cumsum(shares)])
    near = np.array(_masks(lead, reach), np.int64)

    def deal(is_query: bool):
        def run(batches):
            for batch in batches:
                code = batch.column("code").to_numpy().view(np.uint64)
                for j in range(tables):
                    parts = (substring(code, j) >> np.uint64(shift)).astype(np.int64)
                    if is_query:  # every share of every part in the ball
                        parts = (parts[:, None] ^ near[None, :]).ravel() + (j << lead)
                        rows = np.repeat(np.arange(len(code)), len(near))
                        many = shares[parts]
                        rows = np.repeat(rows, many)
                        keys = np.repeat(first[parts], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    else:
                        parts = parts + (j << lead)
                        rows = np.arange(len(code))
                        mixed = batch.column("id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
                        keys = first[parts] + (mixed % shares[parts].astype(np.uint64)).astype(np.int64)
                    for i in range(0, len(rows), 1 << 16):
                        s = slice(i, i + (1 << 16))
                        at = pa.array(rows[s])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys[s]), pa.array(np.full(len(at), is_query)), *(batch.column(c).take(at) for c in ("id", "vector", "code"))],
                            ["part", "is_query", "id", "vector", "code"])
        return run

    def search(rows: pa.Table) -> pa.Table:
        j = int(np.searchsorted(first, rows.column("part")[0].as_py(), "right") - 1) >> lead
        asks = rows.column("is_query").to_numpy()
        ids, codes, x = rows.column("id").to_numpy(), rows.column("code").to_numpy().view(np.uint64), matrix(rows.column("vector"))
        q_id, q_code, q_x = ids[asks], codes[asks], x[asks].astype(np.float64)
        ids, codes, x = ids[~asks], codes[~asks], x[~asks]
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for i in range(len(q_id)):
            differ = codes ^ q_code[i]
            at = np.flatnonzero((np.bitwise_count(differ) <= radius) & (ids != q_id[i]))
            d = differ[at]
            here = np.bitwise_count(substring(d, j)) <= reach
            for before in range(j):  # pairs that an earlier substring brings together are ranked there
                here &= np.bitwise_count(substring(d, before)) > reach
            at = at[here]
            score = np.sqrt(((x[at].astype(np.float64) - q_x[i]) ** 2).sum(1))
            if len(at) > k:
                edge = np.partition(score, k - 1)[k - 1]
                keep = score <= edge
                at, score = at[keep], score[keep]
            order = np.lexsort([ids[at], score])[:k]
            out.append((np.full(len(order), q_id[i]), ids[at][order], score[order]))
        q, v, s = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"query_id": q.astype(np.int64), "vec_id": v, "score": s})

    kind = f"part long, is_query boolean, id long, vector {kind_of(index)}, code long"
    dealt = index.mapInArrow(lean(deal(False)), kind).unionByName(queries.mapInArrow(lean(deal(True)), kind))
    return dealt.groupBy("part").applyInArrow(search, "query_id long, vec_id long, score double")


def best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(rows: DataFrame, is_query: Column, k: int = 10, sample: int = SAMPLE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: of every ``(id, vector)`` query row, the nearest other rows found."""
    picked = rows.orderBy(F.xxhash64("id", "vector"), "id").limit(sample).toArrow()
    if not picked.num_rows:
        return best(rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score double"), k)
    x = matrix(picked.column("vector")).astype(np.float64)
    coder = fit(x, k)
    index = durable(coded(rows, coder))
    total = index.count()
    queries = index.filter(is_query).dropDuplicates(["id"])
    found = durable(nearest(index, queries, k, coder.radius, total))
    wanted = min(k, total - 1)
    full = found.groupBy("query_id").count().filter(F.col("count") >= wanted)
    short = durable(queries.join(full, queries["id"] == full["query_id"], "left_anti"))
    if coder.radius < BITS and wanted and short.count():
        again = nearest(index, short, k, BITS, total)
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return best(found, k)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(table(spark, sf_dir, "embeddings"))
    return neighbours(rows, F.col("id") % 100 == 0)
