"""Document fingerprints: SimHash over weighted terms, and radius search by permuted block tables.

A term is a shingle of three words (a shorter text is one term), its weight the
bytes of its words: long words are rare ones. Every bit of a term's hash votes
its weight for or against that bit of the fingerprint.

Defined cases: a null text is an empty one; a text without words has the zero
fingerprint; equal texts have equal fingerprints; rows alike give rows alike; other
columns of the input are not read. An empty table gives an empty result. Documents
are ordered by doc_id downwards, nulls last, then by text; after the last comes the
first.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordbook.llm import words as W
from fjordbook.llm.common import partitions, table

TERM_WORDS = 3
#: Further hash words of a term are remixed with these added.
SEEDS = W.mix(np.arange(1, 65, dtype=np.uint64))


def votes(terms: np.ndarray, weights: np.ndarray, bits: int) -> np.ndarray:
    """Sums of signed weights per bit of the terms' hashes; any number of terms in bounded memory."""
    total = np.zeros(bits, np.float64)
    for i in range(0, len(terms), 1 << 15):
        h, w = terms[i:i + (1 << 15)], weights[i:i + (1 << 15)].astype(np.float32)
        for j in range(bits // 64):
            part = W.mix(h + SEEDS[j])
            set_bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total[64 * j:64 * j + 64] += 2.0 * (w @ set_bits.astype(np.float32)) - w.sum()
    return total


def fingerprints(data: np.ndarray, offsets: np.ndarray, bits: int = 64) -> np.ndarray:
    """One row of ``bits / 64`` unsigned words per text of the buffer."""
    out = np.zeros((len(offsets) - 1, bits // 64), np.uint64)
    for low, high in W.slices(offsets):
        part, at = data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        starts, ends, first = W.spans(part, at)
        hashed = W.hashes(part, starts, ends)
        size = (ends - starts).astype(np.float32)
        long_terms = W.shingles(hashed, TERM_WORDS)
        long_sizes = sum(size[j:len(size) - TERM_WORDS + 1 + j] for j in range(TERM_WORDS)) if len(size) >= TERM_WORDS else size
        for i in range(high - low):
            a, b = first[i], first[i + 1]
            if b - a >= TERM_WORDS:
                total = votes(long_terms[a:b - TERM_WORDS + 1], long_sizes[a:b - TERM_WORDS + 1], bits)
            elif b > a:
                total = votes(W.shingles(hashed[a:b], int(b - a)), size[a:a + 1], bits)
            else:
                continue
            out[low + i] = np.packbits(total > 0, bitorder="little").view(np.uint64)
    return out


def digits(codes: np.ndarray) -> list[str]:
    """Fingerprints as lower-case hex, 16 digits per word."""
    return ["".join(f"{int(x):016x}" for x in row) for row in codes]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits, 0 to 1."""
    return 1.0 - np.bitwise_count(a ^ b).sum(axis=1) / (64.0 * a.shape[1])


def fingerprint(docs: DataFrame, bits: int = 64, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, code)``: every whole text's fingerprint as an array of longs, ``bits`` a multiple of 64."""
    def run(batches):
        for batch in batches:
            data, offsets = W.buffer(batch.column(1))
            codes = fingerprints(data, offsets, bits).view(np.int64)
            flat = pa.array(codes.ravel())
            ends = np.arange(0, codes.size + 1, bits // 64)
            yield pa.RecordBatch.from_arrays([batch.column(0), W.lengths(flat, ends)], ["key", "code"])

    picked = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    return picked.mapInArrow(W.lean(run), "key long, code array<long>")


def _block(code: Column, low: int, high: int) -> Column:
    """Bits ``low`` to ``high`` of a code, which may reach over a word's border."""
    if low // 64 == (high - 1) // 64:
        word = F.shiftrightunsigned(F.element_at(code, low // 64 + 1), low % 64)
        return word.bitwiseAND(F.lit((1 << (high - low)) - 1)) if high - low < 64 else word
    split = (low // 64 + 1) * 64
    return F.xxhash64(_block(code, low, split), _block(code, split, high))


def block_keys(code: Column, bits: int, blocks: int, lead: int) -> Column:
    """The code's key in each permuted block table: every choice of ``lead`` of ``blocks`` blocks stands first once."""
    edges = [bits * i // blocks for i in range(blocks + 1)]
    tables = [
        F.struct(F.lit(t).alias("table"), F.xxhash64(*[_block(code, edges[i], edges[i + 1]) for i in chosen]).alias("lead"))
        for t, chosen in enumerate(combinations(range(blocks), lead))
    ]
    return F.array(*tables)


def within_radius(codes: DataFrame, queries: DataFrame, radius: int, bits: int = 64, lead: int = 3) -> DataFrame:
    """``(query, key, distance)``: every row of ``codes`` within ``radius`` bits of a row of the stated query set.

    Both frames are ``(key, code)``. Codes are cut into ``radius + lead`` blocks:
    at most ``radius`` of them differ, so some choice of ``lead`` blocks is equal,
    and that choice's table brings the pair together. Equal codes are searched
    once. A query finds itself if it is among the codes.
    """
    blocks = radius + lead
    def tabled(df: DataFrame, name: str) -> DataFrame:
        return df.select("code").distinct().select(F.col("code").alias(name), F.explode(block_keys(F.col("code"), bits, blocks, lead)).alias("at")).select(name, "at.*")

    far = F.aggregate(F.zip_with("a", "b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    pairs = tabled(queries, "a").join(tabled(codes, "b"), ["table", "lead"]).withColumn("distance", far).filter(F.col("distance") <= radius)
    pairs = pairs.select("a", "b", "distance").distinct()
    return (
        pairs.join(queries.select(F.col("key").alias("query"), F.col("code").alias("a")), "a")
        .join(codes.select("key", F.col("code").alias("b")), "b").select("query", "key", "distance")
    )


def with_next(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows dealt so that each document stands right before the next one: ``(pid, kind, doc_id, text)``.

    Key ranges are cut at quantiles of doc_id. The row at a cut also goes to the
    range above it (``kind`` 1), the first row of all to the lowest range (``kind``
    2), so the documents of a range and their successors are in one task.
    """
    width = 4 * max(partitions(spark), docs.rdd.getNumPartitions())
    at = docs.agg(F.percentile_approx("doc_id", [i / width for i in range(1, width)], 100 * width).alias("cuts"), F.max("doc_id").alias("top")).first()
    cuts = sorted(set(at.cuts or ()))
    lower = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0)
    pid = F.when(F.col("doc_id").isNull(), 0).otherwise(lower)
    is_cut = F.col("doc_id").isin(cuts) if cuts else F.lit(False)
    target = lambda p, kind: F.struct(p.cast("int").alias("pid"), F.lit(kind).alias("kind"))
    places = F.concat(
        F.array(target(pid, 0)),
        F.when(is_cut, F.array(target(pid + 1, 1))).otherwise(F.array().cast("array<struct<pid:int,kind:int>>")),
        F.when(F.col("doc_id") == F.lit(at.top), F.array(target(F.lit(0), 2))).otherwise(F.array().cast("array<struct<pid:int,kind:int>>")),
    )
    dealt = docs.select("doc_id", "text", F.explode(places).alias("at")).select("at.*", "doc_id", "text")
    return dealt.repartition(max(1, width // 4), "pid").sortWithinPartitions("pid", "kind", F.desc_nulls_last("doc_id"), "text")


def edited_pairs(spark: SparkSession, docs: DataFrame, bits: int = 256) -> DataFrame:
    """Each document's fingerprint, its edited text's, and their likeness to each other and to the next document."""
    def results(rows: list[tuple]):
        for i in range(0, len(rows), 512):
            part = rows[i:i + 512]
            new = []
            for _, text, following in part:
                cut = len(text) // 3
                new.append((text[:len(text) - cut] + following[:cut]).encode())
            own, changed, after = (fingerprints(*W.joined(x), bits) for x in ([r[1].encode() for r in part], new, [part[-1][2].encode()]))
            following = np.concatenate([own[1:], after])
            for j in range(len(part) - 1):  # the next row need not be the next document
                if part[j][2] is not part[j + 1][1]:
                    following[j] = fingerprints(*W.joined([part[j][2].encode()]), bits)[0]
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in part], pa.int64()), pa.array([len(r[1]) for r in part], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in new]), pa.array(digits(own)), pa.array(digits(changed)),
                pa.array(likeness(own, changed)), pa.array(likeness(own, following)),
            ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches):
        waiting, opening, rows = None, None, []
        for batch in batches:
            for pid, kind, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if waiting and waiting[0] != pid:  # only where no row has a doc_id: the first follows the last
                    rows.append((*waiting[1:], opening))
                    waiting = None
                if waiting:
                    rows.append((*waiting[1:], text))
                elif kind == 0:
                    opening = text
                waiting = (pid, doc_id, text) if kind == 0 else None
            yield from results(rows)
            rows = []
        if waiting:
            yield from results([(*waiting[1:], opening)])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return with_next(spark, picked).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(spark, table(spark, sf_dir, "documents"))
