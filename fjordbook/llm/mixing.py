"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over exact block quotas.

Each source's documents are laid end to end in a hashed order and cut into blocks
of equal word count. The target fixes how many blocks a source gives, to the word:
the last block drawn may be drawn in part. A source whose target is above its size
is read a second time. The quotas of all sources are split among the output shards
by a binary tree of multivariate hypergeometric draws, so that every shard is a
fair sample of the mix and the shards' quotas add up exactly. A shard then takes
disjoint runs of each source's permuted blocks and shuffles them locally.

Sources fall into a fixed number of groups by hash. The tree over the groups'
totals is drawn once; each group splits its own share among its sources in its own
task. The draw is exact, and no place sees all sources.

Defined cases: a null text has size 0 and gives nothing; a null source is a source
of its own, last in order; rows alike are rows of their own; rows without a doc_id
take part; an empty table gives an empty mix; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fjordbook.llm.common import WORD, running_sum, table, whole_row
from fjordbook.llm.feistel import permute
from fjordbook.llm.words import lean, spans
from fjordbook.session import durable

#: Weights of the sources in order, repeating; their joint share of all words; most reads of a word.
WEIGHTS, SHARE, READS = (3, 1, 2), 1.5, 2
SHARDS, GROUPS, SEED = 64, 256, 20_240_229
#: A block has at most so many words and a source at least so many blocks, where it has the words.
BLOCK_WORDS, LEAST_BLOCKS = 4096, 64
DRAWS = "array<struct<shard:int,place:long,reading:int,start:long,words:long>>"


def with_rank(df: DataFrame, *order) -> DataFrame:
    """``df`` with its row number from 0 as ``_rank``, counted per sorted partition and not in one task."""
    placed = durable(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows")).select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(starts, part == F.col("_part")).withColumn("_rank", F.col("_start") + inside).drop("_id", "_part", "_start")


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, reads: int = READS) -> DataFrame:
    """``(source, source_size, target)``: words wanted of each source, none above ``reads`` times its size.

    Every uncapped source gets its weight times one common rate. Each round caps
    the sources that the rate takes over their limit and raises the rate for the
    others; only the two sums of a round come to the driver.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = durable(with_rank(sums, F.col("source").asc_nulls_last()).withColumn("weight", weight).drop("_rank"))
    limit = F.col("source_size") * F.lit(float(reads))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    rate = 0.0
    while True:
        over = F.col("weight") * F.lit(rate) >= limit
        capped, free = ranked.agg(F.sum(F.when(over, limit).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        new = max(0.0, share * total - (capped or 0.0)) / free if free else rate
        if new <= rate * (1 + 1e-12):
            break
        rate = new
    return ranked.select("source", "source_size", F.least(limit, F.col("weight") * F.lit(rate)).alias("target"))


def split(colours: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Deal ``colours[i]`` balls of each colour to leaves of the given ``sizes``: the tree of hypergeometric draws."""
    if len(sizes) == 1:
        return colours[:, None].copy()
    middle = len(sizes) // 2
    left = rng.multivariate_hypergeometric(colours, int(sizes[:middle].sum()), method="marginals") if colours.sum() else colours * 0
    return np.hstack([split(left, sizes[:middle], rng), split(colours - left, sizes[middle:], rng)])


def quotas(wanted: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Per source: block length, block draws in the first and second reading, and the first draw of each shard."""
    total = wanted.agg(F.sum("source_size")).first()[0] or 0
    longest = max(BLOCK_WORDS, total >> 28)  # keeps the number of blocks within what can be drawn exactly
    blocked = (
        wanted.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(longest), F.floor(F.col("source_size") / LEAST_BLOCKS))).cast("long"))
        .withColumn("key", F.xxhash64(F.lit(seed), F.col("source")))
        .withColumn("group", F.pmod("key", F.lit(GROUPS)).cast("int"))
        .withColumn("words", F.round("target").cast("long"))
    )

    def drawn(rows: pd.DataFrame) -> np.ndarray:
        n = rows["source_size"].to_numpy()
        words, block, key = rows["words"].to_numpy(), rows["block"].to_numpy(), rows["key"].to_numpy()
        out = np.zeros((len(rows), 2), np.int64)
        for reading in (0, 1):
            part = np.clip(words - reading * n, 0, n)
            out[:, reading] = draws_for(part, n, block, key, reading)
        return out

    def counted(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"group": [rows["group"].iloc[0]], "draws": [int(drawn(rows).sum())]})

    columns = ["source", "source_size", "target", "words", "block", "key", "group"]
    sums = blocked.groupBy("group").applyInPandas(counted, "group int, draws long").collect()  # at most GROUPS rows
    by_group = np.zeros(GROUPS, np.int64)
    for row in sums:
        by_group[row["group"]] = row["draws"]
    even = by_group.sum() // shards + (np.arange(shards) < by_group.sum() % shards)
    dealt = split(by_group, even, np.random.default_rng(seed))

    def own_split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", kind="stable").reset_index(drop=True)
        n = drawn(rows)
        group = int(rows["group"].iloc[0])
        parts = split(n.sum(1), dealt[group], np.random.default_rng([seed, group]))
        rows["first"], rows["second"] = n[:, 0], n[:, 1]
        rows["shards"] = list(np.cumsum(parts, axis=1))
        return rows[["source", "source_size", "target", "words", "block", "key", "first", "second", "shards"]]

    schema = "source string, source_size long, target double, words long, block long, key long, first long, second long, shards array<long>"
    return blocked.select(*columns).groupBy("group").applyInPandas(own_split, schema)


def _reading_key(key: np.ndarray, reading: int) -> np.ndarray:
    return key.astype(np.int64).view(np.uint64) + np.uint64(reading)


def _short_place(n: np.ndarray, block: np.ndarray, key: np.ndarray, reading: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the last, maybe shorter block stands in the permuted order, and how much it lacks."""
    blocks = np.maximum(-(-n // block), 1)
    return permute(blocks - 1, blocks, _reading_key(key, reading)).astype(np.int64), np.where(n > 0, blocks * block - n, 0)


def draws_for(words: np.ndarray, n: np.ndarray, block: np.ndarray, key: np.ndarray, reading: int) -> np.ndarray:
    """How many permuted blocks hold the first ``words`` words of the reading."""
    place, lack = _short_place(n, block, key, reading)
    plain = -(-words // block)  # had all blocks the full length
    with_short = -(-(words + lack) // block)
    return np.where(words <= 0, 0, np.where(plain <= place, plain, np.maximum(with_short, place + 1)))


def pieces(batch: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Drawn pieces of a batch's documents: ``(row, shard, place, reading, start, words)`` of each."""
    size, at, block = (batch[c].to_numpy(np.int64) for c in ("size", "at", "block"))
    low, high = at // block, np.where(size > 0, (at + size - 1) // block, at // block - 1)
    row = np.repeat(np.arange(len(batch)), high - low + 1)
    index = np.arange(len(row)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[row]
    n, key, words = (batch[c].to_numpy(np.int64)[row] for c in ("source_size", "key", "words"))
    first = batch["first"].to_numpy(np.int64)[row]
    width, blocks = block[row], -(-n // block[row])
    bounds = np.stack(batch["shards"].to_numpy()) if len(batch) else np.zeros((0, 1), np.int64)
    found = []
    for reading in (0, 1):
        wanted = np.clip(words - reading * n, 0, n)
        place = permute(index, np.maximum(blocks, 1), _reading_key(key, reading)).astype(np.int64)
        short, lack = _short_place(n, width, key, reading)
        before = place * width - np.where(place > short, lack, 0)
        here = np.minimum(np.where(index == blocks - 1, width - lack, width), wanted - before)  # words drawn of this block
        start = np.maximum(index * width, at[row])
        end = np.minimum(index * width + np.maximum(here, 0), (at + size)[row])
        took = np.flatnonzero(end > start)
        draw = place + reading * first
        shard = (bounds[row[took]] <= draw[took, None]).sum(1)
        found.append((row[took], shard, draw[took], np.full(len(took), reading), (start - at[row])[took], (end - start)[took]))
    out = [np.concatenate(x) for x in zip(*found, strict=True)]
    order = np.lexsort([out[4], out[3], out[0]])
    return tuple(x[order] for x in out)


def laid_out(sized: DataFrame, seed: int = SEED) -> DataFrame:
    """``sized`` with each document's place ``at`` in its source, in words, in an order by hash."""
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    return running_sum(sized, ["source"], order, [F.col("doc_id"), F.col("size")], F.col("size"), "at")


def _drawing(sized: DataFrame, shards: int, seed: int, **rule) -> tuple[DataFrame, Callable, T.StructType]:
    """The rows that :func:`mix` draws from, the function over their batches that draws, and its schema."""
    plan = durable(quotas(targets(sized.select("source", "size"), **rule), shards, seed))
    placed = laid_out(sized, seed)
    known = plan.withColumnRenamed("source", "_source")
    rows = placed.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    kept = [c for c in sized.columns]
    made = {"source_size": "long", "target": "double", "taken": "long", "draws": DRAWS}

    def run(batches):
        for batch in batches:
            frame = batch.select(["size", "at", "source_size", "block", "key", "words", "first", "shards"]).to_pandas()
            row, shard, place, reading, start, words = pieces(frame)
            taken = np.bincount(row, words, minlength=len(frame)).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(frame)))])
            flat = pa.StructArray.from_arrays(
                [pa.array(shard, pa.int32()), pa.array(place, pa.int64()), pa.array(reading, pa.int32()), pa.array(start, pa.int64()), pa.array(words, pa.int64())],
                ["shard", "place", "reading", "start", "words"])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), batch.column("source_size"), batch.column("target"), pa.array(taken), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)],
                [*kept, *made])

    schema = T.StructType([*sized.schema.fields])
    for name, kind in made.items():
        schema = schema.add(name, T.DataType.fromDDL(kind))
    return rows, run, schema


def mix(sized: DataFrame, shards: int = SHARDS, seed: int = SEED, **rule) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken, draws)`` of every row of ``(doc_id, source, size)``.

    ``draws`` lists the pieces taken: output shard, place of the draw in its source,
    reading (0, 1), first word and number of words. A column ``row`` is passed on.
    """
    rows, run, schema = _drawing(sized, shards, seed, **rule)
    return rows.mapInArrow(lean(run), schema)


def mixed_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, **rule) -> DataFrame:
    """The mix as documents: a row for each reading of a document, with the words drawn in it.

    A document read whole keeps its text as it is. Of one read in part, drawn runs
    of words keep the text between them and are put on lines of their own. Columns
    are those of ``docs``; ``n_chars`` follows the text. Pieces are drawn and texts
    cut in one Python worker of a task.
    """
    drawn, draw, schema = _drawing(docs.select(*sized_columns(), whole_row(docs).alias("row")), shards, seed, **rule)
    field = docs.columns.index("text")

    def run(batches):
        for batch in draw(batches):
            texts, sizes = pc.struct_field(batch.column("row"), [field]), batch.column("size").to_pylist()
            at, out = [], []
            for i, draws in enumerate(batch.column("draws").to_pylist()):
                for reading in sorted({d["reading"] for d in draws}):
                    mine = [(d["start"], d["words"]) for d in draws if d["reading"] == reading]
                    text = texts[i].as_py()
                    if sum(n for _, n in mine) < sizes[i]:
                        raw = text.encode()
                        starts, ends, _ = spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                        runs = []
                        for start, n in mine:
                            if runs and runs[-1][1] == start:
                                runs[-1][1] = start + n
                            else:
                                runs.append([start, start + n])
                        text = "\n".join(raw[starts[a]:ends[b - 1]].decode() for a, b in runs)
                    at.append(i)
                    out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(at, pa.int64())), pa.array(out, pa.string())], ["row", "body"])

    rows = drawn.mapInArrow(lean(run), T.StructType([schema["row"]]).add("body", "string"))
    own = {"text": F.col("body"), "n_chars": F.char_length("body").cast("long")}
    return rows.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def shards_in_order(mixed: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per drawn piece, each shard in a partition range of its own and shuffled inside."""
    flat = mixed.select("doc_id", "source", F.explode("draws").alias("draw")).select("doc_id", "source", "draw.*")
    order = F.xxhash64(F.lit(seed), "shard", "source", "place")
    return flat.withColumn("_order", order).repartitionByRange(shards, "shard", "_order").sortWithinPartitions("shard", "_order", "doc_id", "start").drop("_order")


def sized_columns() -> list[Column]:
    """``doc_id``, ``source`` and ``size`` in words, of documents."""
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size")]


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = durable(table(spark, sf_dir, "documents").select(*sized_columns()))
    mixed = mix(sized)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.col("draws.shard").alias("shards"))
