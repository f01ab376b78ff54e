"""Per-key and global picking: first row, top rows, pages, counts.

Rankings filter on the rank itself, so Spark limits each key before the shuffle
and a hot key never moves more than a few rows per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fjordbook.session import durable


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by ``order``. Null keys form one group."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


#: Rows of one key that a single task may rank.
ONE_TASK = 1_000_000


def ranked_within(df: DataFrame, keys: list[str], order: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """Rows with their rank within their key, however many rows one key has.

    Rows are dealt by ranges of key and order together, so a hot key is cut into as
    many ranges as it fills, by splitters that Spark samples; a row's rank is its place
    in its range after the key's rows in the ranges before. Null keys form one group;
    ``order`` has to tell any two rows of a key apart.
    """
    wanted = [F.asc_nulls_first(k) for k in keys] + list(order)
    dealt = df.repartitionByRange(parts, *wanted) if parts else df.repartitionByRange(*wanted)
    placed = durable(dealt.sortWithinPartitions(*wanted).withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_id", 33))
    key = F.struct(*[F.col(k) for k in keys])
    ranges = placed.groupBy("_part", key.alias("_key")).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a key has a row for each range
    starts = ranges.select("_part", "_key", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    joined = placed.withColumn("_key", key).join(starts, ["_part", "_key"])
    return joined.withColumn(name, (F.col("_before") + F.col("_id") - F.col("_first") + 1).cast("int")).drop("_part", "_key", "_id", "_first", "_before")


def ranked_per_key(df: DataFrame, keys: list[str], order: list[Column], name: str, one_task: int = ONE_TASK) -> DataFrame:
    """All rows with their rank within their key: by a window, or by ranges where a key has more than ``one_task`` rows."""
    most = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most > one_task:
        return ranked_within(df, keys, order, name)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int | None = None, rank: str | None = None, spread: bool = False) -> DataFrame:
    """The first ``k`` rows of each key, optionally with their rank as a column; all rows without a ``k``.

    The filter on the rank limits each key on the map side already, so a hot key
    moves at most ``k`` rows per task; with ``spread``, all rows of
    a hot key are ranked by several tasks (see :func:`ranked_per_key`).
    """
    if k is None and rank and spread:
        return ranked_per_key(df, keys, order, rank)
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    top = ranked if k is None else ranked.filter(F.col(name) <= k)
    return top if rank else top.drop(name)


def lookup(df: DataFrame, dimension: DataFrame, key: str, by: str) -> DataFrame:
    """Left join on a key many rows do not have.

    Rows without a key would all meet in one task; they are spread out by the
    column ``by`` under keys of their own that match nothing. No other column is
    read for it, so the scan below stays pruned.
    """
    nowhere = F.concat(F.lit("\0"), F.pmod(F.xxhash64(by), F.lit(4096)).cast("string"))
    left = df.withColumn("_key", F.coalesce(F.col(key), nowhere))
    right = dimension.withColumnRenamed(key, "_key")
    return left.join(right, "_key", "left").drop("_key")


def _page_bounds(size: int, number: int) -> None:
    if size < 1 or number < 1:
        raise ValueError(f"no page number {number} of size {size}")


def page(df: DataFrame, order: list[Column], size: int = 10, number: int = 1) -> DataFrame:
    """One page plus a probe row: a row more than ``size`` means there is a next page."""
    _page_bounds(size, number)
    return df.orderBy(*order).offset((number - 1) * size).limit(size + 1)


def trimmed_page(df: DataFrame, order: list[Column], size: int = 10, number: int = 1) -> tuple[list, bool]:
    """The rows of one page and whether another follows."""
    rows = page(df, order, size, number).collect()
    return rows[:size], len(rows) > size


def capped_count(df: DataFrame, cap: int) -> DataFrame:
    """``(antall, flere)``: the count up to ``cap``, and whether there is more. Stops early."""
    seen = F.count(F.lit(1))
    return (
        df.select(F.lit(1).alias("_one")).limit(cap + 1)
        .agg(F.least(seen, F.lit(cap)).alias("antall"), (seen > cap).alias("flere"))
    )


def scalar(df: DataFrame, value: Column) -> Column:
    """A one-value aggregate of ``df`` as a scalar subquery."""
    return df.select(value).scalar()


def row_numbers(ordered: DataFrame, name: str) -> DataFrame:
    """An ordered frame with its row numbers from 1, as many sorted partitions as it has.

    Rows are stored with their place in their partition; the partitions' first
    numbers follow from their sizes.
    """
    placed = durable(ordered.withColumn("_id", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return placed.join(starts, part == F.col("_part")).withColumn(name, F.col("_start") + inside + 1).drop("_id", "_part", "_start")
