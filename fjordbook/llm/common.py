"""What the queries of this subpackage share: tables, global order, running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fjordbook.session import small_batches

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_sum(df: DataFrame, keys: list[str], order: Column, tie: list[Column], value: Column, name: str, bits: int = 12) -> DataFrame:
    """``name``: the sum of ``value`` over the rows of the same keys that come before this one.

    Rows are ordered by the long ``order`` (a hash, so evenly spread) and then by
    ``tie``. Sums are first taken per key and leading bits of ``order``, then over
    those few sums, then inside each bucket: no task gets all rows of a hot key.
    Rows alike in order and tie get their places in any order.
    """
    key = F.struct(*[F.col(f"`{k}`") for k in keys])  # equal where both are null, too
    bucketed = df.withColumn("_key", key).withColumn("_order", order).withColumn("_bucket", F.shiftrightunsigned("_order", 64 - bits)).withColumn("_value", value)
    sums = bucketed.groupBy("_key", "_bucket").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_key", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_key", "_bucket").orderBy("_order", *tie).rowsBetween(Window.unboundedPreceding, -1)
    joined = bucketed.join(starts, ["_key", "_bucket"])
    placed = joined.withColumn(name, F.col("_start") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return placed.drop("_key", "_order", "_bucket", "_value", "_start")


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one, which keeps them apart from names that an operator adds."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])
