"""Session defaults and the one place that decides where lineage is cut."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "fjordbook", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs in this package rely on.

    Shuffle partitions are left to adaptive execution on a cluster: a high
    initial count is coalesced at run time, so one setting serves every input.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for scratch tables: the cluster's setting, else one below the session's warehouse."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch")
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a scratch table in the shared checkpoint folder and read it back.

    Cuts lineage between the rounds of an iterative job, and keeps a costly
    intermediate that is read more than once. Being files and not executor
    storage, it survives lost executors; being columnar, later reads are pruned.
    """
    path = f"{checkpoint_root(df.sparkSession)}/scratch-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Within, the shuffles of a query are removed as it ends, so that the next step has their disk."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Send at most ``rows`` rows at once to Python: whole texts are large rows. A smaller setting is kept."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def growing(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is not broadcast: one that grows with the register.

    Spark goes by the size of files, and repetitive ones are many times larger as
    rows: the driver would hold them all.
    """
    return df.hint("merge")


def busy(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it is read in fewer partitions than there are cores, else as it is.

    For costly work per row on a table of a few files; a large table is never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows that one task groups: what its hash table holds does not grow with the input.
TASK_ROWS = 1 << 20


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of about so many ``rows``, dealt by ``keys`` to parts of at most ``TASK_ROWS`` or so.

    For groupings with nearly as many keys as rows: adding up before the shuffle would
    hold a table of all of a task's keys and save nothing, and parts by bytes hold the
    more rows the better these pack. A part that is named by number is not merged again.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)
