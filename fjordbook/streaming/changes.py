"""The change feed as a stream: resumable, replayable, and with nothing lost on the way.

Each micro-batch is reduced to the last change per company and written as one
partition of a change log, overwritten when the batch is replayed. The log is
merged over the stored companies when they are read, so the cost of a batch
follows the number of changes and not the size of the register.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fjordbook.operators.conversations import rate_windows
from fjordbook.operators.reconcile import apply_changes, last_changes
from fjordbook.schema import ORG
from fjordbook.session import durable
from fjordbook.sources.files import company_documents
from fjordbook.sources.tables import TableStore

FEED = f"oppdateringsid long, dato timestamp, {ORG} string, endringstype string"
LOG = f"{ORG} string, oppdateringsid long, dato timestamp, endringstype string, slettes boolean, doc string, batch_id long"
COMPLETED = "siste_id long, siste_tid timestamp, batch_id long"
COMPLETED_ROW = "batch_id long, siste_id long, siste_tid timestamp"


def _log(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LOG).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], LOG)


def write_batch(events: DataFrame, batch_id: int, documents: DataFrame, out: str) -> None:
    """Append one micro-batch to the change log under ``out``.

    ``documents`` has the company key and its current document as text. A
    changed company without a document goes to the dead letters and is tried
    again with the next batch; the feed itself moves on. The batch is complete
    with its row in ``ferdig``, which tells how far the feed has come.
    """
    spark = events.sparkSession
    waiting = _log(spark, f"{out}/venter").filter(F.col("batch_id") == batch_id - 1)
    columns = ["oppdateringsid", "dato", ORG, "endringstype"]
    last = last_changes(events.select(*columns).unionByName(waiting.select(*columns)))
    found = durable(last.join(documents.select(ORG, "doc"), ORG, "left"))  # once: documents may land meanwhile
    lost = ~F.col("slettes") & F.col("doc").isNull()
    done = found.filter(~lost).withColumn("doc", F.when(~F.col("slettes"), F.col("doc")))
    reached = found.agg(F.max("oppdateringsid").alias("siste_id"), F.max_by("dato", "oppdateringsid").alias("siste_tid"))
    for rows, name in ((done, "endringer"), (found.filter(lost), "venter"), (reached, "ferdig")):
        rows.write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")


def start_change_stream(
    feed: DataFrame, documents: Callable[[], DataFrame], out: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Follow the feed. ``documents`` is called per batch, so it sees newly landed documents.

    The checkpoint is the cursor: a stopped stream goes on where it was, however
    long the gap, and a batch interrupted half-way is done again.
    """
    def batch(events: DataFrame, batch_id: int) -> None:
        write_batch(events, batch_id, documents(), out)

    writer = feed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


@dataclass(frozen=True)
class Epoch:
    """What a compaction has taken into the stored table: all batches up to ``upto``, the feed up to ``siste_id``."""

    number: int = 0
    upto: int = -1
    siste_id: int | None = None
    siste_tid: datetime | None = None


def epoch_of(store: TableStore, name: str = "enheter") -> Epoch:
    """The epoch of the live version of a compacted table; the zeroth if it never was compacted."""
    row = store.manifest().filter(F.col("navn") == name).select("egenskaper").first()
    stated = (row.egenskaper if row else None) or {}
    if "epoke" not in stated:
        return Epoch()
    time = stated.get("siste_tid")
    return Epoch(int(stated["epoke"]), int(stated["upto"]), int(stated["siste_id"]) if stated["siste_id"] else None, datetime.fromisoformat(time) if time else None)


def completed(spark: SparkSession, out: str) -> DataFrame:
    """``(batch_id, siste_id, siste_tid)`` of the batches that are wholly written."""
    try:
        return spark.read.schema(COMPLETED).parquet(f"{out}/ferdig")
    except AnalysisException:
        return spark.createDataFrame([], COMPLETED)


def _between(spark: SparkSession, out: str, epoch: Epoch, upto: int | None = None) -> DataFrame:
    rows = _log(spark, f"{out}/endringer").filter(F.col("batch_id") > epoch.upto)
    return rows if upto is None else rows.filter(F.col("batch_id") <= upto)


def logged_changes(spark: SparkSession, out: str, epoch: Epoch = Epoch(), upto: int | None = None) -> DataFrame:
    """The last logged change per company over all batches after the epoch."""
    newest = F.max_by(F.struct("endringstype", "slettes", "doc"), "oppdateringsid")
    rows = _between(spark, out, epoch, upto).groupBy(ORG).agg(F.max("oppdateringsid").alias("oppdateringsid"), newest.alias("r"))
    return rows.select(ORG, "oppdateringsid", "r.*")


def waiting(spark: SparkSession, out: str) -> DataFrame:
    """Changed companies still without a document: the dead letters of the newest batch."""
    newest = completed(spark, out).select(F.max("batch_id")).scalar()
    return _log(spark, f"{out}/venter").filter(F.col("batch_id") == newest).select(ORG, "oppdateringsid", "endringstype")


def cursor(spark: SparkSession, out: str, epoch: Epoch = Epoch()) -> DataFrame:
    """How far the feed has come: the largest event accounted for, and its time, in the log or the epoch."""
    known = spark.createDataFrame([(epoch.upto, epoch.siste_id, epoch.siste_tid)], COMPLETED_ROW).select("siste_id", "siste_tid")
    events = completed(spark, out).select("siste_id", "siste_tid").unionByName(known)
    return events.agg(F.max("siste_id").alias("siste_id"), F.max_by("siste_tid", "siste_id").alias("siste_tid"))


def current_companies(base: DataFrame, out: str, as_of: date, epoch: Epoch = Epoch(), upto: int | None = None) -> DataFrame:
    """The stored companies, which hold the changes of ``epoch``, with those logged after it applied."""
    changes = logged_changes(base.sparkSession, out, epoch, upto)
    documents, _ = company_documents(changes.filter(~F.col("slettes")))
    return apply_changes(base, documents, changes.filter("slettes"), as_of)


def rejected_changes(spark: SparkSession, out: str, epoch: Epoch = Epoch(), upto: int | None = None) -> DataFrame:
    """Logged documents that cannot be applied, with the columns at fault; their companies keep what is stored."""
    changes = logged_changes(spark, out, epoch, upto).filter(~F.col("slettes"))
    return company_documents(changes)[1].select(ORG, "feil_kolonner")


def compact(base: DataFrame, out: str, as_of: date, store: TableStore, name: str = "enheter") -> Epoch:
    """Publish the companies with all completed batches applied, as the next epoch.

    ``base`` is the live table, or what the log started from. The batches taken in are
    fixed first, and what becomes live is one manifest row with table, epoch and
    cursor: a batch that lands meanwhile comes after the epoch and is read on top of
    it. Nothing is overwritten or deleted; batches up to the epoch can be removed by a
    retention rule, but for the newest, whose dead letters the next batch tries again.
    Documents that cannot be applied go to ``<name>_endringer_avvist`` and stay there
    until their company changes again.
    """
    spark = base.sparkSession
    before = epoch_of(store, name)
    last = completed(spark, out).agg(F.max("batch_id").alias("batch_id")).first().batch_id
    if last is None or last <= before.upto:
        return before
    ends = completed(spark, out).filter(F.col("batch_id") <= last)
    reached = ends.agg(F.max("siste_id").alias("siste_id"), F.max_by("siste_tid", "siste_id").alias("siste_tid")).first()
    after = Epoch(before.number + 1, last, *max(((e.siste_id, e.siste_tid) for e in (before, reached)), key=lambda e: -1 if e[0] is None else e[0]))
    wrong = rejected_changes(spark, out, before, last)
    aside = f"{name}_endringer_avvist"
    try:
        changed = _between(spark, out, before, last).select(ORG).distinct()
        wrong = store.read(aside).join(changed, ORG, "left_anti").unionByName(wrong)
    except KeyError:
        pass
    stated = {"epoke": str(after.number), "upto": str(last), "siste_id": "" if after.siste_id is None else str(after.siste_id), "siste_tid": after.siste_tid.isoformat() if after.siste_tid else ""}
    store.publish_together({name: current_companies(base, out, as_of, before, last), aside: wrong}, stated)
    return after


def start_rate_stream(events: DataFrame, out: str, checkpoint: str, limit: int = 60, width: str = "1 minute",
                      delay: str = "2 minutes", **trigger) -> StreamingQuery:
    """Closed request windows, appended as they close; state is kept for ``delay`` only."""
    counted = rate_windows(events, limit, width, watermark=delay)
    writer = counted.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
