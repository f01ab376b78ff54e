"""Reconciling snapshots: content-hash upsert, missing and deleted, role history, deltas.

Each function reads only the tables as they were before the run and returns the
tables as they should be after it, so a retried or repeated run gives the same
result.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fjordbook.functions.hashing import content_hash, role_fingerprint
from fjordbook.operators.keyed import first_per_key
from fjordbook.schema import DELETION_TYPES, ORG
from fjordbook.session import growing

STATE = {"savnet_siden": "date", "slettet_dato": "date"}
GRACE_DAYS = 7


def add_content_hash(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.withColumn("content_hash", content_hash(columns or df.columns))


def _with_state(df: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast(t) for c, t in STATE.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def _side_by_side(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    old = _with_state(current).select(F.col(key), F.struct(*_with_state(current).columns).alias("old"))
    new = incoming.select(F.col(key), F.struct(*incoming.columns).alias("new"))
    return old.join(new, key, "full_outer")


def _outcome() -> Column:
    """What a row of the outer join is: ny, endret, uendret or fravaerende (absent)."""
    same = F.col("old.content_hash").eqNullSafe(F.col("new.content_hash"))
    return (
        F.when(F.col("old").isNull(), "ny")
        .when(F.col("new").isNull(), "fravaerende")
        .when(same, "uendret")
        .otherwise("endret")
    )


def one_per_key(rows: DataFrame, key: str = ORG) -> tuple[DataFrame, DataFrame]:
    """``(rows, others)``: one row per key, that of the least content hash, and the rows that lost or have no key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("content_hash"))
    ranked = rows.withColumn("_plass", F.when(F.col(key).isNotNull(), place))
    first = F.coalesce(F.col("_plass") == 1, F.lit(False))
    return ranked.filter(first).drop("_plass"), ranked.filter(~first).drop("_plass")


def load_snapshot(
    current: DataFrame, incoming: DataFrame, as_of: date, key: str = ORG, grace_days: int = GRACE_DAYS,
    rejected: DataFrame | None = None,
) -> DataFrame:
    """The table after a full load, with ``utfall`` telling what happened to each row.

    One full outer join does the upsert and the deletion marks together. A row
    whose hash is unchanged keeps its stored values, and so does one that the
    load holds only among the ``rejected`` keys: it is present, ``avvist``, and
    not missing. Rows are never removed.
    """
    sides = _side_by_side(current, incoming, key).withColumn("utfall", _outcome())
    if rejected is not None:
        named = rejected.filter(F.col(key).isNotNull()).select(key).distinct().withColumn("_avvist", F.lit(True))
        there = F.col("utfall").eqNullSafe("fravaerende") & F.col("_avvist").isNotNull()
        sides = sides.join(growing(named), key, "left").withColumn("utfall", F.when(there, "avvist").otherwise(F.col("utfall"))).drop("_avvist")
    keep_old = F.col("utfall").isin("uendret", "fravaerende", "avvist")
    missing_since, deleted_on = _deletion_marks(
        F.col("utfall") != "fravaerende", F.col("old.savnet_siden"), F.col("old.slettet_dato"), as_of, grace_days
    )
    columns = [
        F.when(keep_old, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c)
        for c in incoming.columns if c != key
    ]
    return sides.select(key, *columns, missing_since.alias("savnet_siden"), deleted_on.alias("slettet_dato"), "utfall")


def hash_upsert(current: DataFrame, incoming: DataFrame, key: str = ORG) -> tuple[DataFrame, DataFrame]:
    """Insert new keys, replace rows whose hash differs: ``(snapshot, counts)``."""
    outcome = _side_by_side(current, incoming, key).withColumn("utfall", _outcome())
    keep_old = F.col("utfall").isin("uendret", "fravaerende")
    columns = [
        F.when(keep_old, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c)
        for c in incoming.columns if c != key
    ]
    return outcome.select(key, *columns, "utfall"), load_counts(outcome)


def load_counts(loaded: DataFrame) -> DataFrame:
    """Rows read, new, changed and unchanged of a loaded snapshot."""
    return loaded.agg(*load_counters())


def load_counters() -> list[Column]:
    """The aggregates of :func:`load_counts`, to be counted while a snapshot is written."""
    return [
        F.count_if(F.col("utfall") != "fravaerende").alias("lest"),
        F.count_if(F.col("utfall") == "ny").alias("nye"),
        F.count_if(F.col("utfall") == "endret").alias("endret"),
        F.count_if(F.col("utfall") == "uendret").alias("uendret"),
    ]


def _deletion_marks(present: Column, missing: Column, deleted: Column, as_of: date, grace: int) -> tuple[Column, Column]:
    """New (savnet_siden, slettet_dato) from the old marks only.

    Absent rows are first marked missing and are confirmed deleted once missing
    for ``grace`` days; a row first marked today is therefore not confirmed
    today. Present rows lose both marks.
    """
    today = F.lit(as_of)
    since = F.when(present, None).when(missing.isNull() & deleted.isNull(), today).otherwise(missing)
    overdue = missing <= F.date_sub(today, grace)
    gone = F.when(present, None).when(deleted.isNull() & overdue, today).otherwise(deleted)
    return since, gone


def reconcile_deletions(
    current: DataFrame, incoming: DataFrame, as_of: date, key: str = ORG, grace_days: int = GRACE_DAYS
) -> DataFrame:
    """``current`` with its deletion marks moved on by one full snapshot.

    ``overgang`` names the change: savnet, bekreftet, tilbake or null.
    """
    seen = incoming.select(key).distinct().withColumn("_seen", F.lit(True))
    rows = _with_state(current).join(seen, key, "left")
    present = F.col("_seen").isNotNull()
    since, gone = _deletion_marks(present, F.col("savnet_siden"), F.col("slettet_dato"), as_of, grace_days)
    marked = F.col("savnet_siden").isNotNull() | F.col("slettet_dato").isNotNull()
    change = (
        F.when(present & marked, "tilbake")
        .when(~present & ~marked, "savnet")
        .when(~present & F.col("slettet_dato").isNull() & gone.isNotNull(), "bekreftet")
    )
    return rows.withColumns({"overgang": change, "savnet_siden": since, "slettet_dato": gone}).drop("_seen")


def soft_delete(current: DataFrame, keys: DataFrame, as_of: date, key: str = ORG) -> DataFrame:
    """Mark the listed keys deleted as of today, unless they already are."""
    listed = keys.select(key).distinct().withColumn("_listed", F.lit(True))
    mark = F.when(F.col("slettet_dato").isNull() & F.col("_listed").isNotNull(), F.lit(as_of))
    rows = _with_state(current).join(listed, key, "left")
    return rows.withColumn("slettet_dato", F.coalesce("slettet_dato", mark)).drop("_listed")


def apply_changes(current: DataFrame, documents: DataFrame, deleted: DataFrame, as_of: date, key: str = ORG) -> DataFrame:
    """The table after a batch of changed documents and deletions.

    A document replaces the whole row, clears both deletion marks, and clears
    the content hash so the next full load writes the row again. A deletion of
    an unknown company is ignored. The table is shuffled once.
    """
    current = _with_state(current)
    new = documents.select(key, F.struct(*documents.columns).alias("new"))
    gone = deleted.select(key).distinct().withColumn("_gone", F.lit(True))
    old = current.select(key, F.struct(*current.columns).alias("old"))
    rows = old.join(new.join(gone, key, "full_outer"), key, "full_outer").filter("old is not null or new is not null")

    replaced = F.col("new").isNotNull()
    values = {}
    for c in current.columns:
        fresh = F.col(f"new.{c}") if c in documents.columns and c not in (*STATE, "content_hash") else F.lit(None)
        values[c] = F.when(replaced, fresh).otherwise(F.col(f"old.{c}")).cast(current.schema[c].dataType)
    values["slettet_dato"] = F.coalesce(values["slettet_dato"], F.when(F.col("_gone"), F.lit(as_of)))
    return rows.select(key, *[v.alias(c) for c, v in values.items() if c != key])


def upsert_reference(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Small reference table: incoming rows win, rows no longer listed stay."""
    return incoming.unionByName(current.join(incoming.select(key), key, "left_anti"), allowMissingColumns=True)


ROLE_HISTORY_DROPS = ["avregistrert", "rollegruppe_sist_endret", "person_er_doed", "innehaver_er_slettet", "rolle_nokkel"]


def reconcile_scd2(
    current: DataFrame, history: DataFrame, incoming: DataFrame, as_of: date, mark: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Roles after a full snapshot: ``(current, history)``.

    Roles that vanished move to history with the day they were last seen; new
    ones get the day they were first seen; the rest keep theirs. Attributes
    outside the fingerprint (such as a deregistration mark) are refreshed. ``mark``
    names a column that tells the new ones.
    """
    incoming = incoming.withColumn("rolle_nokkel", role_fingerprint())
    current = current.withColumn("rolle_nokkel", role_fingerprint())
    fingerprint = ["rolle_nokkel"]

    ended = current.join(growing(incoming.select(*fingerprint)), fingerprint, "left_anti")
    archived = ended.withColumn("sist_sett", F.lit(as_of)).drop(*ROLE_HISTORY_DROPS)
    first_seen = current.groupBy(*fingerprint).agg(F.min("forst_sett").alias("_first"))
    kept = incoming.join(growing(first_seen), fingerprint, "left")
    marked = kept.withColumn(mark, F.col("_first").isNull()) if mark else kept
    now = marked.withColumn("forst_sett", F.coalesce("_first", F.lit(as_of))).drop("_first", *fingerprint)
    return now, history.unionByName(archived, allowMissingColumns=True)


def opened_roles(current: DataFrame, incoming: DataFrame) -> DataFrame:
    incoming = incoming.withColumn("rolle_nokkel", role_fingerprint())
    return incoming.join(current.select(role_fingerprint().alias("rolle_nokkel")), "rolle_nokkel", "left_anti")


def closed_roles(current: DataFrame, incoming: DataFrame) -> DataFrame:
    return opened_roles(incoming, current)


def last_changes(feed: DataFrame) -> DataFrame:
    """The last change per company, with the id it came from and whether it is a deletion."""
    carried = [c for c in feed.columns if c not in (ORG, "oppdateringsid")]
    newest = [F.max_by(c, "oppdateringsid").alias(c) for c in carried]
    last = feed.groupBy(ORG).agg(F.max("oppdateringsid").alias("oppdateringsid"), *newest)
    return last.withColumn("slettes", F.col("endringstype").isin(*DELETION_TYPES))


def next_change_batch(feed: DataFrame, cursor: int, max_keys: int) -> tuple[DataFrame, DataFrame]:
    """``(batch, cursor)``: events after ``cursor`` up to the first event of company number ``max_keys`` + 1.

    Repeats of a company already in the batch are free. Stopping at an event,
    not a company, means the new cursor (the largest id of the batch, with its
    time if the feed has times; the old one if the batch is empty) skips nothing.
    """
    after = feed.filter(F.col("oppdateringsid") > cursor)
    first_seen = after.groupBy(ORG).agg(F.min("oppdateringsid").alias("forste"))
    beyond = first_seen.orderBy("forste").offset(max_keys).limit(1)
    stop = beyond.select(F.min("forste")).scalar()
    batch = after.filter(stop.isNull() | (F.col("oppdateringsid") < stop))
    time = [F.max_by("dato", "oppdateringsid").alias("siste_tid")] if "dato" in feed.columns else []
    return batch, batch.agg(F.coalesce(F.max("oppdateringsid"), F.lit(cursor)).alias("siste_id"), *time)


def seed_cursor(feed: DataFrame, day: date) -> DataFrame:
    """The cursor that replays everything from ``day`` on: one before its first event."""
    return feed.filter(F.col("dato") >= F.lit(day)).agg((F.min("oppdateringsid") - 1).alias("siste_id"))


def latest_run_per_source(runs: DataFrame) -> DataFrame:
    return first_per_key(runs, ["kilde"], F.desc("startet_at"), F.desc("status"))
