"""Run log: when each source was loaded, with what counts, and how it ended."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The counters a run may report; a run's status is kjorer, ok or feilet.
COUNTS = ["lest", "nye", "endret", "uendret", "slettet"]
SCHEMA = (
    "kjoring string, kilde string, startet_at timestamp, ferdig_at timestamp, status string, "
    + ", ".join(f"rader_{c} long" for c in COUNTS)
    + ", varighet_ms long, feilmelding string"
)


class RunLog:
    """Append-only run rows under a shared folder: one when a run starts, one when it ends."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def _append(self, **row) -> None:
        values = [tuple(row.get(column.split()[0]) for column in SCHEMA.split(", "))]
        self.spark.createDataFrame(values, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    @contextmanager
    def run(self, source: str) -> Iterator[dict]:
        """Log a run. The block puts its counts in the yielded dictionary; an exception is logged and raised."""
        key = {"kjoring": uuid.uuid4().hex, "kilde": source, "startet_at": datetime.now(timezone.utc)}
        self._append(**key, status="kjorer")
        counts: dict = {}
        try:
            yield counts
        except Exception as error:
            self._append(**key, **self._ended(key), status="feilet", feilmelding=str(error))
            raise
        self._append(**key, **self._ended(key), status="ok", **{f"rader_{c}": counts[c] for c in COUNTS if c in counts})

    @staticmethod
    def _ended(key: dict) -> dict:
        now = datetime.now(timezone.utc)
        return {"ferdig_at": now, "varighet_ms": int((now - key["startet_at"]).total_seconds() * 1000)}

    def runs(self) -> DataFrame:
        """One row per run: its closing row, or its opening one while it lasts."""
        try:
            rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], SCHEMA)
        ends = F.coalesce("ferdig_at", F.lit(datetime(1970, 1, 1)))
        last = F.max_by(F.struct(*[c for c in rows.columns if c != "kjoring"]), ends)
        return rows.groupBy("kjoring").agg(last.alias("r")).select("kjoring", "r.*")
