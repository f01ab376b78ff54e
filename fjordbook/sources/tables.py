"""Stored tables: versioned snapshots behind a manifest, bucketed tables, year partitions.

A reader always follows the manifest, so a rebuild writes beside the live
version and becomes visible with one appended manifest row.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fjordbook.operators.keyed import first_per_key

MANIFEST_SCHEMA = (
    "navn string, versjon long, sti string, antall long, publisert timestamp, "
    "varighet_ms long, feilmelding string, egenskaper map<string,string>"
)


class TableStore:
    """Tables under one shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._manifest = f"{self.root}/_manifest"

    def manifest_log(self) -> DataFrame:
        """Every publication and failure, oldest first."""
        try:
            return self.spark.read.schema(MANIFEST_SCHEMA).json(self._manifest)
        except AnalysisException:
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)

    def manifest(self) -> DataFrame:
        """The live version of each table. A later failure is reported, the version stays.

        A retired table has no live version.
        """
        log = self.manifest_log()
        order = [F.desc("versjon"), F.desc("publisert"), F.desc("sti")]
        newest = first_per_key(log, ["navn"], *order)
        live = first_per_key(log.filter("sti is not null"), ["navn"], *order)
        gone = newest.filter("sti is null and feilmelding is null").select("navn")
        return live.drop("feilmelding").join(newest.select("navn", "feilmelding"), "navn").join(gone, "navn", "left_anti")

    def next_version(self, name: str) -> int:
        last = self.manifest_log().filter(F.col("navn") == name).agg(F.max("versjon")).first()[0]
        return (last or 0) + 1

    def publish(self, name: str, df: DataFrame, properties: dict[str, str] | None = None) -> DataFrame:
        """Write ``df`` as the next version of ``name`` and make it the live one."""
        return self.publish_together({name: df}, properties)[0]

    def publish_together(self, frames: dict[str, DataFrame], properties: dict[str, str] | None = None) -> list[DataFrame]:
        """Write several tables and make them live at once, with one write of the manifest.

        Each goes to a folder of its own, whoever else publishes meanwhile; a
        failure before the manifest leaves all live versions as they were. Rows are
        counted as they are written.
        """
        rows, stored = [], []
        for name, df in frames.items():
            started = datetime.now(timezone.utc)
            path = f"{self.root}/{name}/{uuid.uuid4().hex}"
            written = Observation()
            df.observe(written, F.count(F.lit(1)).alias("antall")).write.parquet(path, compression="zstd")
            stored.append(self.spark.read.parquet(path))
            rows.append((name, path, written.get["antall"], started, None, properties))
        self._log(*rows)
        return stored

    def fail(self, name: str, message: str) -> None:
        """Record that a rebuild of ``name`` failed; the live version stays."""
        self._log((name, None, None, datetime.now(timezone.utc), message, None))

    def retire(self, name: str) -> None:
        self._log((name, None, None, datetime.now(timezone.utc), None, None))

    def size(self, name: str) -> int:
        """Rows of the live version, as counted when it was written; none if there is no such table."""
        row = self.manifest().filter(F.col("navn") == name).select("antall").first()
        return row.antall if row else 0

    def read(self, name: str) -> DataFrame:
        row = self.manifest().filter(F.col("navn") == name).select("sti").first()
        if row is None:
            raise KeyError(name)
        return self.spark.read.parquet(row.sti)

    def _log(self, *entries: tuple) -> None:
        now = datetime.now(timezone.utc)
        rows = [
            (name, self.next_version(name), path, count, now, int((now - started).total_seconds() * 1000), message, properties or {})
            for name, path, count, started, message, properties in entries
        ]
        self.spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1).write.mode("append").json(self._manifest)


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> DataFrame:
    """Save as a table bucketed and sorted by ``key``: joins and groupings on the key need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return df.sparkSession.table(table)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace exactly the partitions present in ``df`` (a reloaded year) and keep the others."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(by).parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Truncate and load."""
    df.write.mode("overwrite").parquet(path)
