"""The change feed as a source of Spark's: offsets are event ids, batches end at a number of companies.

A batch takes events in order of their ids, up to the first event of one
company more than the batch may hold. Repeats of a company already in it are free.
Where a batch ends follows from where it begins, so a batch that is done again holds
the same events. The driver reads ids and companies to find that end; the events
themselves are read by the tasks, a row group each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from fjordbook.schema import ORG

ID, COLUMNS = "oppdateringsid", ["oppdateringsid", "dato", ORG, "endringstype"]
SCHEMA = pa.schema([(ID, pa.int64()), ("dato", pa.timestamp("us", "UTC")), (ORG, pa.string()), ("endringstype", pa.string())])


def in_utc(rows: pa.Table) -> pa.Table:
    """Times to the microsecond, those without a zone as UTC."""
    time = rows.column("dato")
    time = time.cast(pa.timestamp("us", time.type.tz), safe=False)
    return rows.set_column(1, "dato", pc.assume_timezone(time, "UTC") if time.type.tz is None else time)


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


class Pages:
    """Events of the Parquet files of a folder by ascending id, a page at a time.

    Row groups are taken by the ids that their statistics state, so of a feed landed in
    order only those of the page are read.
    """

    def __init__(self, path: str):
        self.files, root = _located(path)
        found = self.files.get_file_info(fs.FileSelector(root, recursive=True))
        self.paths = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".parquet") and not f.base_name.startswith(("_", ".")))
        self.groups = sorted(g for p in self.paths for g in self._groups(p))

    def _groups(self, path: str) -> Iterator[tuple[int, int, str, int]]:
        with self.files.open_input_file(path) as source:
            meta = pq.ParquetFile(source).metadata
            column = meta.schema.to_arrow_schema().names.index(ID)
            for i in range(meta.num_row_groups):
                stats = meta.row_group(i).column(column).statistics
                if meta.row_group(i).num_rows:
                    yield (stats.min, stats.max, path, i) if stats is not None and stats.has_min_max else (-(1 << 63), (1 << 63) - 1, path, i)

    def read(self, path: str, group: int, columns: list[str]) -> pa.Table:
        with self.files.open_input_file(path) as source:
            return pq.ParquetFile(source).read_row_group(group).select(columns)

    def ordered(self, cursor: int, columns: list[str] = COLUMNS) -> Iterator[pa.Table]:
        """All events with ids above ``cursor`` by id; each row group is read once, and held until those that overlap it are."""
        held, groups = None, [g for g in self.groups if g[1] > cursor]
        for at, (_, _, path, group) in enumerate(groups):
            rows = self.read(path, group, columns)
            rows = rows.filter(pc.greater(rows.column(ID), cursor))
            rows = in_utc(rows) if "dato" in columns else rows
            held = (rows if held is None else pa.concat_tables([held, rows], promote_options="permissive")).sort_by(ID)
            done = len(held) if at + 1 == len(groups) else int(np.searchsorted(held.column(ID).to_numpy(), groups[at + 1][0]))
            yield held.slice(0, done)
            held = held.slice(done)

    def after(self, cursor: int, size: int) -> pa.Table:
        """The ``size`` events with the least ids above ``cursor``."""
        found, n = [pa.table({c: [] for c in COLUMNS})], 0
        for rows in self.ordered(cursor):
            found = [*found, rows] if n else [rows]
            n += len(rows)
            if n >= size:
                break
        return pa.concat_tables(found, promote_options="permissive").slice(0, size)


class FeedReader:
    """Batches of at most ``companies`` companies; the offset is the last event taken."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.start = int(options.get("start", -1))
        self.companies = int(options["companies"]) if "companies" in options else None
        self.page = int(options.get("page", 10_000))

    def initialOffset(self) -> dict:  # noqa: N802  the name that Spark calls
        return {"id": self.start}

    def _chunks(self, start: int, seen: list[pa.Array]) -> Iterator[pa.Table]:
        """Ids and companies, a page or as many rows as there are companies ``seen`` at once, so that all looking up stays linear."""
        held: list[pa.Table] = []
        for rows in Pages(self.path).ordered(start, [ID, ORG]):
            held.append(rows)
            if sum(map(len, held)) >= max(self.page, len(seen[0])):
                yield pa.concat_tables(held, promote_options="permissive")
                held = []
        if held:
            yield pa.concat_tables(held, promote_options="permissive")

    def end(self, start: dict) -> dict:
        """The last event of the batch that begins after ``start``. Of the feed, only the companies of the batch are held."""
        seen, end = [pa.array([], pa.string())], start["id"]
        for rows in self._chunks(start["id"], seen):
            stop, keys = len(rows), rows.column(ORG).cast(pa.string()).combine_chunks()
            if self.companies is not None:
                new = pc.invert(pc.is_in(keys, value_set=seen[0]))
                codes = keys.filter(new).dictionary_encode(null_encoding="encode")  # numbered by their first event
                room = self.companies - len(seen[0])
                if len(codes.dictionary) > room:
                    at = int(np.flatnonzero(codes.indices.to_numpy() == room)[0])
                    stop = int(np.flatnonzero(new.to_numpy(zero_copy_only=False))[at])
                seen[0] = pa.concat_arrays([seen[0], codes.dictionary])
            if stop:
                end = rows.column(ID)[stop - 1].as_py()
            if stop < len(rows):
                break
        return {"id": end}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = self.end(start)
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        """The events of a batch in order, as tuples."""
        for rows in Pages(self.path).ordered(start["id"]):
            rows = rows.filter(pc.less_equal(rows.column(ID), end["id"]))
            if not len(rows):
                return
            for page in rows.to_batches(self.page):
                yield from zip(*(page.column(c).to_pylist() for c in COLUMNS), strict=True)


class RowGroup(InputPartition):
    """The events of one row group with ids above ``start`` and up to ``end``."""

    def __init__(self, path: str, group: int, start: int, end: int):
        self.path, self.group, self.start, self.end = path, group, start, end


class FeedStream(DataSourceStreamReader):
    """Where a batch ends is found on the driver; its events are read by the tasks, a row group each."""

    def __init__(self, options: dict):
        self.reader = FeedReader(options)
        self.at: dict | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return self.reader.initialOffset()

    def latestOffset(self) -> dict:  # noqa: N802
        self.at = self.reader.end(self.initialOffset() if self.at is None else self.at)
        return self.at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = end if self.at is None else self.at  # a query that goes on plans its last batch before all else
        return [RowGroup(path, group, start["id"], end["id"]) for low, high, path, group in Pages(self.reader.path).groups if high > start["id"] and low <= end["id"]]

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        files, _ = _located(self.reader.path)
        with files.open_input_file(partition.path) as source:
            for batch in pq.ParquetFile(source).iter_batches(row_groups=[partition.group], columns=COLUMNS):
                rows = pa.Table.from_batches([batch]).select(COLUMNS)
                ids = rows.column(ID)
                rows = in_utc(rows.filter(pc.and_(pc.greater(ids, partition.start), pc.less_equal(ids, partition.end))))
                yield from rows.cast(SCHEMA).to_batches()


class ChangeFeed(DataSource):
    """``spark.readStream.format("endringsstrom").option("path", …).option("companies", n).load()``.

    Options: ``path``, a folder of Parquet files with the feed; ``start``, the cursor that
    the first run begins after; ``companies``, how many a batch may hold; ``page``, the least
    number of events looked through at once. Register it with ``spark.dataSource.register(ChangeFeed)``.
    """

    @classmethod
    def name(cls) -> str:
        return "endringsstrom"

    def schema(self) -> str:
        return f"{ID} long, dato timestamp, {ORG} string, endringstype string"

    def streamReader(self, schema: StructType) -> FeedStream:  # noqa: N802
        return FeedStream(self.options)
