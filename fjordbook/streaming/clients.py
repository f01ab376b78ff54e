"""Request limits in windows that begin with a client's own first request.

A window is open for a fixed time from the request that opened it; the next request
after that opens the next one. Where a window begins so depends on all before it, and
requests are taken strictly in their order: a request waits until the watermark has
passed it, so one that comes late, but within the delay, still finds its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Requests allowed in a window, and its length in microseconds.
LIMIT, WIDTH = 60, 60_000_000
STATE = "start long, antall long, venter array<long>"


def _walk(times: np.ndarray, start: int, count: int, width: int) -> tuple[list[tuple[int, int]], int, int]:
    """Windows that end on the way through ``times`` in order, and the one that is open then; ``count`` 0 is none."""
    ended, at = [], 0
    while at < len(times):
        if count and times[at] < start + width:
            inside = int(np.searchsorted(times, start + width)) - at
        else:
            if count:
                ended.append((start, count))
            start, count = int(times[at]), 0
            inside = int(np.searchsorted(times, start + width)) - at
        count += inside
        at += inside
    return ended, start, count


def _shown(limit: int) -> list[Column]:
    over = F.greatest(F.col("antall") - limit, F.lit(0))
    return [F.timestamp_micros("vindu").alias("vindu"), F.col("antall"), over.alias("avvist"), (F.col("antall") > limit).alias("over_grensen")]


def client_windows(events: DataFrame, limit: int = LIMIT, width: int = WIDTH, client: str = "user_id", endpoint: str = "event_type", ts: str = "ts") -> DataFrame:
    """``(client, endpoint, vindu, antall, avvist, over_grensen)`` of all requests of a table.

    Requests are sorted by client within partitions and walked through in batches, so
    a client with most of the traffic is long work for one task but never held at once.
    """
    keyed = events.select(client, endpoint, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t")).dropna()
    kinds = {c: keyed.schema[c].dataType.simpleString() for c in (client, endpoint)}
    ordered = keyed.repartition(client, endpoint).sortWithinPartitions(client, endpoint, "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, start, count = None, 0, 0
        for batch in batches:
            keys = list(zip(batch.column(client).to_pylist(), batch.column(endpoint).to_pylist(), strict=True))
            times = batch.column("_t").to_numpy()
            borders = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)] if keys else []
            found = []
            for low, high in zip(borders[:-1], borders[1:], strict=True):
                if keys[low] != key:
                    if count:
                        found.append((*key, start, count))
                    key, count = keys[low], 0
                ended, start, count = _walk(times[low:high], start, count, width)
                found += [(*key, *w) for w in ended]
            if found:
                yield _batch(found, batch.schema)
        if count:
            yield _batch([(*key, start, count)], batch.schema)

    def _batch(found, schema):
        columns = list(zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([
            pa.array(columns[0], schema.field(client).type), pa.array(columns[1], schema.field(endpoint).type), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()),
        ], [client, endpoint, "vindu", "antall"])

    walked = ordered.mapInArrow(run, f"`{client}` {kinds[client]}, `{endpoint}` {kinds[endpoint]}, vindu long, antall long")
    return walked.select(client, endpoint, *_shown(limit))


def start_client_stream(events: DataFrame, out: str, checkpoint: str, delay: str = "10 seconds", width: int = WIDTH,
                        client: str = "user_id", endpoint: str = "event_type", ts: str = "ts", **trigger) -> StreamingQuery:
    """Follow the requests; every batch writes the windows that closed, and the open ones of the clients it touched.

    A client's state is its open window and the requests that the watermark has not
    passed yet. A timer closes the window when the watermark does, whether or not
    further requests come. Batches that are replayed overwrite themselves.
    """
    stamped = events.withColumn("_ts", F.col(ts).cast("timestamp")).select(client, endpoint, "_ts").dropna().withWatermark("_ts", delay)
    kinds = [stamped.schema[c].dataType.simpleString() for c in (client, endpoint)]
    schema = f"`{client}` {kinds[0]}, `{endpoint}` {kinds[1]}, vindu long, antall long, apen boolean"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, count, waiting = state.get if state.exists else (0, 0, [])
        fresh = [f["_ts"].astype("datetime64[us]").astype("int64").to_numpy() for f in ([] if state.hasTimedOut else frames)]
        times = np.sort(np.concatenate([np.array(waiting, np.int64), *fresh]).astype(np.int64))
        mark = state.getCurrentWatermarkMs() * 1000
        passed = int(np.searchsorted(times, mark, "right"))
        ended, start, count = _walk(times[:passed], start, count, width)
        if count and start + width <= mark:  # nothing that still waits belongs to it
            ended.append((start, count))
            count = 0
        left = times[passed:]
        later, open_start, open_count = _walk(left, start, count, width)
        rows = [(*key, s, n, False) for s, n in ended] + [(*key, s, n, True) for s, n in (*later, *([(open_start, open_count)] if open_count else []))]
        if count or len(left):
            state.update((int(start), int(count), left.tolist()))
            due = start + width if count else int(left[0])
            state.setTimeoutTimestamp(max(due // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        yield pd.DataFrame(rows, columns=[client, endpoint, "vindu", "antall", "apen"])

    windows = stamped.groupBy(client, endpoint).applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    writer = windows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def streamed_windows(spark: SparkSession, out: str, limit: int = LIMIT, client: str = "user_id", endpoint: str = "event_type") -> DataFrame:
    """All windows of the stream: the closed ones, and those open when their client was last seen, marked ``apen``."""
    try:
        rows = spark.read.parquet(out)
    except AnalysisException:
        raise FileNotFoundError(f"no windows below {out}") from None
    newest = rows.groupBy(client, endpoint).agg(F.max("batch_id").alias("_last"))
    latest = rows.join(newest, [client, endpoint])
    return latest.filter(~F.col("apen") | (F.col("batch_id") == F.col("_last"))).select(client, endpoint, *_shown(limit), "apen")
