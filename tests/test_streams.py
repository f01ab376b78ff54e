"""Streams against batch forms: client windows with timers, the feed as a source with a cap."""

import random
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fjordbook.schema import ORG
from fjordbook.streaming import clients as C
from fjordbook.streaming import feed as S

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SECOND = 1_000_000


def greedy(requests, width):
    """Windows request by request."""
    out, held = [], {}
    for t, user, kind in sorted(requests):
        key = (user, kind)
        if key in held and t < held[key][0] + width:
            held[key][1] += 1
            continue
        if key in held:
            out.append((*key, *held[key]))
        held[key] = [t, 1]
    return sorted(out + [(*k, *w) for k, w in held.items()])


def rows_of(spark, requests):
    return spark.createDataFrame([(START + timedelta(microseconds=t), u, k) for t, u, k in requests], "ts timestamp, user_id long, event_type string")


def requests(n, seed=1):
    r = random.Random(seed)
    out = [(r.randrange(600 * SECOND), r.choice([1, 1, 1, 2, 3]), r.choice("ab")) for _ in range(n)]
    return out + [(0, 9, "a"), (60 * SECOND, 9, "a"), (60 * SECOND - 1, 9, "a"), (119_999_999, 9, "a"), (500 * SECOND, 9, "a")] * 2


def plain(rows, *more):
    base = int(START.timestamp()) * SECOND
    return sorted((r.user_id, r.event_type, r.v - base, r.antall, *[r[c] for c in more]) for r in rows.withColumn("v", F.unix_micros("vindu")).collect())


def test_client_windows(spark):
    asked = requests(3000)
    found = C.client_windows(rows_of(spark, asked), limit=40)
    assert plain(found) == greedy(asked, 60 * SECOND)
    assert all(r.avvist == max(0, r.antall - 40) and r.over_grensen == (r.antall > 40) for r in found.collect())
    assert C.client_windows(rows_of(spark, [])).count() == 0


def test_streamed_client_windows(spark, tmp_path):
    """Requests that come in several files, out of order within the delay, and clients that fall silent."""
    asked = sorted(requests(400, seed=2))
    shuffled = sorted(asked, key=lambda q: q[0] + random.Random(q[0]).randrange(5 * SECOND))
    cuts = [0, 130, 131, 300, len(shuffled)]
    schema = "ts timestamp, user_id long, event_type string"
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        rows_of(spark, shuffled[a:b]).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        C.start_client_stream(stream, f"{tmp_path}/out", f"{tmp_path}/check", delay="10 seconds").awaitTermination()
        so_far = greedy(shuffled[:b], 60 * SECOND)
        assert [w[:4] for w in plain(C.streamed_windows(spark, f"{tmp_path}/out"))] == so_far
    last = max(asked)[0] // 1000 * 1000 - 10 * SECOND
    rows = plain(C.streamed_windows(spark, f"{tmp_path}/out"), "apen")
    assert [w[4] for w in rows] == [w[2] + 60 * SECOND > last for w in rows] and any(w[4] for w in rows)


def write_feed(folder, events, groups=4):
    folder.mkdir(exist_ok=True)
    rows = pa.table({"oppdateringsid": pa.array([i for i, _ in events], pa.int64()), "dato": pa.array([START] * len(events), pa.timestamp("us", "UTC")),
                     ORG: [c for _, c in events], "endringstype": ["Endring"] * len(events)})
    pq.write_table(rows, folder / f"{events[0][0]}.parquet", row_group_size=max(1, len(events) // groups))


def capped(events, most):
    """Batches event by event."""
    out, seen = [[]], set()
    for i, c in sorted(events):
        if c not in seen and len(seen) == most:
            out.append([])
            seen = set()
        seen.add(c)
        out[-1].append(i)
    return out


@pytest.mark.parametrize("most, page", [(1, 3), (3, 7), (4, 1000), (100, 5)])
def test_feed_batches(tmp_path, most, page):
    r = random.Random(most)
    ids = sorted(r.sample(range(1000), 200))
    events = [(i, r.choice("aaabcdefg")) for i in ids]
    write_feed(tmp_path / "f", events[:70])
    write_feed(tmp_path / "f", events[70:])
    reader = S.FeedReader({"path": str(tmp_path / "f"), "companies": str(most), "page": str(page)})
    at, found = reader.initialOffset(), []
    while True:
        rows, end = reader.read(at)
        rows = list(rows)
        if end == at:
            break
        assert [x[0] for x in reader.readBetweenOffsets(at, end)] == [x[0] for x in rows]
        found.append([x[0] for x in rows])
        at = end
    assert found == capped(events, most) and not rows


def test_pages_read_only_the_row_groups_they_need(tmp_path, monkeypatch):
    write_feed(tmp_path / "f", [(i, "a") for i in range(100)], groups=10)
    pages = S.Pages(str(tmp_path / "f"))
    read = []
    monkeypatch.setattr(S.pq.ParquetFile, "read_row_group", lambda self, i, _r=S.pq.ParquetFile.read_row_group: read.append(i) or _r(self, i))
    assert pages.after(24, 10).column("oppdateringsid").to_pylist() == list(range(25, 35)) and read == [2, 3]
    assert len(pages.after(99, 10)) == 0


def test_events_of_a_batch_do_not_pass_through_the_driver(tmp_path):
    events = [(i, "abcde"[i % 5]) for i in range(100)]
    write_feed(tmp_path / "f", events, groups=10)
    stream = S.ChangeFeed({"path": str(tmp_path / "f"), "companies": "4", "page": "3"}).streamReader(None)
    first, second = stream.latestOffset(), stream.latestOffset()
    assert [first["id"], second["id"]] == [3, 7]
    parts = stream.partitions({"id": 14}, {"id": 41})
    assert [p.group for p in parts] == [1, 2, 3, 4]
    assert [i for p in parts for b in stream.read(p) for i in b.column("oppdateringsid").to_pylist()] == list(range(15, 42))
    again = S.ChangeFeed({"path": str(tmp_path / "f"), "companies": "4"}).streamReader(None)
    assert len(again.partitions(first, second)) == 1 and again.latestOffset() == {"id": 11}
