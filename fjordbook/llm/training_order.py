"""Training-order materialisation: token sequences in a keyed random order, in binary shards of one stride.

A keyed hash of its document and piece sends a sequence to a range of the global
order, and a keyed Feistel permutation with cycle-walking over the range's size
gives it its slot there: every sequence has one global slot and every slot one
sequence, no list of the order is kept, and another key is another order. One
shuffle brings a range to the task that writes it as one shard.

A shard is records of equal length: document, piece, number of tokens, 16-bit ids
filled up with the end token, and one closing byte. Slot ``n`` is found by its
range's first slot and the stride, so a reader can stop and go on anywhere. Shards
are written and read by Spark's own text and binary sources.

Defined cases: a null text is an empty one, whose sequence is the end token; rows
without a doc_id and rows alike are sequences of their own; an empty table gives no
shards; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fjordbook.llm.common import table
from fjordbook.llm.feistel import permute
from fjordbook.llm.packing import END, cutter
from fjordbook.llm.tokens import vocabulary_path
from fjordbook.llm.words import lean, mix
from fjordbook.session import checkpoint_root, durable

#: Tokens of a sequence, key of the order, bytes of text per shard.
LENGTH, KEY, SHARD_BYTES = 512, 1_618_033_988, 8 << 20
#: Fields ahead of a record's ids; stands for a missing doc_id.
HEAD = np.dtype([("doc_id", "<i8"), ("piece", "<i4"), ("n", "<i4")])
NO_ID = -(1 << 63)


def record_type(length: int) -> np.dtype:
    """A record: its fixed fields, its ids, and the closing byte."""
    return np.dtype([*((f, HEAD[f]) for f in HEAD.names), ("ids", "<u2", (length,)), ("close", "u1")])


def places(doc_id: np.ndarray, piece: np.ndarray, key: int) -> np.ndarray:
    """The keyed hash that decides a sequence's range and its rank there."""
    return mix(mix(doc_id.astype(np.int64).view(np.uint64) ^ np.uint64(key)) + piece.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def write_shards(docs: DataFrame, path: str, vocabulary: str, length: int = LENGTH, key: int = KEY, shards: int | None = None) -> None:
    """Tokenise ``(doc_id, text)`` and write all sequences in their order below ``path``."""
    if shards is None:
        shards = max(1, ceil((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / SHARD_BYTES))

    def deal(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in cutter(vocabulary, length, ids=True)(batches):
            n, piece = batch.column("length").to_numpy(), batch.column("piece").to_numpy()
            doc_id = batch.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy()
            ids, starts = batch.column("ids").flatten().to_numpy().astype("<u2"), np.cumsum(n) - n
            shard = (places(doc_id, piece, key) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            head = np.zeros(len(n), HEAD)
            head["doc_id"], head["piece"], head["n"] = doc_id, piece, n
            found, blobs = [], []
            for rows in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                if len(rows):
                    at = np.repeat(starts[rows] - (np.cumsum(n[rows]) - n[rows]), n[rows]) + np.arange(n[rows].sum())
                    found.append(shard[rows[0]])
                    blobs.append(pack.compress(len(rows).to_bytes(8, "little") + head[rows].tobytes() + ids[at].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])

    def write(batches):
        unpack = zstandard.ZstdDecompressor()
        heads, tokens, shard = [], [], 0
        for batch in batches:
            for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("blob"), strict=True):  # noqa: B007
                raw = unpack.decompress(blob.as_py())
                end = 8 + int.from_bytes(raw[:8], "little") * HEAD.itemsize
                heads.append(np.frombuffer(raw[8:end], HEAD))
                tokens.append(np.frombuffer(raw[end:], "<u2"))
        if not heads:
            return
        head, ids = np.concatenate(heads), np.concatenate(tokens)
        n = head["n"].astype(np.int64)
        starts = np.cumsum(n) - n
        crc = np.array([zlib.crc32(ids[a:a + m].tobytes()) for a, m in zip(starts.tolist(), n.tolist(), strict=True)], np.int64)
        ranked = np.lexsort([crc, head["piece"], head["doc_id"], places(head["doc_id"], head["piece"], key)])
        slot = permute(np.arange(len(head)), len(head), key ^ (shard + 1)).astype(np.int64)
        order = np.empty(len(head), np.int64)
        order[slot] = ranked
        for i in range(0, len(order), 4096):
            rows = order[i:i + 4096]
            out = np.zeros(len(rows), record_type(length))
            out["ids"], out["close"] = END, 10
            for f in HEAD.names:
                out[f] = head[f][rows]
            column = np.arange(n[rows].sum()) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows])
            out["ids"][np.repeat(np.arange(len(rows)), n[rows]), column] = ids[np.repeat(starts[rows], n[rows]) + column]
            width = out.dtype.itemsize
            raw = out.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw[j:j + width - 1] for j in range(0, len(raw), width)], pa.binary())], ["record"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = texts.mapInArrow(lean(deal), "shard int, blob binary").repartitionById(shards, F.col("shard"))
    records = dealt.mapInArrow(lean(write), "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\n").text(path)


def shard_files(spark: SparkSession, path: str, length: int = LENGTH) -> DataFrame:
    """``(path, shard, first_slot, rows)`` of every shard, from the files' names and sizes alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    listed = files.select("path", F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), (F.col("length") / record_type(length).itemsize).cast("long").alias("rows"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return listed.withColumn("first_slot", F.coalesce(F.sum("rows").over(before), F.lit(0))).filter("rows > 0")


def read_shards(spark: SparkSession, path: str, length: int = LENGTH, start: int = 0, stop: int | None = None, digest: bool = False) -> DataFrame:
    """``(slot, shard, doc_id, piece, n_tokens, ids)`` of the slots from ``start`` to before ``stop``.

    Of a range only its own shards are opened. With ``digest``, ``ids_crc32`` (of the
    ids as unsigned little-endian 32-bit numbers) stands in for ``ids``. The list of
    shards is stored, and joined as its size allows.
    """
    kind = record_type(length)
    last = "ids_crc32" if digest else "ids"

    def run(batches):
        for batch in batches:
            for shard, first, blob in zip(batch.column("shard").to_pylist(), batch.column("first_slot").to_pylist(), batch.column("content"), strict=True):
                data = np.frombuffer(blob.as_buffer(), kind)
                low, high = max(0, start - first), len(data) if stop is None else min(len(data), stop - first)
                for i in range(low, high, 8192):
                    part = data[i:min(i + 8192, high)]
                    n = part["n"].astype(np.int64)
                    flat = part["ids"][np.arange(length)[None, :] < n[:, None]]
                    ends = np.concatenate([[0], np.cumsum(n)])
                    if digest:
                        wide = flat.astype("<u4")
                        ids = pa.array([zlib.crc32(wide[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64())
                    else:
                        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))
                    doc_id = pa.array(part["doc_id"].astype(np.int64), mask=part["doc_id"] == NO_ID)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(first + np.arange(i, i + len(part))), pa.array(np.full(len(part), shard, np.int32)), doc_id, pa.array(part["piece"].astype(np.int32)), pa.array(part["n"].astype(np.int32)), ids],
                        ["slot", "shard", "doc_id", "piece", "n_tokens", last])

    wanted, places_to_read = durable(shard_files(spark, path, length)), [path]
    if start or stop is not None:
        wanted = wanted.filter((F.col("first_slot") + F.col("rows") > start) & (F.col("first_slot") < (stop if stop is not None else (1 << 62))))
        places_to_read = [r["path"] for r in wanted.select("path").collect()]  # as many as the range has shards
        if not places_to_read:
            return spark.createDataFrame([], f"slot long, shard int, doc_id long, piece int, n_tokens int, {last} {'long' if digest else 'array<int>'}")
    content = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(places_to_read).select("path", "content")
    rows = content.join(wanted.select("path", "shard", "first_slot"), "path").select("shard", "first_slot", "content")
    return rows.mapInArrow(lean(run), f"slot long, shard int, doc_id long, piece int, n_tokens int, {last} {'long' if digest else 'array<int>'}")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_root(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(table(spark, sf_dir, "documents"), path, vocabulary_path())
    return read_shards(spark, path, digest=True)
