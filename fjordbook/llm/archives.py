"""Legacy archive converter: ARC versions 1 and 2 to WARC 1.1, and both formats' readers and writers.

An ARC file opens with a version block, whose first line is a record header and
whose body names the version and the fields of all further header lines. Every
record has one such line and as many bytes as it declares. The converter derives
what WARC wants and ARC lacks: record ids from address, date and payload, ISO
timestamps, record types, and digests of block and payload. Of long equal payloads
one stays a response, the others become revisits that refer to it.

Files are written and read by Spark's own text and binary sources, so they may be in
any store it reaches; bytes pass unchanged. A file is one task's output.

Defined cases: a null payload is empty; a null address is written as ``unknown:``,
white space in addresses as percent codes; a null page_id has no key in the address
and reads back as null, and is less than any other; rows alike are records of their
own, and of equal payloads all with the largest page_id are responses; an empty
table gives archives without records; other columns are not read. A header that
does not follow its version, or a file that ends inside a record, stops the job.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordbook.llm.common import table
from fjordbook.llm.words import lean
from fjordbook.session import checkpoint_root, durable

#: Header fields by version: fixed by the format.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Payloads from this size on are revisited; date of records that have none; bytes of rows sent on at once.
REVISIT_FROM, DATE, AT_ONCE = 1000, "20240101000000", 8 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY = re.compile(r"#page-(-?\d*)$")


def _rows(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], weight) -> Iterator[pa.RecordBatch]:
    """Batches of rows, closed by weight in bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row) + 64
        if size >= AT_ONCE:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


def _save(records: DataFrame, end: str, path: str) -> None:
    """Records' bytes, each followed by ``end``, one gzip file per task."""
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", end).option("compression", "gzip").text(path)


def address(url: str | None, page_id: int | None) -> str:
    """The address a record is kept under: ARC has no other place for a key.

    A page without a key ends in an empty one, so nothing in its own address is taken for a key.
    """
    plain = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "unknown:")
    return f"{plain}#page-{'' if page_id is None else page_id}"


def page_key(target: str) -> int | None:
    found = KEY.search(target)
    return int(found[1]) if found and found[1] else None


def write_arc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write pages as ARC files of HTTP responses, versions taking turns by task."""
    def run(batches):
        version = 1 + (TaskContext.get().partitionId() if TaskContext.get() else 0) % 2
        body = f"{version} 0 pages\n{ARC_FIELDS[version]}\n".encode()
        rest = "" if version == 1 else "200 - - 0 pages.arc "
        opening = f"filedesc://pages.arc 0.0.0.0 {DATE} text/plain {rest}{len(body)}\n".encode() + body

        def records():
            first = True
            for batch in batches:
                for key, link, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if first:
                        yield (opening,)
                        first = False
                    data = data or b""
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(data) + data
                    more = "" if version == 1 else f"200 {zlib.crc32(data):08x} - 0 pages.arc "
                    yield (f"{address(link, key)} 0.0.0.0 {DATE} text/html {more}{len(block)}\n".encode() + block,)

        yield from _rows(records(), ["record"], [pa.binary()], lambda r: len(r[0]))

    picked = pages.select(F.col(f"`{page_id}`").cast("long"), F.col(f"`{url}`").cast("string"), F.col(f"`{payload}`").cast("binary"))
    _save(picked.mapInArrow(lean(run), "record binary"), "\n", path)


class Bytes:
    """Reads a gzip or plain file in memory piece by piece."""

    def __init__(self, data: bytes):
        self.data, self.at, self.plain = data, 0, data[:2] != b"\x1f\x8b"
        self.inflate, self.held, self.offset = zlib.decompressobj(31), bytearray(), 0

    def _more(self) -> bool:
        if self.at >= len(self.data):
            return False
        part = self.data[self.at:self.at + (1 << 20)]
        self.at += len(part)
        if self.plain:
            self.held += part
            return True
        while part:
            self.held += self.inflate.decompress(part)
            part = self.inflate.unused_data
            if self.inflate.eof:  # the next member, as files with one per record have
                self.inflate = zlib.decompressobj(31)
        return True

    def _cut(self, n: int) -> bytes:
        out = bytes(self.held[:n])
        del self.held[:n]
        self.offset += n
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError(f"file ends {n - len(self.held)} bytes inside a record at {self.offset}")
        return self._cut(n)

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end of the file."""
        start = 0
        while (found := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark))
            if not self._more():
                if self.held.strip():
                    raise ValueError(f"file ends inside a header at {self.offset}")
                return None
        return self._cut(found + len(mark))


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """An HTTP response's header and payload; anything else is all payload."""
    end = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
    return (block[:end], block[end:]) if end >= 4 else (b"", block)


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of an ARC file, without its version block."""
    source, fields = Bytes(data), None
    while (line := source.until(b"\n")) is not None:
        if not line.strip():
            continue
        values = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        opening = fields is None
        if opening and not values[0].startswith("filedesc://"):
            raise ValueError("no version block at the start of the file")
        names = fields or ARC_FIELDS[2 if len(values) == 10 else 1].split()
        if len(values) < len(names) or not values[-1].isdigit():
            raise ValueError(f"header line at {source.offset - len(line)} does not follow {names}")
        # a content type with spaces leaves more values than fields
        extra = len(values) - len(names)
        where = names.index("Content-type")
        values[where:where + extra + 1] = [" ".join(values[where:where + extra + 1])]
        record = dict(zip(names, values, strict=True))
        block = source.take(int(record["Archive-length"]))
        if opening:
            version, described = (block.decode("utf-8", "replace").split("\n") + [""])[:2]
            number = int(version.split(" ")[0])
            if number not in ARC_FIELDS:
                raise ValueError(f"ARC version {number} is not known")
            fields = described.split() or ARC_FIELDS[number].split()
            continue
        yield {**record, "block": block}


ARC_COLUMNS = ["target", "date", "content_type", "status", "header", "payload", "payload_sha1"]


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all ARC files below ``path``; ``payload`` is null if not asked for."""
    def run(batches):
        def records():
            for batch in batches:
                for data, name in zip(*batch.columns, strict=True):
                    for number, r in enumerate(parse_arc(data.as_py())):
                        header, payload = http_parts(r["block"])
                        status = r.get("Result-code") or (header.split(b" ", 2)[1].decode() if header else "200")
                        yield (r["URL"], r["Archive-date"], r["Content-type"], status, header, payload if payloads else None, hashlib.sha1(payload).digest(), len(payload), f"{name.as_py().rpartition('/')[2]} {number}")

        text, blob = pa.string(), pa.binary()
        yield from _rows(records(), [*ARC_COLUMNS, "payload_bytes", "place"], [text, text, text, text, blob, blob, blob, pa.int64(), text], lambda r: len(r[5] or b"") + len(r[4]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content", "path")
    return files.mapInArrow(lean(run), "target string, date string, content_type string, status string, header binary, payload binary, payload_sha1 binary, payload_bytes long, place string")


def timestamp(date: str) -> str:
    """An ARC date of up to 14 digits as WARC's; what is missing is the earliest."""
    d = date + "00000101000000"[len(date):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(target: str, date: str, digest: bytes, place: str) -> str:
    """The same id each time the same record of an archive is converted; records alike have places of their own."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{target} {date} {digest.hex()} {place}')}>"


def base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def warc_record(target: str, date: str, content_type: str, header: bytes, payload: bytes, digest: bytes, place: str, first_target: str | None, first_date: str | None, first_place: str | None) -> bytes:
    """One WARC record: a response, or a revisit of the response at ``first_target``."""
    block = header if first_target else header + payload
    fields = {
        "WARC-Type": "revisit" if first_target else "response", "WARC-Record-ID": record_id(target, date, digest, place),
        "WARC-Date": timestamp(date), "WARC-Target-URI": target, "WARC-Payload-Digest": base32(digest),
        "WARC-Block-Digest": base32(hashlib.sha1(block).digest()),
        "WARC-Identified-Payload-Type": content_type.replace("\r", " ").replace("\n", " "),
    }
    if first_target:
        fields |= {
            "WARC-Profile": REVISIT, "WARC-Refers-To": record_id(first_target, first_date, digest, first_place),
            "WARC-Refers-To-Target-URI": first_target, "WARC-Refers-To-Date": timestamp(first_date),
        }
    fields |= {"Content-Type": "application/http; msgtype=response" if header else content_type, "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block


def convert(spark: SparkSession, arc_path: str, warc_path: str, revisit_from: int = REVISIT_FROM) -> None:
    """Turn all ARC files below one path into WARC files below another.

    Digests of long payloads are counted first, in one small row each. Only groups
    of equal payloads are kept, and joined to the records as Spark's size estimate
    of that stored table allows; a hot payload is one row of it.
    """
    key = F.regexp_extract("target", r"#page-(-?\d+)$", 1)
    page = F.nullif(key, F.lit("")).cast("long")
    brief = read_arc(spark, arc_path, payloads=False).filter(F.col("payload_bytes") >= revisit_from)
    first = F.max(F.struct(page.alias("page"), F.col("target"), F.col("date"), F.col("place")))
    groups = brief.groupBy("payload_sha1").agg(F.count(F.lit(1)).alias("n"), first.alias("first")).filter("n > 1")
    groups = durable(groups.select("payload_sha1", "first.*").withColumnsRenamed({"page": "first_page", "target": "first_target", "date": "first_date", "place": "first_place"}))
    records = read_arc(spark, arc_path).join(groups, "payload_sha1", "left")
    again = (F.col("payload_bytes") >= revisit_from) & F.coalesce(page < F.col("first_page"), page.isNull() & F.col("first_page").isNotNull())
    refers = lambda c: F.when(again, F.col(c))
    rows = records.select("target", "date", "content_type", "header", "payload", "payload_sha1", "place", *[refers(c).alias(c) for c in ("first_target", "first_date", "first_place")])

    def run(batches):
        def made():
            opening = True
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if opening:
                        info = b"software: fjordbook\r\nformat: WARC File Format 1.1\r\n"
                        yield (b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n" % (
                            str(uuid.uuid5(uuid.NAMESPACE_URL, f"info {row[0]}")).encode(), timestamp(row[1]).encode(), len(info)) + info,)
                        opening = False
                    yield (warc_record(*row),)

        yield from _rows(made(), ["record"], [pa.binary()], lambda r: len(r[0]))

    _save(rows.mapInArrow(lean(run), "record binary"), "\r\n\r\n", warc_path)


def parse_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """``(fields, block)`` of every record of a WARC file."""
    source = Bytes(data)
    while (head := source.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").strip().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins at {source.offset - len(head)}")
        fields = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        block = source.take(int(fields["content-length"]))
        if source.take(4) != b"\r\n\r\n":
            raise ValueError(f"record does not end where it declares, at {source.offset}")
        yield fields, block


WARC_SCHEMA = "record_id string, record_type string, date string, target string, page_id long, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Responses and revisits of all WARC files below ``path``; digests are held against the blocks."""
    def run(batches):
        def records():
            for batch in batches:
                for data in batch.column(0):
                    for f, block in parse_warc(data.as_py()):
                        kind = f["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        if f["warc-block-digest"] != base32(hashlib.sha1(block).digest()):
                            raise ValueError(f"digest of {f['warc-record-id']} does not fit its block")
                        header, payload = http_parts(block)
                        size = len(payload)
                        if kind == "revisit":  # the block is the header alone, which says the payload's length
                            size = int(re.search(rb"(?im)^content-length:\s*(\d+)", header)[1])
                        digest = base64.b32decode(f["warc-payload-digest"].partition(":")[2]).hex()
                        refers = page_key(f["warc-refers-to-target-uri"]) if kind == "revisit" else None
                        yield (f["warc-record-id"], kind, f["warc-date"], KEY.sub("", f["warc-target-uri"]), page_key(f["warc-target-uri"]), size, digest, refers, payload if payloads and kind == "response" else None)

        text, whole = pa.string(), pa.int64()
        yield from _rows(records(), [c.split()[0] for c in WARC_SCHEMA.split(", ")], [text, text, text, text, whole, whole, text, whole, pa.binary()], lambda r: len(r[8] or b""))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(lean(run), WARC_SCHEMA)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{checkpoint_root(spark)}/archives-{uuid.uuid4().hex}"
    write_arc(table(spark, sf_dir, "pages"), f"{root}/arc")
    convert(spark, f"{root}/arc", f"{root}/warc")
    return read_warc(spark, f"{root}/warc", payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
