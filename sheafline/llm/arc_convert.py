"""Conversion of legacy ARC archives to WARC.

An ARC file starts with a version block that names the fields of its record header lines: five in
version 1, ten in version 2. Header lines are parsed by that version and payloads are taken by their
declared length, never by searching. The WARC records get what ARC does not have: ids, ISO dates,
record types and digests, and records with the payload of another one become revisits of it.

Archives are read and written with Spark's text source, whose rows are the parts between line ends;
an archive is compressed as a whole, so one task streams through it and holds a record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.session import materialize, scratch_dir, ship_package

# The field names in the version block of each ARC version.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: (
        "URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
        "Filename", "Archive-length",
    ),
}
#: Payloads below this many bytes are never revisits.
LEAST_REVISIT = 1000
ID_FIELD = "X-Archive-Row"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
SPEED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


@dataclass
class ArcRecord:
    """A record of an archive: its header fields by name, where it starts, and its block."""

    fields: dict[str, str]
    offset: int
    block: bytes
    error: str = ""


def arc_block(url: str | None, ident: int | None, body: bytes) -> bytes:
    """An HTTP response as it was archived; the row's id is a header field of it."""
    own = f"{ID_FIELD}: {ident}\r\n" if ident is not None else ""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n{own}\r\n"
    return head.encode() + body


def version_block(name: str, version: int, date: str) -> bytes:
    """The first record of an archive."""
    fields = " ".join(FIELDS[version])
    block = f"{version} 0 archive\n{fields}\n"
    values = {
        "URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain",
        "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name,
        "Archive-length": str(len(block)),
    }
    return " ".join(values[f] for f in FIELDS[version]).encode() + b"\n" + block.encode()


def arc_header(version: int, url: str | None, date: str, block: bytes, name: str) -> bytes:
    """A record's header line; white space in the URL is percent-encoded, a null URL is empty."""
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    values = {
        "URL": safe, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html",
        "Result-code": "200", "Checksum": hashlib.md5(block).hexdigest(), "Location": "-", "Offset": "-",
        "Filename": name, "Archive-length": str(len(block)),
    }
    return " ".join(values[f] for f in FIELDS[version]).encode() + b"\n"


class Records:
    """Splits a stream of "parts between line feeds" into header lines and blocks of known length.

    ``length`` says how long the block after a complete header is; ``lines`` whether a header is one
    line (ARC) or all up to an empty one (WARC).
    """

    def __init__(self, single: bool, length):
        self.single, self.length = single, length
        self.header: list[bytes] = []
        self.block: list[bytes] = []
        self.missing = -1  # bytes of the block still to come; -1: in a header
        self.offset = self.start = 0

    def feed(self, line: bytes):
        """(header lines, block, offset) if the line ends a record."""
        self.offset += len(line) + 1
        if self.missing < 0:
            plain = line.rstrip(b"\r")
            if not self.header:
                if not plain:
                    return None  # between records
                self.start = self.offset - len(line) - 1
            if plain:
                self.header.append(plain)
            if plain and not self.single:
                return None
            self.missing = self.length(self.header)
            if self.missing == 0:
                return self._done()
            return None
        take = line[: self.missing]
        self.block.append(take)
        self.missing -= len(take)
        if self.missing > 0:  # the line feed belongs to the block
            self.block.append(b"\n")
            self.missing -= 1
        return self._done() if self.missing == 0 else None

    def _done(self):
        out = (self.header, b"".join(self.block), self.start)
        self.header, self.block, self.missing = [], [], -1
        return out

    def rest(self):
        """What the archive broke off in, if anything, without the line feed assumed behind it."""
        if self.block and self.block[-1] == b"\n":
            self.block.pop()
        return (self.header, b"".join(self.block), self.start) if self.header else None


class ArcReader:
    """Records of one archive; the version block decides how header lines are read."""

    def __init__(self):
        self.version = 1
        self.records = Records(True, self._length)

    def _parse(self, line: bytes) -> dict[str, str] | None:
        names = FIELDS[self.version]
        parts = line.decode("utf-8", "replace").rsplit(" ", len(names) - 1)  # old URLs may hold blanks
        if len(parts) != len(names) or not parts[-1].isdigit():
            return None
        return dict(zip(names, parts))

    def _length(self, header: list[bytes]) -> int:
        line = header[0]
        if self.records.start == 0 and line.startswith(b"filedesc:"):  # its version is not known yet
            last = line.rsplit(b" ", 1)[-1]
            return int(last) if last.isdigit() else 0
        found = self._parse(line)
        return int(found["Archive-length"]) if found else 0

    def feed(self, line: bytes) -> ArcRecord | None:
        return self._record(self.records.feed(line))

    def end(self) -> ArcRecord | None:
        rest = self.records.rest()
        record = self._record(rest)
        if record:
            record.error = record.error or "cut off"
        return record

    def _record(self, done) -> ArcRecord | None:
        if done is None:
            return None
        (line, *_), block, offset = done
        if offset == 0 and line.startswith(b"filedesc:"):
            first = block.split(b"\n", 1)[0].split(b" ", 1)[0]
            self.version = int(first) if first.isdigit() and int(first) in FIELDS else 1
        found = self._parse(line)
        if found is None:
            text = line.decode("utf-8", "replace")
            return ArcRecord({"URL": text.split(" ")[0]}, offset, b"", "unreadable header line")
        return ArcRecord(found, offset, block)


def iso_date(stamp: str) -> str:
    """ARC's 14 digits (fewer: padded, others: the epoch) as a WARC date."""
    digits = re.sub(r"\D", "", stamp)[:14]
    if len(digits) < 8:
        return "1970-01-01T00:00:00Z"
    d = digits.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(record: ArcRecord) -> tuple[bytes, bytes]:
    """HTTP header and payload of a record; the version block and other protocols have no header."""
    if record.offset and record.block.startswith(b"HTTP/"):
        cut = record.block.find(b"\r\n\r\n")
        if cut >= 0:
            return record.block[: cut + 4], record.block[cut + 4 :]
    return b"", record.block


def kind_of(record: ArcRecord) -> str:
    """The WARC type that an ARC record corresponds to."""
    if record.offset == 0 and record.fields["URL"].startswith("filedesc:"):
        return "warcinfo"
    return "response" if split_http(record)[0] else "resource"


def record_id(archive: str, offset: int) -> str:
    """A name-based UUID of the place of the record in the old archive."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'arc:{archive}#{offset}')}>"


def digest_of(payload: bytes) -> str:
    return hashlib.sha1(payload).hexdigest()


def header_value(head: bytes, name: str) -> str | None:
    found = re.search(rb"^" + name.encode() + rb":[ \t]*([^\r\n]*)", head, re.IGNORECASE | re.MULTILINE)
    return found[1].decode("utf-8", "replace") if found else None


def _number(value: str | None) -> int | None:
    return int(value) if value and re.fullmatch(r"-?\d{1,18}", value) else None


def warc_record(record: ArcRecord, archive: str, original: tuple[str, str, str] | None = None) -> bytes:
    """The WARC record of an ARC record, without the two line ends behind it. ``original`` is (id,
    URL, date) of the response that it revisits: then the payload is left out."""
    kind = kind_of(record)
    head, payload = split_http(record)
    block = head if original else record.block
    named = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if original else kind}",
        f"WARC-Record-ID: {record_id(archive, record.offset)}",
        f"WARC-Date: {iso_date(record.fields['Archive-date'])}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
    ]
    if kind == "warcinfo":
        lines += [f"WARC-Filename: {record.fields['URL'].removeprefix('filedesc://')}"]
    else:
        lines += [
            f"WARC-Target-URI: {record.fields['URL']}",
            f"WARC-IP-Address: {record.fields['IP-address']}",
            f"WARC-Payload-Digest: sha1:{named}",
        ]
    if original:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {original[0]}",
            f"WARC-Refers-To-Target-URI: {original[1]}",
            f"WARC-Refers-To-Date: {original[2]}",
        ]
    mime = {"warcinfo": "text/plain", "response": "application/http; msgtype=response"}
    lines += [
        f"Content-Type: {mime.get(kind, record.fields['Content-type'])}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (binary) of all archives in a folder, in order within a file."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))


def write_arcs(pages: DataFrame, path: str, date: str = "20240101000000", key: str = "page_id") -> None:
    """One ARC archive per partition of ``pages``, in versions 1 and 2 by turns; payload: html."""
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"part-{part:05d}.arc"
        # a part between two line ends of the file each; the writer puts a line feed after it
        yield pa.RecordBatch.from_arrays([pa.array([version_block(name, version, date)], pa.binary())], names=["value"])
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                out = []
                for ident, url, html in zip(*(c.slice(start, 256).to_pylist() for c in batch.columns)):
                    block = arc_block(url, ident, (html or "").encode())
                    out.append(arc_header(version, url, date, block, name) + block)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows = pages.select(F.col(key).cast("long"), "url", "html").mapInArrow(run, "value binary")
    rows.select(F.col("value").cast("string")).write.options(lineSep="\n", **SPEED).text(path)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, ArcRecord]]:
    """(archive, record) of a task's lines."""
    file, reader = None, ArcReader()
    for batch in batches:
        for name, line in zip(batch.column(0).to_pylist(), batch.column(1)):
            if name != file:
                if file is not None and (last := reader.end()):
                    yield file, last
                file, reader = name, ArcReader()
            if record := reader.feed(line.as_py()):
                yield file, record
    if file is not None and (last := reader.end()):
        yield file, last


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches of at most about ``most`` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def arc_index(spark: SparkSession, path: str) -> DataFrame:
    """archive, offset, id, uri, date, kind, row, length, digest, error of every record of a folder of
    ARC archives; ``row`` is the number in the archived header field X-Archive-Row, else null."""
    ship_package(spark)
    schema = pa.schema(
        [("archive", pa.string()), ("offset", pa.int64()), ("id", pa.string()), ("uri", pa.string())]
        + [("date", pa.string()), ("kind", pa.string()), ("row", pa.int64()), ("length", pa.int64())]
        + [("digest", pa.binary()), ("error", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for file, r in _records(batches):
                head, payload = split_http(r)
                row = header_value(head, ID_FIELD)
                yield (
                    file, r.offset, record_id(file, r.offset), r.fields["URL"],
                    iso_date(r.fields.get("Archive-date", "")), kind_of(r), _number(row), len(payload),
                    hashlib.sha1(payload).digest(), r.error,
                )

        yield from _batched(rows(), schema)

    return read_lines(spark, path).mapInArrow(
        run,
        "archive string, offset long, id string, uri string, date string, kind string, row long, length long, "
        "digest binary, error string",
    )


def convert(spark: SparkSession, arcs: str, warcs: str) -> None:
    """Write the WARC archives of a folder of ARC archives.

    Of responses with equal payloads of at least LEAST_REVISIT bytes the one with the largest row
    number (ties: the largest id) stays a response. The records are read twice: for the index, which
    decides about revisits, and for their blocks. Only revisits are joined to the blocks. Records
    with an unreadable header line are left out (see the error of the index); a record that the
    archive breaks off in is kept with what is there.
    """
    index = materialize(arc_index(spark, arcs))
    twice = index.filter((F.col("kind") == "response") & (F.col("length") >= LEAST_REVISIT))
    original = twice.groupBy("digest", "length").agg(
        F.count("*").alias("n"),
        F.max(F.struct(F.coalesce("row", F.lit(-1 << 62)).alias("row"), "id", "uri", "date")).alias("o"),
    )
    revisits = (
        twice.join(original.filter("n > 1"), ["digest", "length"])
        .filter(F.col("id") != F.col("o.id"))
        .select("id", F.struct("o.id", "o.uri", "o.date").alias("original"))
    )
    revisits = materialize(revisits)
    schema = pa.schema([("id", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))]
                       + [("archive", pa.string()), ("offset", pa.int64()), ("block", pa.binary())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(
            (
                (record_id(file, r.offset), list(r.fields.items()), file, r.offset, r.block)
                for file, r in _records(batches)
                if r.error in ("", "cut off")
            ),
            schema,
        )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                out = []
                for fields, file, offset, block, first in zip(
                    *(c.slice(start, 64).to_pylist() for c in batch.columns)
                ):
                    record = ArcRecord(dict(fields), offset, block)
                    out.append(warc_record(record, file, tuple(first.values()) if first else None))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    (
        read_lines(spark, arcs)
        .mapInArrow(blocks, "id string, fields map<string,string>, archive string, offset long, block binary")
        .join(revisits, "id", "left")
        .select("fields", "archive", "offset", "block", "original")
        .mapInArrow(write, "value binary")
        .select(F.col("value").cast("string"))
        .write.options(lineSep="\r\n\r\n", **SPEED)
        .text(warcs)
    )


def read_warcs(spark: SparkSession, path: str) -> DataFrame:
    """id, record_type, uri, date, row, payload_bytes, payload_digest, refers_to_id of every record.

    The digest is of the payload; a revisit has none, so its digest is what its header says and its
    size what its HTTP header says.
    """
    ship_package(spark)
    schema = pa.schema(
        [("id", pa.string()), ("record_type", pa.string()), ("uri", pa.string()), ("date", pa.string())]
        + [("row", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
        + [("refers_to_id", pa.string())]
    )

    def length(header: list[bytes]) -> int:
        return _number(header_value(b"\n".join(header), "Content-Length")) or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            file, parts = None, Records(False, length)
            for batch in batches:
                for name, line in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if name != file:
                        file, parts = name, Records(False, length)
                    if done := parts.feed(line.as_py()):
                        yield row(b"\n".join(done[0]), done[1])

        def row(head: bytes, block: bytes) -> tuple:
            kind = header_value(head, "WARC-Type")
            http, payload = b"", block
            if kind in ("response", "revisit"):
                cut = block.find(b"\r\n\r\n") + 4
                http, payload = block[:cut], block[cut:]
            if kind == "revisit":
                size = _number(header_value(http, "Content-Length")) or 0
                named = header_value(head, "WARC-Payload-Digest") or ""
                digest = base64.b32decode(named.removeprefix("sha1:")).hex()
            else:
                size, digest = len(payload), digest_of(payload)
            own = header_value(http, ID_FIELD)
            return (
                header_value(head, "WARC-Record-ID"), kind, header_value(head, "WARC-Target-URI"),
                header_value(head, "WARC-Date"), _number(own), size, digest,
                header_value(head, "WARC-Refers-To"),
            )

        yield from _batched(rows(), schema)

    return read_lines(spark, path).mapInArrow(
        run,
        "id string, record_type string, uri string, date string, row long, payload_bytes long, payload_digest string, "
        "refers_to_id string",
    )


def page_records(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url: one row per page.

    Pages (page_id, url, html) are archived in ARC files, converted to WARC and read back; all
    three steps use the shared scratch folder. Null html is an empty payload. Pages without an id
    are archived, too, and count as the smallest id; rows that repeat an id are records of their own.
    Other columns are not read. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    arcs, warcs = scratch_dir(spark), scratch_dir(spark)
    write_arcs(pages, arcs)
    convert(spark, arcs, warcs)
    records = materialize(read_warcs(spark, warcs).filter("record_type in ('response', 'revisit')"))
    referred = records.filter("record_type = 'response'").select(
        F.col("id").alias("refers_to_id"), F.col("row").alias("refers_to")
    )
    revisits = records.filter("refers_to_id is not null").join(referred, "refers_to_id", "left")
    others = records.filter("refers_to_id is null").withColumn("refers_to", F.lit(None).cast("long"))
    return revisits.unionByName(others).select(
        F.col("row").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        "refers_to",
        F.col("uri").alias("url"),
    )
