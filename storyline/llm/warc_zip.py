"""WARC records in ZIP packages: written by tasks, found through central directories, read by ranges.

A package holds stored (uncompressed) members: WARC files, each record a gzip member of its own, and an index of one JSON line for each record.
A reader takes the end of the file, parses the central directory (and the ZIP64 one where numbers don't fit), finds the members' data, and then
reads only the ranges that it needs. Nothing is unpacked to disk, and no package is read whole into memory.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple
from uuid import uuid4

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_dicts, arrow_rows, shared_dir, shuffle_partitions

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: A package is closed when its records have so many bytes; a reader's range has so many at most, unless one record is longer.
PACKAGE_BYTES, RANGE_BYTES = 32 << 20, 4 << 20
#: Bytes of packages that a task reads, about.
TASK_BYTES = 2 * RANGE_BYTES
#: Payloads shorter than this are stored again each time.
LEAST_REVISIT = 100
MANIFEST = "path string, bytes long, records long"
RECORDS = "path string, offset long, record_type string, record_id string, target_uri string, refers_to string, payload binary, payload_bytes long, payload_digest string"


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


# Writing


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:sha256:{digest}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A gzip member with a response, or with a revisit of page ``refers_to``, which has no payload of its own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    press = zlib.compressobj(4, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()


def _packages(folder: str, size: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zipfile import ZIP_STORED, ZipFile, ZipInfo

        fs, base = _opened(folder)
        # The attempt is in the name: a task that is run again can't spoil what another attempt has handed on.
        name = f"{base}/part-{TaskContext.get().partitionId():05d}-{TaskContext.get().taskAttemptId()}"

        def rows() -> Iterator[tuple]:
            found, n = arrow_dicts(batches, 64), 0
            row = next(found, None)
            while row is not None:
                path, index, at = f"{name}-{n:04d}.zip", [], 0
                with fs.open_output_stream(path) as out, ZipFile(out, "w", ZIP_STORED) as package:
                    with package.open(ZipInfo(DATA), "w", force_zip64=True) as data:
                        while row is not None and at < size:
                            data.write(raw := record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"]))
                            index.append(json.dumps({"filename": DATA, "offset": at, "length": len(raw)}))
                            at += len(raw)
                            row = next(found, None)
                    package.writestr(ZipInfo(INDEX), "".join(x + "\n" for x in index))
                yield f"{folder.rstrip('/')}/{path.rpartition('/')[2]}", at, len(index)
                n += 1

        yield from arrow_rows(rows(), MANIFEST)

    return write


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to) of each row; refers_to is the smallest id with an equal payload, if that is another row's.

    A null payload is empty. Payloads under LEAST_REVISIT bytes and rows with a null id refer to nothing, nor are they referred to. Repeated rows are
    a record each; of rows that share their id none is another's revisit. Other columns, whatever their names, are left out. No rows: no rows.
    """
    payload = F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b""))
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256))
    long = own.where((F.length("payload") >= LEAST_REVISIT) & F.col("page_id").isNotNull())
    groups = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    other = (F.col("first") != F.col("page_id")) & (F.length("payload") >= LEAST_REVISIT)
    return own.join(groups, "digest", "left").select("page_id", "url", "payload", "digest", F.when(other, F.col("first")).alias("refers_to"))


def write_packages(pages: DataFrame, folder: str | None = None, package_bytes: int = PACKAGE_BYTES, **columns: str) -> DataFrame:
    """Write a record for each page into packages in ``folder`` (one of its own in the shared folder if None); (path, bytes, records) of each.

    The list is a table beside the packages, written as Spark commits it: only packages of tasks that ended well are in it.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid4().hex}"
    fs, base = _opened(folder)
    fs.create_dir(base, recursive=True)
    with_revisits(pages, **columns).mapInArrow(_packages(folder, package_bytes), MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


# Reading


class Member(NamedTuple):
    name: str
    offset: int
    size: int


def members(file, size: int) -> list[Member]:
    """Stored members of a ZIP file: name, place of the data, bytes. ``file`` has read_at(bytes, offset)."""
    tail_at = max(0, size - 22 - 65_535 - 20)
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    n, length, offset = struct.unpack("<HII", tail[end + 10 : end + 20])
    if n == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        locator = tail[end - 20 : end]
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        wide = file.read_at(56, struct.unpack("<Q", locator[8:16])[0])
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        n, length, offset = struct.unpack("<QQQ", wide[32:56])
    directory, at, out = file.read_at(length, offset), 0, []
    for _ in range(n):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("central directory is damaged")
        flags, method = struct.unpack("<HH", directory[at + 8 : at + 12])
        packed, real, n_name, n_extra, n_note = struct.unpack("<IIHHH", directory[at + 20 : at + 34])
        local = struct.unpack("<I", directory[at + 42 : at + 46])[0]
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        real, packed, local = _wide_fields(extra, real, packed, local)
        if method == 0 and not flags & 1:
            head = file.read_at(30, local)
            out.append(Member(name, local + 30 + sum(struct.unpack("<HH", head[26:30])), packed))
        at += 46 + n_name + n_extra + n_note
    return out


def _wide_fields(extra: bytes, *values: int) -> list[int]:
    """The values, those that don't fit 32 bits from the ZIP64 extra field, in its order."""
    at, wide = 0, b""
    while at + 4 <= len(extra):
        kind, n = struct.unpack("<HH", extra[at : at + 4])
        if kind == 1:
            wide = extra[at + 4 : at + 4 + n]
        at += 4 + n
    out = []
    for v in values:
        if v == 0xFFFFFFFF:
            v, wide = struct.unpack("<Q", wide[:8])[0], wide[8:]
        out.append(v)
    return out


def _walked(file, m: Member) -> Iterator[tuple[int, int]]:
    """(offset, length) of the gzip members of a stored file that no index lists."""
    at, end = m.offset, m.offset + m.size
    while at < end:
        size, press = 0, zlib.decompressobj(31)
        while not press.eof:
            piece = file.read_at(min(1 << 16, end - at - size), at + size)
            if not piece:
                raise ValueError("a record is cut short")
            press.decompress(piece)
            size += len(piece) - len(press.unused_data)
        yield at, size
        at += size


def locate(file, size: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of each record of a package, by its indexes, and by reading through WARC files that no index has."""
    found = members(file, size)
    listed = set()
    by_name = {m.name: m for m in found}
    for m in found:
        if m.name.startswith("indexes/"):
            for line in file.read_at(m.size, m.offset).splitlines():
                x = json.loads(line[line.find(b"{") :])
                listed.add(x["filename"])
                yield by_name[x["filename"]].offset + int(x["offset"]), int(x["length"])
    for m in found:
        if m.name.endswith(".warc.gz") and m.name not in listed:
            yield from _walked(file, m)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for x in arrow_dicts(batches):
            fs, path = _opened(x["path"])
            with fs.open_input_file(path) as file:
                start, lengths = 0, []
                for at, n in locate(_Ranged(file), file.size()):
                    if lengths and (start + sum(lengths) != at or sum(lengths) + n > RANGE_BYTES):
                        yield x["path"], start, struct.pack(f"<{len(lengths)}Q", *lengths)
                        lengths = []
                    start = start if lengths else at
                    lengths.append(n)
                if lengths:
                    yield x["path"], start, struct.pack(f"<{len(lengths)}Q", *lengths)

    yield from arrow_rows(rows(), "path string, start long, lengths binary")


class _Ranged:
    """read_at of an Arrow file."""

    def __init__(self, file):
        self.file = file

    def read_at(self, n: int, offset: int) -> bytes:
        return bytes(self.file.read_at(n, offset)) if n else b""


def parsed(raw: bytes) -> tuple:
    """record_type, record_id, target_uri, refers_to, payload, payload_bytes, payload_digest of a record's gzip member."""
    text = zlib.decompress(raw, 31)
    head, _, rest = text.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        fields[k.strip().lower().decode()] = v.strip().decode("utf-8", "surrogatepass")
    block = rest[: int(fields["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    response = fields["warc-type"] == "response"
    digest = fields.get("warc-payload-digest", "").partition(":")[2] or None
    n = len(payload) if response else int(fields["warc-payload-length"]) if "warc-payload-length" in fields else None
    return fields["warc-type"], fields["warc-record-id"], fields.get("warc-target-uri"), fields.get("warc-refers-to"), payload if response else None, n, digest


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for x in arrow_dicts(batches, 16):
            lengths = struct.unpack(f"<{len(x['lengths']) // 8}Q", x["lengths"])
            fs, path = _opened(x["path"])
            with fs.open_input_file(path) as file:
                held, at = _Ranged(file).read_at(sum(lengths), x["start"]), 0
            for n in lengths:
                yield x["path"], x["start"] + at, *parsed(held[at : at + n])
                at += n

    yield from arrow_rows(rows(), RECORDS, 1000)


def read_packages(packages: DataFrame) -> DataFrame:
    """Records of the packages whose ``path`` is listed: RECORDS. Ranges of records, not packages, are dealt to the tasks that read them.

    As ranges are few bytes that stand for many, the number of tasks follows from the packages' ``bytes`` if the list has them. payload is null for
    revisits; payload_bytes and payload_digest are those of the full payload. A record that is longer than a range is read by itself. Other columns
    are left out. No packages: no rows.
    """
    tasks = shuffle_partitions(packages.sparkSession)
    if "bytes" in packages.columns:
        tasks = -(-(packages.agg(F.sum("bytes")).first()[0] or 1) // TASK_BYTES)
    ranges = packages.select("path").mapInArrow(_ranges, "path string, start long, lengths binary")
    return ranges.repartition(tasks, "path", "start").mapInArrow(_read, RECORDS)


def page_records(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of records of pages; a response's digest is that of the bytes read."""
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    return records.select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return page_records(read_packages(write_packages(pages)))
