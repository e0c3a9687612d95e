"""ZIP-packaged web archives: a writer and a range reader.

A package is a ZIP file with stored (uncompressed) members: ``archive/data.warc.gz``,
a WARC file with one gzip member for each record, and ``indexes/index.cdxj``, a
line for each record with its offset and length in that file.

Reading.  One task per package reads the end of the file, finds the end of
the central directory (with its ZIP64 locator and record where the numbers
do not fit 16 or 32 bits), parses the central directory, takes the place of
each stored member from its local header, and reads the index member: this
gives a row for each record with its byte range in the package.  These rows
are dealt anew, and every task reads the ranges of its own records and no
others; nothing is extracted.  A package of many records is thus read by
many tasks, and a range that a lost executor had is read again.

Writing.  Pages are dealt by a hash of their id over packages whose size is
bounded by their number.  Which record is a response and which a revisit is
decided before, by the payload digest; a revisit keeps the HTTP header (with
its Content-Length) and refers to the response, and carries no payload.  A
package is written under a temporary name and then moved to its name, which
depends on its content's keys only, so a task that runs again replaces it.

Files are opened with pyarrow's file systems (file, hdfs, s3, gs): packages
lie in the shared folder, which every executor sees.

Defined results.  A null html is an empty payload.  Rows that repeat a
page_id are records of their own; the largest id of equal payloads is the
response, and of rows that repeat that id one is.  A null page_id is written
without a page id and is a response only when no other page has its payload.
A null url is written as an empty target.  An empty table writes no package.
A broken package (no end record, cut member, wrong digest) raises an error
that names the file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlake.llm.common import salt, salted_totals, save
from textlake.llm.words import bounded_batches
from textlake.session import shared_dir

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2000-01-01T00:00:00Z"  # records carry no time of their own; a fixed one keeps packages reproducible


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- writing ---------------------------------------------------------------

def record(kind: str, record_id: str, page_id: str, url: str, payload: bytes, payload_sha: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record, as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{record_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url),
            ("WARC-Payload-Digest", f"sha1:{payload_sha}"), ("WARC-Page-ID", page_id)]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {' '.join(v.splitlines())}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 6, mtime=0)


class Package:
    """A package being written: records pass through to the data member, the index follows."""

    def __init__(self, folder: str, name: str):
        self.path, self.name = f"{folder}/{name}", name
        self.store, self.root = open_fs(folder)
        self.store.create_dir(self.root, recursive=True)
        self.temp = f"{self.root}/.{name}-{uuid.uuid4().hex}"
        self.sink = self.store.open_output_stream(self.temp)
        self.zip = zipfile.ZipFile(_Stream(self.sink), "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index, self.at = [], 0

    def add(self, key: str, data: bytes) -> None:
        self.member.write(data)
        self.index.append(f"{key} {json.dumps({'filename': DATA, 'offset': self.at, 'length': len(data)})}\n")
        self.at += len(data)

    def close(self) -> tuple[str, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(self.index))
        self.zip.close()
        self.sink.close()
        self.store.move(self.temp, f"{self.root}/{self.name}")
        return self.path, len(self.index)


class _Stream:
    """What zipfile needs of a sink that can't seek: sizes follow the data."""

    def __init__(self, sink):
        self.write, self.flush = sink.write, sink.flush


def _write_packages(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by package; one package is open at a time."""
        now, number, done = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if now is None or row["package"] != number:
                    if now:
                        done.append(now.close())
                    number = row["package"]
                    now = Package(folder, f"part-{number:06d}.wacz")
                page = "" if row["page_id"] is None else str(row["page_id"])
                kind = "revisit" if row["refers_to"] is not None else "response"
                now.add(page or "-", record(kind, page, page, row["url"] or "", (row["html"] or "").encode(),
                                            base64.b32encode(row["sha"]).decode(), row["refers_to"]))
        if now:
            done.append(now.close())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())],
                                         names=["path", "records"])
    return write


def dealt_pages(rows: DataFrame, lead: DataFrame, packages: int) -> DataFrame:
    """``rows`` with ``refers_to`` and ``package``, each package's rows together and sorted.

    The html is dealt once: a page's lead comes to it as a row without html, that
    the join with ``lead`` makes and that sorts before the page's own.
    """
    page = ["page_id", "url", "sha"]
    marks = rows.select(*page, "salt").join(lead, on=["sha", "salt"]).select(*page, F.lit(None).cast("string").alias("html"), "lead")
    both = rows.select(*page, "html", F.lit(None).cast("long").alias("lead")).unionByName(marks)
    # by page, so that the pages of one payload spread over all packages
    number = F.pmod(F.xxhash64(*page), F.lit(packages))
    # as many tasks as the session has for a shuffle; each writes its packages one after another
    both = both.withColumn("package", number).repartition("package")
    so_far = Window.partitionBy("package", *page).orderBy(F.col("html").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    refers_to = F.when(F.col("lead").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("lead")), F.col("lead").cast("string"))
    return (both.withColumn("lead", F.max("lead").over(so_far)).where("html IS NOT NULL")
            .select("page_id", "url", "html", "sha", refers_to.alias("refers_to"), "package")
            .sortWithinPartitions("package", "page_id", "url"))


def write_packages(pages: DataFrame, folder: str | None = None, records_per_package: int = 1000, id_col: str = "page_id",
                   url_col: str = "url", html_col: str = "html", salts: int = 64) -> DataFrame:
    """Write ``pages`` as packages of about ``records_per_package`` records under
    ``folder``; returns (path, records), a row for each package."""
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = (folder or shared_dir(spark, "llm", "packages")).rstrip("/")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumns({"sha": F.unhex(F.sha1("html")), "salt": salt("page_id", "url", salts=salts)})
    # the response of each payload: (digest, salt) first, so a payload that very many pages have is not gathered
    lead = save(salted_totals(rows.select("page_id", "sha", "salt"), ["sha"], salts,
                              [F.max("page_id").alias("lead"), F.count(F.lit(1)).alias("n")],
                              [F.max("lead").alias("lead"), F.sum("n").alias("n")]), "page-leads")
    n = lead.select("sha", "n").distinct().agg(F.sum("n")).first()[0] or 0
    packages = max(1, -(-n // records_per_package))
    dealt = dealt_pages(rows, lead, packages)
    return save(dealt.mapInArrow(_write_packages(folder), "path string, records bigint"), "packages")


# --- reading ---------------------------------------------------------------

def central_directory(source: pa.NativeFile, path: str) -> dict[str, tuple[int, int, int]]:
    """Members by name: (method, stored size, offset of the local header)."""
    size = source.size()
    tail = source.read_at(min(size, 65_557), max(0, size - 65_557))
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and end + 22 + int.from_bytes(tail[end + 20:end + 22], "little") != len(tail):
        end = tail.rfind(b"PK\x05\x06", 0, end)  # the mark inside a comment
    if end < 0:
        raise ValueError(f"{path}: no end of central directory")
    n, length, start = struct.unpack_from("<HII", tail, end + 10)
    if n == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = source.read_at(20, size - len(tail) + end - 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError(f"{path}: no ZIP64 locator")
        record64 = source.read_at(56, struct.unpack_from("<Q", locator, 8)[0])
        if record64[:4] != b"PK\x06\x06":
            raise ValueError(f"{path}: no ZIP64 end of central directory")
        n, length, start = struct.unpack_from("<QQQ", record64, 32)
    directory = source.read_at(length, start)
    members, at = {}, 0
    for _ in range(n):
        if directory[at:at + 4] != b"PK\x01\x02":
            raise ValueError(f"{path}: broken central directory")
        method, = struct.unpack_from("<H", directory, at + 10)
        stored, full, name_len, extra_len, comment_len = struct.unpack_from("<IIHHH", directory, at + 20)
        offset, = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46:at + 46 + name_len].decode()
        extra, x = directory[at + 46 + name_len:at + 46 + name_len + extra_len], 0
        while x + 4 <= len(extra):  # ZIP64 numbers stand in for those that are all ones, in this order
            kind, width = struct.unpack_from("<HH", extra, x)
            if kind == 1:
                y = x + 4
                if full == 0xFFFFFFFF:
                    y += 8
                if stored == 0xFFFFFFFF:
                    stored, = struct.unpack_from("<Q", extra, y)
                    y += 8
                if offset == 0xFFFFFFFF:
                    offset, = struct.unpack_from("<Q", extra, y)
            x += 4 + width
        members[name] = (method, stored, offset)
        at += 46 + name_len + extra_len + comment_len
    return members


def member_range(source: pa.NativeFile, path: str, member: tuple[int, int, int]) -> tuple[int, int]:
    """Where a stored member's bytes lie: offset, length."""
    method, stored, offset = member
    if method != 0:
        raise ValueError(f"{path}: a compressed member can't be read by ranges")
    local = source.read_at(30, offset)
    if local[:4] != b"PK\x03\x04":
        raise ValueError(f"{path}: no local header at {offset}")
    name_len, extra_len = struct.unpack_from("<HH", local, 26)
    return offset + 30 + name_len + extra_len, stored


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, name = open_fs(path)
            with store.open_input_file(name) as source:
                members = central_directory(source, path)
                index_at, index_len = member_range(source, path, members[INDEX])
                entries = [json.loads(line.split(b" ", 1)[1]) for line in source.read_at(index_len, index_at).splitlines()]
                places = {m: member_range(source, path, members[m]) for m in {e["filename"] for e in entries}}
            for e in entries:
                if e["offset"] + e["length"] > places[e["filename"]][1]:
                    raise ValueError(f"{path}: a record beyond the end of {e['filename']}")
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(entries), pa.string()), pa.array(range(len(entries)), pa.int64()),
                 pa.array([places[e["filename"]][0] + e["offset"] for e in entries], pa.int64()),
                 pa.array([e["length"] for e in entries], pa.int64())], names=["path", "number", "offset", "length"])


def parse_record(data: bytes, path: str) -> dict:
    """Headers, HTTP content length and payload of one gzipped WARC record."""
    try:
        text = zlib.decompress(data, 31)
        head, _, rest = text.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
        block = rest[:int(fields["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        length = next(int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    except (zlib.error, KeyError, StopIteration, ValueError) as e:
        raise ValueError(f"{path}: broken record ({e})") from e
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or digest(payload) != said):
        raise ValueError(f"{path}: payload and digest of {fields['WARC-Record-ID']} differ")
    refers = fields.get("WARC-Refers-To", "").removeprefix("<urn:page:").removesuffix(">")
    return {"page_id": int(fields["WARC-Page-ID"]) if fields["WARC-Page-ID"] else None, "url": fields["WARC-Target-URI"],
            "record_type": fields["WARC-Type"], "payload_bytes": length, "payload_digest": said,
            "refers_to": int(refers) if refers else None,
            "payload": payload if fields["WARC-Type"] == "response" else None}


RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                    ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _read_ranges(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source, out, held = None, None, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != path:
                    if source:
                        source.close()
                    path = row["path"]
                    store, name = open_fs(path)
                    source = store.open_input_file(name)
                got = parse_record(source.read_at(row["length"], row["offset"]), path)
                if not with_payload:
                    got["payload"] = None
                out.append(got)
                held += len(got["payload"] or b"") + 200
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(out, RECORD)
                    out, held = [], 0
        if source:
            source.close()
        yield pa.RecordBatch.from_pylist(out, RECORD)
    return read


def read_packages(packages: DataFrame, with_payload: bool = True, run: int = 64) -> DataFrame:
    """The records of the packages named in the column ``path``: page_id, url,
    record_type, payload_bytes, payload_digest, refers_to, payload (null for
    revisits).  Runs of ``run`` records go to one task in file order."""
    ranges = packages.select("path").repartition("path").mapInArrow(_locate, "path string, number bigint, offset bigint, length bigint")
    runs = (ranges.withColumn("run", F.floor(F.col("number") / run)).repartition("path", "run")
            .sortWithinPartitions("path", "number"))
    return runs.mapInArrow(_read_ranges(with_payload), "page_id bigint, url string, record_type string, payload_bytes bigint, "
                           "payload_digest string, refers_to bigint, payload binary")


def list_packages(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the packages under a folder, as Spark's file source lists them."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "*.wacz").load(folder).select("path"))
