"""WARC archives: writer, and a splittable reader.

Every record is a gzip member of its own.  Writing tasks put one archive each
into the shared folder (written under a name of the attempt, then moved, so a
task that is repeated replaces its own file).  Reading tasks take byte ranges:
a task scans its range for the gzip magic, accepts a candidate if it inflates
to a WARC header, and owns the records that start inside the range, reading
past its end for the last one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesearch.llm.frames import record
from pagesearch.session import materialize, shared_dir

SPLIT_BYTES = 16 << 20
REVISIT_BYTES = 0          # payloads of at least this size are revisited
MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 18
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("records", T.LongType())])
RECORDS = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                        T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
                        T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
                        T.StructField("payload", T.BinaryType())])


def filesystem(path: str):
    """The Arrow file system of a folder's URI, and the path in it."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, not compressed.  A revisit keeps the HTTP header, whose
    Content-Length is the payload's size, and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"),
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: " + _DATE]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[%\s]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: " + _PROFILE]
    head += ["WARC-Payload-Digest: sha1:" + digest(payload), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def revisits(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html and refers_to: null for the record with the smallest
    page_id among those of equal payload, and for payloads under ``least_bytes``.
    Rows that repeat the smallest page_id are responses too; where every
    page_id of a payload is null, all are responses."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    sha = F.sha1(F.col("html").cast("binary"))
    # only payloads that occur again; written, so the join knows how few they are
    again = materialize(p.where(F.octet_length("html") >= least_bytes).groupBy(sha.alias("sha")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
                        .where("n > 1").select("sha", "first"), "repeated-payloads")
    j = p.withColumn("sha", sha).join(again, "sha", "left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return j.select("page_id", "url", "html", F.when(other, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html) in ``folder``, a URI that all
    executors reach: (path, bytes, records) of each.  A null html is an empty
    payload; a null url has no target header."""
    def run(batches):
        fs, base = filesystem(folder)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}.warc.gz"
        draft = f"{base}/_draft/{context.taskAttemptId()}-{name}"
        size = n = 0
        fs.create_dir(f"{base}/_draft", recursive=True)
        with fs.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    data = member(warc_record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to))
                    out.write(data)
                    size, n = size + len(data), n + 1
        fs.move(draft, f"{base}/{name}")
        yield record(FILES, [[f"{folder}/{name}"], [size], [n]])
    return materialize(revisits(pages, least_bytes).mapInArrow(run, FILES), "archives")


class Bytes:
    """A window of a file that moves forward, or to a new place."""

    def __init__(self, source, at: int):
        self.source = source
        self.move(at)

    def move(self, at: int) -> None:
        self.at, self.data = at, b""
        self.source.seek(at)

    def more(self) -> bool:
        got = self.source.read(_READ)
        self.data += got
        return bool(got)

    def skip(self, to: int) -> None:
        self.data, self.at = self.data[to - self.at :], to

    def find_magic(self) -> int | None:
        """Place of the next magic at or after ``at``."""
        while (i := self.data.find(MAGIC)) < 0:
            self.skip(self.at + max(0, len(self.data) - len(MAGIC) + 1))
            if not self.more():
                return None
        return self.at + i


def inflate(window: Bytes) -> bytes | None:
    """The member at ``window.at``, and the window behind it; None, and the
    window one byte on, if it isn't a WARC record.  The first bytes decide, and
    the header may have any length.  What is inflated leaves the window, so a
    long member is read once."""
    start, z, out, head = window.at, zlib.decompressobj(31), [], b""
    while not z.eof:
        if not window.data and not window.more():
            break
        try:
            out.append(z.decompress(window.data))
        except zlib.error:
            break
        window.skip(window.at + len(window.data) - len(z.unused_data))
        if len(head) < 7:
            head = (head + out[-1])[:7]
            if not b"WARC/1.".startswith(head):
                break
    else:
        data = b"".join(out)
        if data.startswith(b"WARC/1.") and b"\r\n\r\n" in data:
            return data
    window.move(start + 1)
    return None


def parse(data: bytes) -> tuple:
    """A record's fields in the order of ``RECORDS``; raises if its payload
    doesn't have the size or digest that its headers state."""
    end = data.index(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in data[:end].decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = data[end + 4 : end + 4 + int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    name = fields["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")
    refers = fields.get("WARC-Refers-To", "").removeprefix("<urn:page:").removesuffix(">")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest(payload) != stated):
        raise ValueError(f"record {name}: payload of {len(payload)} bytes doesn't match its header")
    url = fields.get("WARC-Target-URI")
    if url is not None:
        url = re.sub(r"(?:%[0-9A-F]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogatepass"), url)
    return (int(name) if name else None, url, size, stated, kind, int(refers) if refers else None, payload if kind == "response" else None)


def records_in(source, start: int, end: int) -> Iterator[tuple]:
    """The records that start in [start, end) of an open file."""
    window = Bytes(source, start)
    while (at := window.find_magic()) is not None and at < end:
        window.skip(at)
        if (found := inflate(window)) is not None:
            yield parse(found)


def read(spark: SparkSession, files: DataFrame, payload: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of archives given as (path, bytes), by ranges of
    ``split_bytes``.  A revisit has no payload of its own (null), but the size
    and digest of the one it refers to.  No archives give no rows."""
    ranges = (files.where("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
              .withColumn("end", F.col("start") + split_bytes))
    n = ranges.count()
    names = RECORDS.names if payload else RECORDS.names[:-1]
    schema = T.StructType([RECORDS[c] for c in names])

    def run(batches):
        for batch in batches:
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end")), strict=True):
                fs, at = filesystem(path)
                with fs.open_input_file(at) as source:
                    rows, size = [], 0
                    for r in records_in(source, start, end):
                        rows.append(r[: len(names)])
                        size += len(r[-1] or b"") if payload else 100
                        if size > 4 << 20:
                            yield record(schema, list(zip(*rows, strict=True)))
                            rows, size = [], 0
                    if rows:
                        yield record(schema, list(zip(*rows, strict=True)))
    return ranges.repartition(max(1, n), "path", "start").mapInArrow(run, schema)


def round_trip(pages: DataFrame, folder: str | None = None, payload: bool = False) -> DataFrame:
    """Writes ``pages`` as archives and reads them back, one row per page;
    raises if another number of records is read than was written.

    Payloads and urls of any length are archived whole (a header may be longer
    than what is read at a time).  Repeated rows are records of their own.
    Extra columns are not archived, whatever their names; an empty table gives
    no rows."""
    spark = pages.sparkSession
    files = write(pages, folder or shared_dir(spark, "warc"))
    found = materialize(read(spark, files, payload), "warc-records")
    written, n = files.agg(F.sum("records")).first()[0] or 0, found.count()
    if n != written:
        raise RuntimeError(f"{written} records were written, {n} read")
    return found


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, sha1(html) AS hex, octet_length(encode(html)) AS payload_bytes,
        min(page_id) OVER (PARTITION BY html) AS first FROM p),
bits AS (SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda c: substr(
        '0000000100100011010001010110011110001001101010111100110111101111', 1 + 4 * (position(c IN '0123456789abcdef') - 1), 4)), '') AS b FROM s)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(5), lambda k: substr(b, (5 * g + k + 1)::BIGINT, 1)::INT * (16 >> k)))::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id <> first AND payload_bytes >= {REVISIT_BYTES} THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first AND payload_bytes >= {REVISIT_BYTES} THEN first END AS refers_to
FROM bits
"""
