"""WARC archives with revisit resolution.

``write_archive`` hashes every payload, shuffles the headers (id, digest,
length; no payload) by payload digest to find each digest's original, joins
revisits to their original responses and writes archives whose revisit
records have no payload, under fresh headers.  ``read_archive`` reads whole
archive files back record by record, by Content-Length.

Files are written by Spark's text writer: one record is one row (header,
empty line, payload) and the row separator is WARC's ``CRLF CRLF``.  The
payload is the html in UTF-8.  Pages are written in bands by payload size
(``BANDS``), so that a file can be read back whole.

Defined results: a null html is an empty payload; a null url is an empty
target; control characters and blanks of a url are percent-encoded in the
header; rows with a null id are records like any other but the original of a
digest is its smallest id that is not null; rows that repeat the original's
id with the same payload are responses too; an empty table writes an empty
archive, which reads back as no rows; extra columns are not archived.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webrake.llm.common import python_ready, reliable
from webrake.session import checkpoint_dir

CRLF = "\r\n"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def resolve(headers: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Digests that occur more than once with their original:
    ``payload_digest, original`` (smallest id, payload of ``min_bytes`` or more)."""
    return headers.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest") \
        .agg(F.min("id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")


def _uuid(digest: Column) -> Column:
    """A urn:uuid made of a hash's first 32 hex digits."""
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)),
                    F.lit(">"))


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)))


#: Payload sizes from which files hold fewer records: (bytes, records per file).
#: A file stays below about 256 MB, or is one record.
BANDS = ((0, 4_000), (1 << 16, 64), (1 << 22, 1))


def _rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    return pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
                        payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"))


def records(rows: DataFrame, originals: DataFrame, date: str, min_bytes: int) -> DataFrame:
    """One WARC record per row of :func:`_rows` as text: ``record``."""
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).join(originals, "payload_digest", "left")
    revisit = (F.col("payload_bytes") >= min_bytes) & F.col("original").isNotNull() \
        & ~F.col("id").eqNullSafe(F.col("original"))
    key = lambda i: F.sha2(F.concat(F.lit("record:"), F.coalesce(i.cast("string"), F.lit("")),
                                    F.lit(":"), F.col("payload_digest")), 256)
    target = F.col("url")
    for c in [*map(chr, range(33)), "\x7f"]:
        target = F.replace(target, F.lit(c), F.lit(f"%{ord(c):02X}"))
    length = F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")
    head = F.concat(
        F.lit(VERSION + CRLF),
        _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", _uuid(key(F.col("id")))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", target),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _header("WARC-Refers-To", F.when(revisit, _uuid(key(F.col("original"))))),
        _header("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _header("X-Row-Id", F.col("id").cast("string")),
        _header("X-Payload-Length", F.col("payload_bytes").cast("string")),
        _header("X-Refers-To-Row", F.when(revisit, F.col("original").cast("string"))),
        _header("Content-Type", F.lit("text/html; charset=utf-8")),
        _header("Content-Length", length))
    return rows.select(F.concat(head, F.lit(CRLF), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
                       .alias("record"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  date: str = "1970-01-01T00:00:00Z", min_bytes: int = 100, compression: str = "gzip") -> None:
    """Write ``pages`` as WARC files below ``path``, one folder per size band."""
    rows = _rows(pages, id_col, url_col, html_col)
    headers = reliable(rows.select("id", "payload_bytes", F.sha2("payload", 256).alias("payload_digest")))
    originals = reliable(resolve(headers, min_bytes))
    largest = headers.agg(F.max("payload_bytes")).first()[0] or 0
    for k, (least, per_file) in enumerate(BANDS):
        most = BANDS[k + 1][0] if k + 1 < len(BANDS) else None
        if k and largest < least:
            break
        part = rows.where(F.col("payload_bytes") >= least)
        part = part if most is None else part.where(F.col("payload_bytes") < most)
        records(part, originals, date, min_bytes).write.mode("overwrite").option("lineSep", CRLF + CRLF) \
            .option("compression", compression).option("maxRecordsPerFile", per_file).text(f"{path}/band{k}")


def _stream(raw: bytes) -> Iterator[bytes]:
    """The file's bytes in pieces, decompressed when it is gzip."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    view = memoryview(raw)
    d = zlib.decompressobj(31)
    for i in range(0, len(view), 1 << 18):
        piece = bytes(view[i:i + (1 << 18)])
        while piece:
            yield d.decompress(piece)
            piece, d = (d.unused_data, zlib.decompressobj(31)) if d.eof else (b"", d)
    yield d.flush()


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, content) of every record of one archive file."""
    pieces, buf = _stream(raw), bytearray()

    def fill() -> bool:
        for p in pieces:
            if p:
                buf.extend(p)
                return True
        return False

    while True:
        while (end := buf.find(b"\r\n\r\n")) < 0:
            if not fill():
                if buf.strip():
                    raise ValueError("a WARC header without end")
                return
        lines = bytes(buf[:end]).decode("utf-8").split(CRLF)
        if lines[0] != VERSION:
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        head = dict(line.split(": ", 1) for line in lines[1:])
        size = int(head["Content-Length"])
        while len(buf) < end + 4 + size + 4:
            if not fill():
                raise ValueError("a WARC record without end")
        content = bytes(buf[end + 4:end + 4 + size])
        if bytes(buf[end + 4 + size:end + 8 + size]) != b"\r\n\r\n":
            raise ValueError("a WARC record not closed by two CRLF")
        del buf[:end + 8 + size]
        yield head, content


def read_archive(spark: SparkSession, path: str, with_content: bool = False) -> DataFrame:
    """Records of the archives below ``path``: ``record_type, record_id,
    target_uri, payload_digest, refers_to_record, row_id, payload_bytes,
    refers_to_row, content_bytes, content_digest`` (and ``content``).

    ``payload_bytes`` and ``payload_digest`` of a response are taken from the
    content itself and must agree with its header."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                for h, content in parse(batch.column(0)[i].as_py()):
                    digest, size = h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["X-Payload-Length"])
                    if h["WARC-Type"] == "response" and (size, digest) != (
                            len(content), hashlib.sha256(content).hexdigest()):
                        raise ValueError(f"payload of {h['WARC-Record-ID']} does not agree with its header")
                    rows.append((h["WARC-Type"], h["WARC-Record-ID"], h.get("WARC-Target-URI"), digest,
                                 h.get("WARC-Refers-To"), h.get("X-Row-Id"), size, h.get("X-Refers-To-Row"),
                                 len(content), content if with_content else None))
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)

    ddl = "record_type string, record_id string, target_uri string, payload_digest string, refers_to_record string, " \
          "row_id string, payload_bytes bigint, refers_to_row string, content_bytes bigint, content binary"
    names = [c.split()[0] for c in ddl.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*") \
        .option("recursiveFileLookup", "true").load(path).select("content")
    out = python_ready(files).mapInArrow(run, ddl)
    return out if with_content else out.drop("content")


def archive_path(spark: SparkSession) -> str:
    """A fresh archive folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
