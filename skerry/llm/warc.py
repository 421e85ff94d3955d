"""Deduplicated WARC archives with revisit records.

Of the pages with equal payloads, one is archived as ``response`` and the
others as ``revisit`` records without a payload, which refer to it. Headers
(digest, length, id; no payload) are shuffled by payload digest to find each
group's response. The table of groups is joined back to the pages: broadcast,
if its counted rows prove it small, else shuffled. The records get fresh
headers and are written through Spark's own text writer, so any store that
Spark can reach will do, in gzip files of bounded bytes. Reading parses the
archives by their ``Content-Length`` and checks every digest; revisits are
resolved by joining them to the responses.
"""

from __future__ import annotations

import hashlib
import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A record of a WARC/1.1 file ends with two line breaks.
RECORD_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of payloads per archive, and the payload size up to which pages share
#: archives; larger ones are written apart, fewer to a file.
ARCHIVE_BYTES = 256 << 20
USUAL_BYTES = 128 << 10
#: Groups of equal payloads up to this number (about 80 bytes each) are broadcast.
BROADCAST_GROUPS = 500_000


def _uri(url: Column) -> Column:
    """A URL that is safe in a header line: blanks and controls escaped."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7F]", "%20")


def _id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def classify(pages: DataFrame, *, page_id: str, url: str, html: str, min_bytes: int) -> DataFrame:
    """Rows ``(id, url, html, bytes, digest, response)``; ``response`` is the
    id that the row revisits, null if the row is a response itself."""
    body = F.coalesce(common.named(html), F.lit(""))
    rows = pages.select(
        common.named(page_id).alias("id"),
        common.named(url).alias("url"),
        body.alias("html"),
        F.octet_length(body).cast("long").alias("bytes"),
        F.sha1(body.cast("binary")).alias("digest"),
    )
    groups = (
        rows.where(F.col("bytes") >= min_bytes)
        .groupBy("digest")
        .agg(F.max("id").alias("keeper"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("of"), "keeper")
    )
    groups = common.cut(groups)
    # Beyond the bound a hot digest is split by the adaptive skew join: both
    # sides are shuffled for the join alone.
    small = groups.count() <= BROADCAST_GROUPS
    groups = F.broadcast(groups) if small else groups.hint("shuffle_hash")
    joined = rows.join(groups, F.col("digest") == F.col("of"), "left")
    other = F.col("keeper").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("id"))
    return joined.select(
        "id", "url", "html", "bytes", "digest", F.when(other, F.col("keeper")).alias("response")
    )


def record(date: str) -> Column:
    """The record as text, without its end, for a row of :func:`classify`."""
    line = "\r\n"
    again = F.col("response").isNotNull()
    head = F.concat(
        F.lit("WARC/1.1" + line),
        F.when(again, F.lit("WARC-Type: revisit" + line)).otherwise(F.lit("WARC-Type: response" + line)),
        F.lit("WARC-Record-ID: "), _id(F.col("id")), F.lit(line),
        F.lit("WARC-Target-URI: "), _uri(F.col("url")), F.lit(line),
        F.lit(f"WARC-Date: {date}{line}"),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(line),
        F.when(
            again,
            F.concat(
                F.lit("WARC-Refers-To: "), _id(F.col("response")), F.lit(line), F.lit(f"WARC-Profile: {PROFILE}{line}")
            ),
        ).otherwise(F.lit("Content-Type: text/html; charset=utf-8" + line)),
        F.lit("Content-Length: "), F.when(again, F.lit(0).cast("long")).otherwise(F.col("bytes")).cast("string"),
        F.lit(line + line),
    )
    return F.concat(head, F.when(again, F.lit("")).otherwise(F.col("html")))


def write_archives(
    pages: DataFrame,
    path: str,
    *,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_bytes: int = 1000,
    date: str = "2025-01-01T00:00:00Z",
) -> None:
    """Write one record per row of ``pages`` to gzip files below ``path``.

    Files hold at most about ``ARCHIVE_BYTES`` of payloads, or one record.

    Defined cases: a null payload is empty; payloads below ``min_bytes`` are
    always responses; the response of a group is the row with the largest id
    (a null id only if there is no other), and repeated rows of that id are
    responses too; control characters and blanks of a URL are escaped; long
    payloads go to files of their own; an empty table gives archives without
    records; columns of other names play no part.
    """
    longest = pages.agg(F.max(F.octet_length(common.named(html)))).first()[0] or 0
    rows = classify(pages, page_id=page_id, url=url, html=html, min_bytes=min_bytes)
    _write(rows.where(F.col("bytes") <= USUAL_BYTES), f"{path}/usual", USUAL_BYTES, date)
    if longest > USUAL_BYTES:
        _write(rows.where(F.col("bytes") > USUAL_BYTES), f"{path}/long", longest, date)


def _write(rows: DataFrame, path: str, largest: int, date: str) -> None:
    (
        rows.select(record(date).alias("value"))
        .write.mode("overwrite")
        .option("lineSep", RECORD_END)
        .option("compression", "gzip")
        .option("zlib.compress.level", "BEST_SPEED")
        .option("maxRecordsPerFile", max(1, ARCHIVE_BYTES // largest))
        .text(path)
    )


def parse(stream):
    """Yield ``(headers, payload length, payload SHA-1)`` per record.

    ``stream`` yields pieces of an uncompressed archive; a payload is hashed
    piece by piece and never held as a whole.
    """
    buffer = bytearray()
    pieces = iter(stream)

    def more() -> bool:
        piece = next(pieces, None)
        if piece is None:
            return False
        buffer.extend(piece)
        return True

    while True:
        while (at := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer:
                    raise ValueError("archive ends inside a header")
                return
        head = bytes(buffer[:at]).decode("utf-8").split("\r\n")
        del buffer[: at + 4]
        if head[0] != "WARC/1.1":
            raise ValueError(f"not a record: {head[0]!r}")
        headers = dict(x.split(": ", 1) for x in head[1:])
        length = left = int(headers["Content-Length"])
        digest = hashlib.sha1()
        while left:
            if not buffer and not more():
                raise ValueError("archive ends inside a payload")
            part = bytes(buffer[:left])
            digest.update(part)
            del buffer[: len(part)]
            left -= len(part)
        while len(buffer) < 4:
            if not more():
                raise ValueError("archive ends inside a record")
        if buffer[:4] != b"\r\n\r\n":
            raise ValueError("a record is longer than its Content-Length")
        del buffer[:4]
        yield headers, length, digest.hexdigest()


def inflate(data: bytes, step: int = 1 << 20):
    """Uncompressed pieces of a gzip file of one or more members."""
    while data:
        member = zlib.decompressobj(31)
        while not member.eof:
            piece = member.decompress(data, step)
            if not piece and not member.unconsumed_tail and not member.eof:
                raise ValueError("a gzip member is cut short")
            data = member.unconsumed_tail
            if piece:
                yield piece
        data = member.unused_data


HEADERS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_PAGE = re.compile(r"<urn:page:(-?\d*)>")


def _parse_batches(batches):
    import pyarrow as pa

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def number(name: str | None):
        found = _PAGE.fullmatch(name or "")
        return int(found[1]) if found and found[1] else None

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for found in batches:
        for content in found.column("content"):
            rows = []
            for headers, length, digest in parse(inflate(content.as_buffer().to_pybytes())):
                kind, named = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and named != digest:
                    raise ValueError(f"{headers['WARC-Record-ID']}: payload digest differs")
                size = length if kind == "response" else None
                rows.append((number(headers["WARC-Record-ID"]), size, named, kind, number(headers.get("WARC-Refers-To"))))
                if len(rows) >= 10_000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives below ``path``, revisits resolved.

    Returns page_id, payload_bytes and payload_digest (of the full payload;
    a revisit has those of its response), record_type and refers_to.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true")
    files = found.load(path).select("content")
    with common.batches_of(spark, 1):  # a row is a whole file
        records = common.cut(files.mapInArrow(_parse_batches, HEADERS))
    responses = records.where("record_type = 'response'")
    # Only responses that a revisit names are needed to resolve revisits.
    known = (
        responses.groupBy("payload_digest").agg(F.max("payload_bytes").alias("full"))
        .join(
            records.where("record_type = 'revisit'").select("payload_digest").distinct(), "payload_digest", "left_semi"
        )
        .select(F.col("payload_digest").alias("of"), "full")
    )
    known = common.cut(known)
    joined = records.join(
        known, (F.col("payload_digest") == F.col("of")) & (F.col("record_type") == "revisit"), "left"
    )
    return joined.select(
        "page_id",
        F.coalesce("payload_bytes", "full").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
    )


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """All pages, archived with revisits and read back."""
    path = common.shared_dir(spark)
    write_archives(common.table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
k AS (SELECT h, max(page_id) AS keeper FROM p GROUP BY h)
SELECT page_id, payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN keeper END AS refers_to
FROM p JOIN k USING (h)
"""
