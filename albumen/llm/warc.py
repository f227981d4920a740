"""WARC archives with revisit records for repeated payloads.

Digests and lengths of all payloads are grouped by digest; of equal payloads the one with the smallest id is
written as a response, the others as revisit records that name it. Archives are written by Spark's text
writer, so they commit whole, on any file system, and retried tasks leave no half files. Its row separator
is the end of a WARC record.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumen.llm.common import materialise, new_path

#: Shorter payloads are always stored. Records of a file: bounds what one task reads back.
MIN_BYTES = 100
RECORDS_PER_FILE, FILE_BYTES = 4000, 64 << 20
#: Bytes that are decompressed at a time, and of payloads that a frame of records read back holds.
CHUNK, FRAME_BYTES = 1 << 20, 8 << 20
#: Fixed values of the format.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Crawl time, where the source has none.
DATE = "2000-01-01T00:00:00Z"


def with_digest(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """id, url, payload (null: empty), bytes and digest."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    return pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("bytes"),
        F.sha2(payload, 256).alias("digest"),
    )


def resolve(rows: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """rows (with_digest) with `original` and `original_url`: id and url of the response that a row revisits, or null.

    Only digests, lengths and ids are grouped; partial sums make a payload of any number of copies a few rows
    a task. The groups join back by digest, where AQE splits a large group or broadcasts a small table.
    """
    sized = rows.where(F.col("bytes") >= min_bytes)
    first = sized.groupBy("digest").agg(F.min("id").alias("first"), F.min_by("url", "id").alias("first_url"), F.count("*").alias("n")).where("n > 1")
    first = materialise(first.select("digest", "first", "first_url"), "originals").select(F.col("digest").alias("digest2"), "first", "first_url")
    joined = rows.join(first, (F.col("digest") == F.col("digest2")) & (F.col("bytes") >= min_bytes), "left")
    # A null id never is the original; rows that repeat the original's id are responses too.
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return joined.withColumns({"original": F.when(revisit, F.col("first")), "original_url": F.when(revisit, F.col("first_url"))}).drop("digest2", "first", "first_url")


def record(resolved: DataFrame) -> DataFrame:
    """One column `value`: the records with fresh headers, without their ends."""
    eol, c = F.lit("\r\n"), F.col
    clean = lambda url: F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7F]", "%20")
    revisit = c("original").isNotNull()
    # Pages of one id have records of their own as far as their payloads differ.
    name = F.concat(F.coalesce(c("id").cast("string"), F.lit("null")), F.lit(":"), F.left("digest", F.lit(32)))
    original = F.concat(c("original").cast("string"), F.lit(":"), F.left("digest", F.lit(32)))

    def line(key: str, value) -> F.Column:
        return F.concat(F.lit(f"{key}: "), value, eol)

    def urn(value) -> F.Column:
        return F.concat(F.lit("<urn:page:"), value, F.lit(">"))

    value = F.concat(
        F.lit(VERSION), eol,
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(name)),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", clean(c("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), c("digest"))),
        line("X-Payload-Length", c("bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(original)), line("WARC-Refers-To-Target-URI", clean(c("original_url"))), line("WARC-Refers-To-Date", F.lit(DATE)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, "0").otherwise(c("bytes").cast("string"))),
        eol,
        F.when(revisit, "").otherwise(c("payload")),
    )
    return resolved.select(value.alias("value"))


def records_of_file(rows: DataFrame) -> int:
    """As many as make FILE_BYTES of payload on average (rows: with_digest), RECORDS_PER_FILE at most."""
    mean = rows.agg(F.avg("bytes")).first()[0] or 0
    return max(1, min(RECORDS_PER_FILE, int(FILE_BYTES // (mean + 512))))


def write_archives(resolved: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    record(resolved).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _inflated(data: bytes):
    """The bytes of an archive in chunks: gzipped as one or many members, or not at all."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[at : at + CHUNK] for at in range(0, len(data), CHUNK))
        return
    member, rest = zlib.decompressobj(31), data
    while rest:
        yield member.decompress(rest, CHUNK)
        rest = member.unconsumed_tail
        if member.eof:
            rest, member = member.unused_data, zlib.decompressobj(31)
    yield member.flush()


def parse(data: bytes):
    """(headers with lower-case names, payload) of each record of an archive, of which no more is held at a time than
    a record and a chunk."""
    chunks, held, at = _inflated(data), bytearray(), 0

    def more() -> bool:
        part = next(chunks, None)
        held.extend(part or b"")
        return part is not None

    while True:
        while (head := held.find(b"\r\n\r\n", at)) < 0 and more():
            pass
        if head < 0:
            if at < len(held):
                raise ValueError(f"an archive ends within a record: {bytes(held[at : at + 40])!r}")
            return
        lines = held[at:head].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip(" \t") for k, _, v in (x.partition(":") for x in lines[1:])}
        start, end = head + 4, head + 4 + int(headers["content-length"])
        while len(held) < end + 4 and more():
            pass
        if held[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"{headers.get('warc-record-id')} does not end where its length says")
        yield headers, bytes(held[start:end])
        at = end + 4
        if at > CHUNK:
            del held[:at]
            at = 0


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "payload"]


def _read(batches):
    def frame(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=COLUMNS).astype({"page_id": "Int64", "refers_to": "Int64"})

    for pdf in batches:
        for data in pdf["content"]:
            out, size = [], 0
            for h, payload in parse(bytes(data)):
                kind = h["warc-type"]
                stated = h["warc-payload-digest"].removeprefix("sha256:")
                if kind == "response" and hashlib.sha256(payload).hexdigest() != stated:
                    raise ValueError(f"payload of {h['warc-record-id']} does not match its digest")
                page, refers = (None if x is None or x == "null" else int(x) for x in (_number(h["warc-record-id"]), _number(h.get("warc-refers-to", ""))))
                out.append((page, int(h["x-payload-length"]), stated, kind, refers, h["warc-target-uri"], payload.decode("utf-8") if kind == "response" else None))
                size += len(payload)
                if size > FRAME_BYTES:
                    yield frame(out)
                    out, size = [], 0
            yield frame(out)


def _number(urn: str) -> str | None:
    m = re.fullmatch(r"<urn:page:(-?\d+|null)(?::[0-9a-f]*)?>", urn)
    return m[1] if m else None


def read_archives(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, uri, payload (null for revisits) of all records."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(
        _read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, payload string"
    )


def archive(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write pages as archives at `path`, and return them read back.

    Null html is an empty payload; null urls are empty. Payloads under min_bytes are always responses. Rows
    that repeat a page_id are records of their own: those with the original's id are responses like it. A
    null page_id is never an original while a copy has an id. Payloads of any length are read back record by record;
    files are cut by their mean. An empty table gives an archive of no records.
    """
    rows = with_digest(pages)
    write_archives(resolve(rows, min_bytes), path, records_of_file(rows))
    return read_archives(pages.sparkSession, path)


SQL = """
SELECT page_id,
       octet_length(encode(coalesce(html, ''))) AS payload_bytes,
       sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id <> min(page_id) OVER (PARTITION BY coalesce(html, ''))
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id <> min(page_id) OVER (PARTITION BY coalesce(html, ''))
            THEN min(page_id) OVER (PARTITION BY coalesce(html, '')) END AS refers_to
FROM pages
"""


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written as a record and read back. Null columns, repeated ids and an empty table: as archive() says."""
    out = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
