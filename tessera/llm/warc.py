"""WARC archives: write captures, read them back, assemble each transaction.

A capture is a request, a response (or a revisit of an earlier equal payload) and a metadata record; request and metadata
name the response in WARC-Concurrent-To.  Records are lines of Spark's text sink whose line separator is the two
CRLF that end a WARC record, so the files are plain WARC/1.1 (gzip as a whole).  Reading parses the files as streams by
Content-Length, one file per task at a time, then joins the records through their identifiers into one nested row.

Of records with equal payloads of at least ``revisit_from`` bytes, the one with the smallest page_id is the response.  A revisit
holds no payload; its digest and length headers are those of the full payload.

Defined results: null html is an empty payload; null page_ids stay null and count as larger than any other; repeated rows
are captures of their own, the first of ties a revisit's target is the same page_id; a null url gives no target header;
control characters and blanks of a url are percent-encoded; an empty table gives no record and no row.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import row_chunks, scratch_path, text_of, written

CRLF = "\r\n"
CAPTURES_A_FILE = 3000
DATE = "1970-01-01T00:00:00Z"  # the tables hold no time


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each five hex digits are four base-32 digits in another alphabet."""
    digits = F.sha1(payload)
    fours = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*fours), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uri(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"[\x00-\x1f\x7f]", "%0A"), " ", "%20")


def _record(kind, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """Headers whose value is null are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: <"), record_id, F.lit(">")),
             F.lit(f"WARC-Date: {DATE}"), *[F.concat(F.lit(f"{k}: "), v) for k, v in headers],
             F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)


def with_revisits(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Adds payload_bytes, payload_digest and refers_to (the response's page_id; null for responses).

    First pages of payloads that occur twice or more are found by partial aggregation over digests alone and written; the
    join back is one of two plain tables, so it is broadcast if small and split by AQE where a payload is hot."""
    payload = text_of("html").cast("binary")
    full = pages.withColumns({"payload_bytes": F.octet_length(payload).cast("long"), "payload_digest": base32_sha1(payload)})
    thin = full.where(F.col("payload_bytes") >= revisit_from).select("page_id", "payload_digest", "payload_bytes")
    firsts = (thin.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))
              .where("n > 1 and first_page is not null").drop("n"))
    firsts = written(firsts, "first-pages")
    joined = full.join(firsts, ["payload_digest", "payload_bytes"], "left")
    return joined.withColumn("refers_to", F.when(~F.col("first_page").eqNullSafe(F.col("page_id")), F.col("first_page"))).drop("first_page")


def records(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Three records of each page as rows of one string each."""
    rows = with_revisits(pages.select("page_id", "url", "html"), revisit_from).withColumn("capture", F.uuid())
    urn = lambda part: F.concat(F.lit(f"urn:uuid:{part}-"), F.col("capture"))
    uri = ("WARC-Target-URI", _uri(F.col("url")))
    to = ("WARC-Concurrent-To", F.concat(F.lit("<"), urn("response"), F.lit(">")))
    page = F.col("page_id").cast("string")
    host = F.coalesce(F.regexp_extract(_uri(F.col("url")), r"^[a-z]+://([^/?#]+)", 1), F.lit(""))
    request = F.concat(F.lit("GET "), F.coalesce(_uri(F.col("url")), F.lit("/")), F.lit(" HTTP/1.1" + CRLF + "Host: "), host, F.lit(CRLF + CRLF))
    head = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    revisit = F.col("refers_to").isNotNull()
    payload = F.when(revisit, F.lit("")).otherwise(text_of("html"))
    return rows.select(F.explode(F.array(
        _record(F.lit("request"), urn("request"), [uri, to, ("Content-Type", F.lit("application/http; msgtype=request"))], request),
        _record(F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), urn("response"),
                [uri, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), ("X-Payload-Length", F.col("payload_bytes").cast("string")),
                 ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
                 ("X-Refers-To-Page", F.col("refers_to").cast("string")), ("Content-Type", F.lit("application/http; msgtype=response"))],
                F.concat(head, payload)),
        _record(F.lit("metadata"), urn("metadata"), [uri, to, ("Content-Type", F.lit("application/warc-fields"))],
                F.concat(F.coalesce(F.concat(F.lit("page-id: "), page, F.lit(CRLF)), F.lit("")), F.lit("software: tessera" + CRLF))),
    )).alias("value"))


def write_archives(pages: DataFrame, out: str, revisit_from: int = 0) -> None:
    (records(pages, revisit_from).write.option("lineSep", CRLF + CRLF).option("compression", "gzip")
     .option("maxRecordsPerFile", 3 * CAPTURES_A_FILE).text(out))


# ---- reading --------------------------------------------------------------------------------------------------------


class _Stream:
    """Bytes of a gzip (or plain) file, inflated as they are asked for."""

    def __init__(self, content: bytes, step: int = 1 << 18):
        self.content, self.at, self.step, self.buffer = memoryview(content), 0, step, bytearray()
        self.inflate = zlib.decompressobj(47) if content[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.content):
            return False
        piece = bytes(self.content[self.at:self.at + self.step])
        self.at += len(piece)
        while self.inflate and piece:
            self.buffer += self.inflate.decompress(piece)
            piece = self.inflate.unused_data  # another gzip member
            if piece:
                self.inflate = zlib.decompressobj(47)
        self.buffer += piece
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (i := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark))
            if not self._more():
                return None
        return self.take(i + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("a record is cut off")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def parse(content: bytes):
    """(headers by lower-case name, block) of each record of a file."""
    stream = _Stream(content)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        first, *lines = head[:-4].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record: {first[:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        block = stream.take(int(headers.get("content-length", 0)))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield headers, block


RECORD = ("record_type string, record_id string, concurrent_to string, uri string, page_id long, payload_bytes long, payload_digest string, "
          "refers_to long, payload binary")


def _parsed(keep_payload: bool):
    def fields(headers, block):
        kind = headers.get("warc-type")
        payload, page, size, digest = None, None, None, None
        if kind in ("response", "revisit"):
            body = block.partition(b"\r\n\r\n")[2]
            digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
            size = int(headers["x-payload-length"]) if "x-payload-length" in headers else None
            if kind == "response":
                size, own = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                if digest not in (None, own):
                    raise ValueError("a payload does not match its digest")
                digest, payload = own, body if keep_payload else None
        elif kind == "metadata":
            for line in block.decode("utf-8", "replace").split("\r\n"):
                if line.startswith("page-id: "):
                    page = int(line[9:])
        refers = headers.get("x-refers-to-page")
        return (kind, headers.get("warc-record-id"), headers.get("warc-concurrent-to"), headers.get("warc-target-uri"), page, size, digest,
                int(refers) if refers else None, payload)

    def run(batches):
        import pyarrow as pa
        types = [pa.string()] * 4 + [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in RECORD.split(", ")]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

        for (contents,) in row_chunks(batches, ["content"], 1):
            rows, held = [], 0
            for headers, block in parse(contents[0]):
                rows.append(fields(headers, block))
                held += len(block) if keep_payload else 0
                if len(rows) >= 2000 or held > 1 << 24:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)
    return run


def read_archives(spark, path: str, keep_payload: bool = True) -> DataFrame:
    """All records of the archives as rows; a response's digest and length are taken from its payload."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parsed(keep_payload), RECORD)


def transactions(rows: DataFrame) -> DataFrame:
    """One nested row per capture, (capture, response, request, metadata, n_records), joined through the concurrent-to identifiers.

    All records of a capture come together by one grouping: a response by its own id, partners by the id they name.  Of
    several of a kind the one of least (record_id, uri, page_id) is taken and n_records counts them all; a kind that is missing is
    null, so partners of a response the archive lacks keep a row; a record that names none is a capture of its own."""
    rows = written(rows.where("record_type in ('response', 'revisit', 'request', 'metadata')"), "warc-records")
    own = F.col("record_type").isin("response", "revisit")
    named = F.when(own, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    nameless = F.concat(F.lit("none-"), F.xxhash64(*rows.columns).cast("string"))
    rows = rows.withColumn("capture", F.coalesce(named, nameless))
    nested = F.struct(*[c for c in rows.columns if c not in ("concurrent_to", "capture")])
    rank = F.struct("record_id", "uri", "page_id", "payload_digest")
    pick = lambda name, kind: F.min_by(F.when(kind, nested), F.when(kind, rank)).alias(name)
    return rows.groupBy("capture").agg(pick("response", own), pick("request", F.col("record_type") == "request"),
                                       pick("metadata", F.col("record_type") == "metadata"), F.count("*").alias("n_records"))


def round_trip(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Write the archives to the shared folder, read them back and assemble the captures, without their payloads."""
    out = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, out, revisit_from)
    return transactions(read_archives(pages.sparkSession, out, keep_payload=False))
