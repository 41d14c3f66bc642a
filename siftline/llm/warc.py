"""WARC archives as Spark jobs: write records, read them back, resolve revisits.

An archive is a bounded run of WARC/1.1 records, one gzip member each, held as
(archive, data) rows; ``export`` writes them as plain .warc.gz files. Revisits are
resolved on headers alone: (id, digest, length) rows are grouped by digest and
length, which pre-aggregates in each task, so a page that a third of the crawl
repeats costs one row per task. Only the verdicts that a page is a revisit are then
joined to the payloads, by id and digest; where they are too many to broadcast, the
payloads are shuffled once for it, by keys that no page repeats.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_batch, slices, stored, table

#: An archive is closed once it holds so many compressed bytes.
ARCHIVE_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"
_CRLF = b"\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def write_record(kind: str, key: str, uri: str, payload: bytes, digest: str, refers_to: str | None = None, refers_uri: str | None = None) -> bytes:
    """One record as a gzip member. A revisit carries the digest and what it refers to, and no payload."""
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: " + record_id(key).encode(), b"WARC-Date: " + DATE.encode(), b"WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A").encode(), b"X-Page-Key: " + quote(key, safe=" ").encode(), b"WARC-Payload-Digest: sha1:" + digest.encode()]
    if kind == "revisit":
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + record_id(refers_to).encode(), b"X-Refers-To-Key: " + quote(refers_to, safe=" ").encode()]
        block, http = b"", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Content-Length: %d\r\n\r\n" % len(payload)
    else:
        block, http = payload, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + block
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(body)]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(_CRLF.join(head) + _CRLF * 2 + body + _CRLF * 2) + pack.flush()


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record of an archive. A broken record raises ValueError."""
    while data:
        gz = zlib.decompressobj(31)
        raw = gz.decompress(data) + gz.flush()
        data = gz.unused_data
        head, gap, rest = raw.partition(_CRLF * 2)
        lines = head.split(_CRLF)
        if lines[0] != b"WARC/1.1" or not gap or not gz.eof:
            raise ValueError("not a WARC record")
        fields = dict(x.decode().split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        if len(rest) != size + 4 or rest[size:] != _CRLF * 2:
            raise ValueError(f"record {fields.get('WARC-Record-ID')}: wrong length")
        http, _, payload = rest[:size].partition(_CRLF * 2)
        fields["X-Content-Length"] = next(x.split(b": ")[1].decode() for x in http.split(_CRLF) if x.lower().startswith((b"content-length", b"x-content-length")))
        if fields["WARC-Type"] == "response" and f"sha1:{base32_sha1(payload)}" != fields["WARC-Payload-Digest"]:
            raise ValueError(f"record {fields['WARC-Record-ID']}: digest differs")
        yield fields, payload


def headers(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """(id, digest, bytes) of each page: what the shuffle of the resolution moves."""
    data = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    return pages.select(F.col(id_col).alias("id"), F.unhex(F.sha1(data)).alias("digest"), F.octet_length(data).cast("long").alias("bytes"))


def resolve(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(digest, bytes, first): the smallest id of each payload of at least min_bytes; rows with a null id never are the first."""
    return heads.filter(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.min("id").alias("first"))


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[bytes] = []
    size = 0

    def full() -> pa.RecordBatch:
        data = b"".join(held)
        return pa.record_batch({"archive": pa.array([hashlib.sha256(data).hexdigest()[:24]]), "records": pa.array([len(held)], pa.int64()), "data": pa.array([data], pa.binary())})

    for batch in slices(batches, 256):
        for row in batch.to_pylist():
            payload = (row["payload"] or "").encode("utf-8", "surrogatepass")
            first = row["first"]
            revisit = first is not None and row["id"] is not None and first != row["id"]
            held.append(write_record("revisit" if revisit else "response", "" if row["id"] is None else str(row["id"]), row["uri"] or "", payload, base64.b32encode(row["digest"]).decode(), str(first) if revisit else None))
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield full()
                held.clear()
                size = 0
    if held:
        yield full()


def write_archives(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Deduplicated archives of the pages, as (archive, records, data) rows.

    Each page gives one record. Of pages with equal payloads of at least
    min_bytes the one with the smallest id is the response; the others refer to
    it. A page without id is always a response; rows that repeat the smallest id
    with the same payload are responses too. Null payloads count as empty.
    """
    data = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), F.col(payload_col).alias("payload")).withColumn("digest", F.unhex(F.sha1(F.coalesce("payload", F.lit("")).cast("binary")))).withColumn("bytes", F.octet_length(F.coalesce("payload", F.lit("")).cast("binary")).cast("long"))
    firsts = resolve(rows.select("id", "digest", "bytes"), min_bytes)
    copies = rows.select("id", "digest", "bytes").join(firsts, ["digest", "bytes"]).filter("id != first").select("id", "digest", "first").distinct()
    return rows.join(copies, ["id", "digest"], "left").select("id", "uri", "payload", "digest", "first").mapInArrow(_archives, "archive string, records long, data binary")


def _rows(id_type: str) -> Callable:
    of = unquote if id_type == "string" else int

    def run(batch: pa.RecordBatch):
        rows = []
        for data in batch.column("data").to_pylist():
            for fields, payload in read_records(data):
                key, refers = fields["X-Page-Key"], fields.get("X-Refers-To-Key")
                rows.append((of(key) if key else None, fields["WARC-Target-URI"], int(fields["X-Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], of(refers) if refers else None, payload))
                if len(rows) == 256:
                    yield _batch(rows, id_type)
                    rows = []
        if rows:
            yield _batch(rows, id_type)

    return run


def _batch(rows: list[tuple], id_type: str) -> pa.RecordBatch:
    names = ("page_id", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    own = pa.string() if id_type == "string" else pa.int64()
    kinds = (own, pa.string(), pa.int64(), pa.string(), pa.string(), own, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def read_archives(archives: DataFrame, id_type: str = "long") -> DataFrame:
    """One row per record; lengths and response digests are verified, and a broken archive fails the job. A revisit's payload is empty; an empty string as id reads as null."""
    return archives.select("data").mapInArrow(by_batch(_rows(id_type), 1), f"page_id {id_type}, uri string, payload_bytes long, payload_digest string, record_type string, refers_to {id_type}, payload binary")


def export(archives: DataFrame, folder: str) -> None:
    """Each archive as a file <archive>.warc.gz in a folder that all executors share."""

    def write(batch: pa.RecordBatch):
        for row in batch.to_pylist():
            with open(f"{folder}/{row['archive']}.warc.gz", "wb") as f:
                f.write(row["data"])
        yield batch.select(["archive"])

    archives.select("archive", "data").mapInArrow(by_batch(write, 8), "archive string").count()


def op8_warc_revisits(spark, sf_dir: str) -> DataFrame:
    kept = stored(write_archives(table(spark, sf_dir, "pages")), "warc", "none")
    return read_archives(kept).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
