"""WARC writing and reading: one gzip member for each record, read one after the other in bounded memory.

The writer gives each task its own archive in a folder that the cluster shares and returns a manifest; only archives of
tasks that succeeded are in it. The reader streams an archive: it inflates member by member with zlib, frames the record
by its Content-Length, and checks the digest of its payload while it passes by.

Equal payloads of at least min_bytes are stored once, as the response with the largest page_id; the others are revisit
records that name it. Null or empty html is an empty payload; null urls become about:blank. Repeated page_ids give
repeated records; of rows with the largest id and the same payload one is the response (the first by url), the others
revisit it. Payloads of rows without a page_id are stored whole. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, ship, work_folder

CHUNK = 1 << 16                 # bytes read from an archive, or inflated, at a time
SALTS = 32                      # parts of a group of equal payloads
LINE = 1 << 20                  # longest header block of a record
FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload_ok boolean"


class WarcError(ValueError):
    """A record that is cut short, or whose digest differs from its payload."""


def plan(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Rows (page_id, url, html, digest, refers_to): refers_to is null for responses.

    Keepers are found by partial maxima over (digest, salt), then over the digest, so no group of copies meets in one
    task; the lookup is salted in the same way."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.select("*", F.sha1("html").alias("digest"), (F.octet_length("html") >= min_bytes).alias("large"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    parts = rows.where("large and page_id is not null").groupBy("digest", "salt").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    groups = (parts.groupBy("digest").agg(F.max("keeper").alias("keeper"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts"))
              .where("n > 1").select("digest", "keeper", F.explode("salts").alias("salt")))
    out = rows.join(groups, ["digest", "salt"], "left")
    out = out.select("page_id", "url", "html", "digest", "keeper", F.when(F.col("keeper") != F.col("page_id"), F.col("keeper")).alias("refers_to"))
    twins = rows.where("large and page_id is not null").groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twins = saved(twins.select("digest", F.col("page_id").alias("keeper"), F.lit(True).alias("twin")), "twin-pages")
    if not twins.isEmpty():         # rows of the largest id that share a payload are numbered; all but the first revisit
        out = out.join(twins, ["digest", "keeper"], "left").withColumn("twin", F.coalesce(F.col("twin") & (F.col("keeper") == F.col("page_id")), F.lit(False)))
        tied = saved(out.where("twin").withColumn("number", F.monotonically_increasing_id()), "tied-pages")
        first = tied.groupBy("digest", "keeper").agg(F.min(F.struct("url", "number")).alias("first"))
        tied = tied.join(first, ["digest", "keeper"]).withColumn("refers_to", F.when(F.col("first.number") != F.col("number"), F.col("keeper")))
        out = out.where("not twin").select("page_id", "url", "html", "digest", "refers_to").union(tied.select("page_id", "url", "html", "digest", "refers_to"))
    return out.select("page_id", "url", "html", "digest", "refers_to")


def header(fields: list[tuple[str, object]], first: str) -> bytes:
    return (first + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def record(page: int | None, url: str | None, html: str, digest: str, refers: int | None) -> bytes:
    """One gzip member."""
    payload = html.encode("utf-8", "surrogatepass")
    head = header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))], "HTTP/1.1 200 OK")
    block = head + (payload if refers is None else b"")
    target = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "about:blank")
    fields: list[tuple[str, object]] = [
        ("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    if refers is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers}>"),
                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(header(fields, "WARC/1.1") + block + b"\r\n\r\n") + pack.flush()


def write(planned: DataFrame, folder: str) -> DataFrame:
    """Write the archives; the manifest (path, records) is itself kept in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, path = None, 0, ""
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for page, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path = f"{base}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                out.write(record(page, url, html, digest, refers))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path.removeprefix(base).lstrip("/")], "records": [n]},
                                             pa.schema([("path", pa.string()), ("records", pa.int64())]))

    columns = planned.select("page_id", "url", "html", "digest", "refers_to")
    return saved(columns.mapInArrow(run, "path string, records long"), "warc-manifest")


class Members:
    """The bytes of one gzip member after another, inflated as they are asked for."""

    def __init__(self, stream):
        self.stream, self.rest, self.inflate, self.ready = stream, b"", None, bytearray()

    def next_member(self) -> bool:
        """Begin the next member; False at the end of the archive."""
        if not self.rest:
            self.rest = self.stream.read(CHUNK)
        self.inflate, self.ready = zlib.decompressobj(31), bytearray()
        return bool(self.rest)

    def more(self) -> bool:
        """Inflate some more of this member; False when it has ended."""
        if self.inflate.eof:
            return False
        if not self.rest:
            self.rest = self.stream.read(CHUNK)
            if not self.rest:
                raise WarcError("the archive ends inside a member")
        self.ready += self.inflate.decompress(self.rest, CHUNK)
        self.rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        at = 0
        while (found := self.ready.find(mark, max(0, at - len(mark)))) < 0:
            at = len(self.ready)
            if at > LINE or not self.more():
                raise WarcError("a header has no end")
        out = bytes(self.ready[:found])
        del self.ready[: found + len(mark)]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.ready and not self.more():
                raise WarcError("a block is shorter than its Content-Length")
            out = bytes(self.ready[:n])
            del self.ready[: len(out)]
            n -= len(out)
            if out:
                yield out


def headers(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")[1:])}


def page_of(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def records(stream, keep: bool = False) -> Iterator[dict]:
    """Read an archive record by record. With keep=True the payload comes along."""
    members = Members(stream)
    while members.next_member():
        if not (start := members.until(b"\r\n\r\n")).startswith(b"WARC/1."):
            raise WarcError("a record does not start with its version")
        head = headers(start)
        left, http, digest, size, payload = int(head["content-length"]), b"", hashlib.sha1(), 0, []
        inside = members.pieces(left)
        while b"\r\n\r\n" not in http:
            http += next(inside, b"")
            left = len(http)
            if left > LINE or left == int(head["content-length"]) and b"\r\n\r\n" not in http:
                raise WarcError("an HTTP header has no end")
        http, _, first = http.partition(b"\r\n\r\n")
        for piece in chain([first], inside):
            digest.update(piece)
            size += len(piece)
            if keep:
                payload.append(piece)
        if b"".join(members.pieces(4)) != b"\r\n\r\n" or members.ready or members.more() and members.ready:
            raise WarcError("a record is longer than its Content-Length")
        told = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
        kind = head["warc-type"]
        length = int(headers(http)["content-length"])
        ok = kind == "revisit" and size == 0 or digest.hexdigest() == told and size == length
        if not ok:
            raise WarcError(f"the payload of record {head['warc-record-id']} differs from its digest")
        yield {"page_id": page_of(head["warc-record-id"]), "url": head["warc-target-uri"], "payload_bytes": length, "payload_digest": told,
               "record_type": kind, "refers_to": page_of(head.get("warc-refers-to")), "payload_ok": ok} | ({"payload": b"".join(payload)} if keep else {})


def read(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the archives in the manifest; an archive is read by one task, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                           ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_ok", pa.bool_())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{base}/{path}", compression=None) as stream:
                    for row in records(stream):
                        rows.append(row)
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    files = manifest.select("path").repartition(max(1, manifest.count()))
    return files.mapInArrow(run, FIELDS)


def round_trip(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Write one record for each page, then read the archives back."""
    folder = work_folder(pages.sparkSession, "warc")
    return read(pages.sparkSession, write(plan(pages, min_bytes), folder), folder)


ship(__name__)
