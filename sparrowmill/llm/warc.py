"""Web archives (WARC 1.1) as a chunked record table.

Writing: every task streams its rows into one archive, record by record.  A payload above ``chunk_bytes`` is written as a first
segment and ``continuation`` records, as the standard's segmentation has it, so no record is larger than a chunk.  Archives go to a
shared folder under a name of their own for every attempt; only those that the written manifest names count, so attempts of lost
executors leave nothing behind that is read.

Reading: every task streams archives of the manifest and yields a row (record id, chunk number, payload bytes, digest so far) for
each segment; the digest is carried from chunk to chunk, so neither side holds a whole oversized payload in its archive form.

Payloads that occur more than once (from ``least_bytes`` bytes on): of the rows with the largest id that with the largest URL is the
``response``, all others are ``revisit`` records without a block that refer to it.  Repeated rows are records of their own, so of equal
rows one is the response and the others revisit it.  Rows are counted before anything else is decided, so payloads travel once for each
id and digest, and those of revisits aren't written.  A null payload counts as empty; a null id is smaller than all others.  An empty
table gives no archives and no rows; other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.llm.common import Scratch

CHUNK_BYTES = 1 << 20
CRLF = b"\r\n"
CHUNKS = "record_id string, page_id long, chunk_no int, record_type string, refers_to long, data binary, running_digest string, last boolean, total long, url string"


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


#: Parts that the rows of one id, digest and URL are counted in, so that very many equal rows aren't one row of the counts.
SALTS = 32
DECIDED = ("page_id", "url", "sha", "len", "record_type", "refers_to", "refers_to_url", "ordinal")


def plan(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", least_bytes: int = 0) -> DataFrame:
    """A row for each record, without payloads; see ``DECIDED``.  ``ordinal`` is 0 for the one response of a payload.

    Equal rows are counted first.  The largest id of a digest is a partial aggregate, and the join back is one that adaptive execution
    splits on hot digests."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.sha1(payload(payload_col)).alias("sha"), F.length(payload(payload_col)).cast("long").alias("len"))
    rows = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    seen = scratch.cut(rows.groupBy("page_id", "url", "sha", "len", "salt").agg(F.count(F.lit(1)).alias("n")), "seen")
    order = lambda: F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", F.col("url").isNotNull().alias("has_url"), "url", "salt")
    top = seen.groupBy("sha").agg(F.max(order()).alias("top"))
    both = seen.join(top, "sha").withColumn("first", F.col("top") == order()).withColumn("small", F.col("len") < least_bytes)
    each = both.withColumn("ordinal", F.explode(F.sequence(F.when(F.col("first"), 0).otherwise(1), F.col("n") - F.col("first").cast("long"))))
    each = each.filter("ordinal >= 0").withColumn("revisit", ~F.col("small") & ~(F.col("first") & (F.col("ordinal") == 0)))
    of_revisit = lambda c: F.when(F.col("revisit"), c)
    ordinal = F.when(F.col("first") & (F.col("ordinal") == 0), F.lit(0)).otherwise(F.col("ordinal") * SALTS + F.col("salt") + 1)
    kind = F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type")
    return each.select("page_id", "url", "sha", "len", kind, of_revisit(F.col("top.page_id")).alias("refers_to"), of_revisit(F.col("top.url")).alias("refers_to_url"), ordinal.alias("ordinal"))


def payload(col: str):
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record_id(page_id, sha_hex: str, ordinal: int = 0, url: str | None = None) -> str:
    """``ordinal`` and the URL tell repeated rows apart; the response that others refer to has ordinal 0 and no URL in its name."""
    name = f"{page_id}/{sha_hex}" + (f"/{ordinal}/{url}" if ordinal else "")
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _target(name: str, url: str | None) -> list[tuple[str, str]]:
    return [] if url is None else [(name, url if url.isprintable() else quote(url))]


class ArchiveWriter:
    """Streams records into one gzip-per-record archive, led by a ``warcinfo`` record."""

    def __init__(self, sink, chunk_bytes: int = CHUNK_BYTES, date: str = "1970-01-01T00:00:00Z") -> None:
        self.sink, self.chunk, self.date = sink, chunk_bytes, date
        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")]
        self._member(info, b"format: WARC File Format 1.1\r\n")

    def _member(self, fields: list[tuple[str, str]], block) -> None:
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        head = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"Content-Length: %d\r\n\r\n" % len(block)
        for part in (z.compress(head), z.compress(block), z.compress(CRLF + CRLF), z.flush()):
            self.sink.write(part)

    def add(self, page_id, url: str | None, sha_hex: str, record_type: str, refers_to, data, total: int | None = None, refers_to_url: str | None = None, ordinal: int = 0) -> None:
        """``data``: the payload; of a revisit only its length (``total``) and digest are written."""
        total = len(data) if total is None else total
        rid = record_id(page_id, sha_hex, ordinal, url)
        fields = [("WARC-Type", record_type), ("WARC-Record-ID", rid), ("WARC-Date", self.date), ("X-Page-ID", "" if page_id is None else str(page_id))]
        fields += _target("WARC-Target-URI", url)
        if url is not None and (not url.isprintable() or url.strip() != url):
            fields.append(("X-URL-JSON", json.dumps(url)))
        fields += [("WARC-Payload-Digest", "sha1:" + b32(bytes.fromhex(sha_hex))), ("X-Payload-Length", str(total))]
        if record_type == "revisit":
            fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, sha_hex))]
            fields += [*_target("WARC-Refers-To-Target-URI", refers_to_url), ("WARC-Refers-To-Date", self.date), ("X-Refers-To-Page", "" if refers_to is None else str(refers_to))]
            self._member(fields, b"")
            return
        fields.append(("Content-Type", "text/html; charset=utf-8"))
        view = memoryview(data)
        parts = max(1, -(-total // self.chunk))
        self._member(fields + [("WARC-Segment-Number", "1")] * (parts > 1), view[: self.chunk])
        for k in range(1, parts):
            last = [("WARC-Segment-Total-Length", str(total))] * (k == parts - 1)
            more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{rid}/{k}')}>"), ("WARC-Date", self.date)]
            self._member([*more, ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", str(k + 1)), *last], view[k * self.chunk : (k + 1) * self.chunk])


def _members(source, read_bytes: int = 1 << 18):
    """Yield (header fields, block) of each record of an archive; one record is in memory at a time."""
    z, buf, raw = zlib.decompressobj(31), bytearray(), b""
    while True:
        raw = raw or source.read(read_bytes)
        if not raw:
            if buf:
                raise ValueError("archive ends within a record")
            return
        buf += z.decompress(raw)
        raw = b""
        if z.eof:
            raw, z = z.unused_data, zlib.decompressobj(31)
            head, _, rest = bytes(buf).partition(CRLF + CRLF)
            lines = head.decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            n = int(fields["Content-Length"])
            if len(rest) != n + 4 or rest[n:] != CRLF + CRLF:
                raise ValueError(f"record of {len(rest) - 4} bytes announces {n}")
            yield fields, rest[:n]
            buf = bytearray()


def read_archive(source):
    """Rows of the chunk table of one archive, in order: see ``CHUNKS``.  Continuations follow their first segment."""
    digest = None
    rid = page = total = url = None
    for fields, block in _members(source):
        kind = fields["WARC-Type"]
        if kind == "warcinfo":
            continue
        if kind == "continuation":
            if fields["WARC-Segment-Origin-ID"] != rid:
                raise ValueError("a continuation without its first segment")
            chunk_no, last = int(fields["WARC-Segment-Number"]) - 1, "WARC-Segment-Total-Length" in fields
        else:
            digest, seen, chunk_no = hashlib.sha1(), 0, 0
            rid, page = fields["WARC-Record-ID"], int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None
            total, claimed = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
            last = "WARC-Segment-Number" not in fields
            url = json.loads(fields["X-URL-JSON"]) if "X-URL-JSON" in fields else fields.get("WARC-Target-URI")
        if kind == "revisit":
            yield rid, page, 0, kind, int(fields["X-Refers-To-Page"]) if fields["X-Refers-To-Page"] else None, b"", claimed, True, total, url
            continue
        digest.update(block)
        seen += len(block)
        if last and (seen != total or b32(digest.copy().digest()) != claimed):
            raise ValueError(f"payload of {rid} doesn't match its digest")
        yield rid, page, chunk_no, "response", None, block, b32(digest.copy().digest()), last, total, url


def write(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", chunk_bytes: int = CHUNK_BYTES, least_bytes: int = 0) -> DataFrame:
    """Write archives of all rows; returns the written manifest (uri, records)."""
    folder, date = scratch.path("archives"), datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    decided = scratch.cut(plan(pages, scratch, id_col, payload_col, url_col, least_bytes), "decided")
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    # the one shuffle of payloads; of equal rows one travels
    held = pages.select(key(id_col).alias("key"), F.sha1(payload(payload_col)).alias("sha"), payload(payload_col).alias("data")).groupBy("sha", "key").agg(F.first("data").alias("data"))
    responses = decided.filter("record_type = 'response'").withColumn("key", key("page_id")).join(held, ["sha", "key"]).select(*DECIDED, "data")
    joined = responses.unionByName(decided.filter("record_type = 'revisit'").withColumn("data", F.lit(b"")))

    def run(batches):
        sink = uri = None
        n = 0
        for b in batches:
            if b.num_rows and sink is None:
                fs, path = _filesystem(folder)
                fs.create_dir(path, recursive=True)
                name = f"part-{uuid.uuid4().hex}.warc.gz"
                uri, sink = f"{folder}/{name}", fs.open_output_stream(f"{path}/{name}", compression=None)
                writer = ArchiveWriter(sink, chunk_bytes, date)
            data = b.column(len(DECIDED))
            for i in range(b.num_rows):
                page, url, sha, total, kind, to, to_url, ordinal = (b.column(k)[i].as_py() for k in range(len(DECIDED)))
                writer.add(page, url, sha, kind, to, data[i].as_buffer(), total, to_url, ordinal)
                n += 1
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"uri": [uri], "records": pa.array([n], pa.int64())})

    return scratch.cut(joined.mapInArrow(run, "uri string, records long"), "manifest")


def read(manifest: DataFrame, partitions: int, digests_only: bool = False) -> DataFrame:
    """The chunk table of all archives of a manifest; ``digests_only`` leaves the payload bytes out."""
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.bool_(), pa.int64(), pa.string()]

    def run(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, path = _filesystem(uri)
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as source:
                    for r in read_archive(source):
                        rows.append((*r[:5], b"" if digests_only else r[5], *r[6:]))
                        held += len(r[5]) * (not digests_only) + 100
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return manifest.select("uri").repartition(partitions).mapInArrow(run, CHUNKS)


def page_rows(spark: SparkSession, pages: DataFrame, partitions: int) -> DataFrame:
    """Round trip: write archives, read them back, and give one row per record with its full payload's length and digest."""
    s = Scratch(spark, "warc")
    chunks = read(write(pages, s), partitions, digests_only=True)
    return chunks.filter("last").select("page_id", "url", F.col("total").alias("payload_bytes"), F.col("running_digest").alias("payload_digest"), "record_type", "refers_to")
