"""WARC archives in Zstandard with an embedded dictionary.

A dictionary is built from a bounded sample of the records (``sample_pages`` payloads, picked by a hash of page_id, the first
16 KiB of each, compressed as records would be). Each file begins with it in a skippable frame (magic 0x184D2A5D); then every record is a frame of its own
that can be read alone. Of equal payloads of 100 bytes or more the smallest page_id is the response; the others are revisits
that name it. Shorter payloads are all responses. Record ids are UUIDs of file and place, so no two are equal; a revisit names its
response by page_id, address and date.

Null html is an empty payload. Rows that repeat a page_id with equal payload are judged alike (both response, or both
revisits of the same page). A null page_id is never referred to unless no other page has the payload; it is then a response.
A page is one record, of one frame, whatever its length. Other columns are not read. An empty table gives no archives.

Readers take frames by ranges of an index, some megabytes a task; the index tells only where frames begin.
"""

from __future__ import annotations

import struct
import uuid
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, scratch_path, small_batches, spread_join, written
from .files import Output, read_at

MAGIC = 0x184D2A5D
LEAST_REVISIT = 100
DICTIONARY_BYTES = 64 << 10
SAMPLE_CHARS = 16 << 10
FILE_BYTES = 256 << 20
#: Frames of about so many bytes of a file are read in one go.
RANGE_BYTES = 1 << 20


def record(page_id, url: str, html: bytes, digest: str, refers_to, refers_url: str | None, date: str, place: str) -> bytes:
    """One WARC/1.1 record. A revisit's block is empty; its payload is that of the record it names."""
    kind = "response" if refers_to is None else "revisit"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + html if refers_to is None else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>", f"WARC-Target-URI: {one_line(url)}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(html)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To-Target-URI: {one_line(refers_url)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-ID: {refers_to}"]
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def one_line(x) -> str:
    return " ".join(str(x or "").split())


def parsed(data: bytes) -> tuple[dict, bytes]:
    """Headers and payload of a record."""
    head, _, block = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = block[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2] if block else b""


def dictionary(pages: DataFrame, sample_pages: int = 1000, size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary of the sampled records; empty where there are too few to train on."""
    import hashlib

    import zstandard

    total = pages.count()
    if not total:
        return b""
    share = int(min(1.0, sample_pages / total) * 1_000_000) or 1
    some = pages.filter(F.pmod(F.xxhash64(F.col("page_id").cast("string"), F.lit("dictionary")), F.lit(1_000_000)) < share)
    rows = some.select("page_id", F.col("url").cast("string"), F.substring(F.coalesce(F.col("html").cast("string"), F.lit("")), 1, SAMPLE_CHARS)).limit(2 * sample_pages).collect()  # a bounded sample
    samples = []
    for page_id, url, html in sorted(rows, key=lambda r: (str(r[0]), str(r[2]))):
        data = html.encode("utf-8", "surrogatepass")
        samples.append(record(page_id, url, data, hashlib.sha256(data).hexdigest(), None, None, "1970-01-01T00:00:00Z", str(page_id)))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too small samples
        return b""


def classified(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_digest, refers_to, refers_url. Digests are grouped with partial sums; hot payloads are spread."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"))
    rows = rows.withColumn("payload_digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("_long", F.octet_length("html") >= LEAST_REVISIT)
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    known = written(rows.filter("_long").groupBy("payload_digest").agg(first.alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "payloads")
    out = spread_join(rows, known, "payload_digest", "_n", pages.count(), ("page_id", "url"), "left")
    first_id = F.col("_first.page_id")
    other = F.col("_long") & first_id.isNotNull() & ((F.col("page_id") > first_id) | F.col("page_id").isNull())
    return out.select("page_id", "url", "html", "payload_digest", F.when(other, first_id).alias("refers_to"), F.when(other, F.col("_first.url")).alias("refers_url"))


def write_archives(pages: DataFrame, folder: str, level: int = 3, date: str | None = None) -> DataFrame:
    """Write the archives; returns their index: uri, offset and bytes of each frame, by page_id."""
    import zstandard

    spark = pages.sparkSession
    small_batches(spark, 128)
    words = dictionary(pages)
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        part, file, number = TaskContext.get().partitionId(), None, 0
        made = {"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}
        squeeze = zstandard.ZstdCompressor(level=level, write_checksum=True, **made)
        for batch in batches:
            out: list = []
            for page_id, url, html, digest, refers_to, refers_url in zip(*(batch.column(j).to_pylist() for j in range(6))):
                if file is not None and file.at >= FILE_BYTES:
                    file.close()
                    file, number = None, number + 1
                if file is None:
                    file = Output(folder, f"part-{part:05d}-{number:04d}", ".warc.zst")
                    file.write(struct.pack("<II", MAGIC, len(words)) + words)
                frame = squeeze.compress(record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to, refers_url, date, f"{file.uri}#{file.at}"))
                out.append((file.uri, file.write(frame), len(frame)))
            yield pa.RecordBatch.from_pydict({k: pa.array([r[j] for r in out], t) for j, (k, t) in enumerate((("uri", pa.string()), ("offset", pa.int64()), ("bytes", pa.int64())))})
        if file is not None:
            file.close()

    return written(classified(pages).mapInArrow(run, "uri string, offset long, bytes long"), "warc-index")


def read_archives(index: DataFrame) -> DataFrame:
    """A row a record, from the archives alone: page_id, payload_bytes, payload_digest, record_type, refers_to, html.

    Payloads of responses are hashed anew and held against the header; a revisit has its payload's length and digest.
    """
    import hashlib

    ranges = index.groupBy("uri", F.floor(F.col("offset") / RANGE_BYTES)).agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("bytes")).alias("end"))
    ranges = ranges.select("uri", "start", "end", (F.col("end") - F.col("start")).alias("bytes"))

    def run(batches):
        import zstandard

        expand: dict = {}
        for batch in batches:
            for uri, start, end in zip(*(batch.column(j).to_pylist() for j in range(3))):
                with read_at(uri) as f:
                    if uri not in expand:
                        magic, size = struct.unpack("<II", f.read_at(8, 0))
                        if magic != MAGIC:
                            raise ValueError("the file has no dictionary frame")
                        expand[uri] = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(f.read_at(size, 8))} if size else {}))
                    f.seek(start)
                    yield from records(f, end, expand[uri])

    def records(f, end, expand):
        rows, held, rest = [], 0, b""
        more = lambda: f.read(min(1 << 17, end - f.tell()))
        while True:
            rest = rest or more()
            if not rest:
                break
            one, done = expand.decompressobj(), []
            while not one.eof:
                done.append(one.decompress(rest))
                rest = one.unused_data if one.eof else more()
                if not rest and not one.eof:
                    raise ValueError("the file ends within a record")
            fields, payload = parsed(b"".join(done))
            response = fields["WARC-Type"] == "response"
            digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
            if response and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError("a payload differs from its digest")
            refers = None if response else int(fields["X-Refers-To-Page-ID"])
            n = len(payload) if response else int(fields["X-Payload-Length"])
            rows.append((int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None, n, digest, fields["WARC-Type"], refers, payload.decode("utf-8", "surrogatepass") if response else None))
            held += n
            if len(rows) >= 256 or held >= 1 << 23:
                yield batch_of(rows)
                rows, held = [], 0
        if rows:
            yield batch_of(rows)

    kinds = (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string()))

    def batch_of(rows):
        return pa.RecordBatch.from_pydict({k: pa.array([r[j] for r in rows], t) for j, (k, t) in enumerate(kinds)})

    return dealt(ranges, "bytes").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


def archive_and_read(pages: DataFrame) -> DataFrame:
    return read_archives(write_archives(pages, scratch_path(pages.sparkSession, "warc")))
