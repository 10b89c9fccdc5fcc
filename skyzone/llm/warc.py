"""WARC archives, index first: records are written with an index of (file, offset, length, url,
digest), and reads fetch the index's byte ranges, sorted and coalesced.

Each task writes archives of its own, one gzip member a record, named by partition and attempt; the
index names the file of the attempt that was committed, so files of lost attempts are never read.
Readers take the index sorted by file and offset, join ranges that lie within ``GAP`` bytes of each
other into reads of at most ``READ`` bytes, and check every payload against its digest.

Equal payloads of at least ``least`` bytes: the record of the largest page_id is a response, all
others are revisits that hold headers alone and refer to it.  Equality is by SHA-1, met by a join
that Spark can split where one payload is very frequent.

Defined cases: null html is an empty payload; null urls are empty; line ends within urls are
percent-encoded; rows with equal page_id and payload are all of the response's kind; null page_ids
are written as such and come back null, and refer to the largest id of their payload, where there is
one; very long payloads are one record each, read by themselves; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, stored
from ..shared import fresh

GAP = 64 << 10
READ = 8 << 20
ROLL = 1 << 30
INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string, refers_to long"
READ_BACK = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def judged(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, refers_to (null for responses)."""
    own = only(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    own = own.withColumn("sha", F.when(F.octet_length("html") >= least, F.sha1(F.col("html").cast("binary"))))
    # written, so that the join stands by itself and Spark can split a frequent payload's part
    first = stored(own.where("sha IS NOT NULL").groupBy("sha").agg(F.max("page_id").alias("first")), "payloads")
    return own.join(first, "sha", "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> tuple[bytes, str]:
    """One WARC record, not compressed, and the payload's digest."""
    digest = base32_sha1(payload)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + payload if refers_to is None else head
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Target-URI: {url}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.lower()] = value.strip()
    return out


def parse(raw: bytes) -> tuple[int | None, str, bytes | None, int, str, str, int | None]:
    """page_id, url, payload (None for revisits), its length, its digest, type and refers_to."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = _headers(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda name: None if warc[name] == "<urn:page:null>" else int(warc[name].removeprefix("<urn:page:").removesuffix(">"))
    digest = warc["warc-payload-digest"].removeprefix("sha1:")
    n = int(_headers(http)["content-length"])
    if warc["warc-type"] == "revisit":
        return page("warc-record-id"), warc["warc-target-uri"], None, n, digest, "revisit", page("warc-refers-to")
    if len(payload) != n or base32_sha1(payload) != digest:
        raise ValueError(f"record {warc['warc-record-id']} does not match its digest")
    return page("warc-record-id"), warc["warc-target-uri"], payload, n, digest, "response", None


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file://{uri}")


def write_archives(pages: DataFrame, *, least: int = 0) -> DataFrame:
    """Write the archives; the index of all records, read from where it was written."""
    spark = pages.sparkSession
    folder = fresh(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _filesystem(folder)
        task = TaskContext.get()
        name, number, out, at = f"part-{task.partitionId():06d}-{task.taskAttemptId()}", 0, None, 0
        try:
            for batch in batches:
                rows = []
                # payloads one by one, so that a batch is never held twice
                for page_id, own_url, html, refers_to in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html"), batch.column("refers_to").to_pylist()):
                    if out is None or at > ROLL:
                        if out is not None:
                            out.close()
                        store.create_dir(path, recursive=True)
                        file = f"{name}-{number}.warc.gz"
                        out, at, number = store.open_output_stream(f"{path}/{file}", compression=None), 0, number + 1
                    url = (own_url or "").replace("\r", "%0D").replace("\n", "%0A")
                    raw, digest = record(page_id, url, html.as_py().encode(), refers_to)
                    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                    member = packer.compress(raw) + packer.flush()
                    out.write(member)
                    rows.append((page_id, file, at, len(member), own_url, digest, "response" if refers_to is None else "revisit", refers_to))
                    at += len(member)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
                columns = list(zip(*rows)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["page_id", "file", "offset", "length", "url", "digest", "record_type", "refers_to"])
        finally:
            if out is not None:
                out.close()

    # kept as one column of whole paths, so the index is all that a reader needs
    index = judged(pages, least).mapInArrow(write, INDEX).withColumn("file", F.concat(F.lit(folder + "/"), "file"))
    return stored(index, "warc-index")


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP, most: int = READ) -> list[tuple[int, int, list[int]]]:
    """(start, stop, numbers of the ranges within) of the reads that cover sorted (offset, length)."""
    out: list[tuple[int, int, list[int]]] = []
    for k, (offset, length) in enumerate(ranges):
        stop = offset + length
        if out and offset - out[-1][1] <= gap and stop - out[-1][0] <= most:
            first, last, own = out[-1]
            own.append(k)
            out[-1] = (first, max(stop, last), own)
        else:
            out.append((offset, stop, [k]))
    return out


def read_records(index: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """The records that rows of the index name, each checked against its digest."""
    spark = index.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = only(index, "page_id", "file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            rows = batch.to_pylist()
            at = 0
            while at < len(rows):
                file = rows[at]["file"]
                end = at
                while end < len(rows) and rows[end]["file"] == file:
                    end += 1
                own, at = rows[at:end], end
                if file != name:
                    if source is not None:
                        source.close()
                    store, path = _filesystem(file)
                    name, source = file, store.open_input_file(path)
                for start, stop, numbers in coalesced([(r["offset"], r["length"]) for r in own]):
                    source.seek(start)
                    block = source.read(stop - start)
                    out = []
                    for k in numbers:
                        r = own[k]
                        lo = r["offset"] - start
                        _, url, payload, n, digest, kind, refers = parse(zlib.decompress(block[lo : lo + r["length"]], 31))
                        out.append((r["page_id"], n, digest, kind, refers, url, payload if with_payload else None))
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])
        if source is not None:
            source.close()

    return placed.mapInArrow(read, READ_BACK)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return read_records(write_archives(table(spark, sf_dir, "pages"))).drop("url", "payload")


_DIGITS = "".join(f" || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {k}) & 31) + 1, 1)" for k in (15, 10, 5, 0)).removeprefix(" || ")
#: The query as DuckDB SQL; base 32 takes five hexadecimal digits for four of its own.
ORACLE = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS first FROM p)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(list_transform(range(8), lambda g: CAST('0x' || substr(x, CAST(g AS BIGINT) * 5 + 1, 5) AS BIGINT)), lambda v: {_DIGITS}), '') AS payload_digest,
    CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM d"""
