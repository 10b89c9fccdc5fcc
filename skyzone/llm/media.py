"""Media columns in content-defined chunks, each stored once.

A payload is a text's UTF-8 bytes with zeros up to a positive multiple of ``UNIT``.  A 32-bit gear
hash rolls over it; a chunk ends where the hash has ``MASK`` zeros and at least ``LEAST`` bytes have
gone by, or after ``MOST`` bytes.  Chunks are named by 128-bit digests.

What is stored of a document is its recipe (digest, length and stored length of every chunk in order)
and its chunks, each compressed by itself, so the form depends on the text alone and equal chunks are
equal wherever they stand.  Digests alone are counted first.  Those that occur more than once set bits
in a filter that grows with their number to 32 MiB at most and goes to every task.  Chunks that miss the filter are unique: they are stored in their document's own pack and
never shuffled.  The others are stored once each, by digest.  To read back, documents without shared
chunks take their stored chunks from their packs alone; the rest fetch shared ones by a join on the
digest.  ``media`` is the recipe and the stored chunks as they were read; the payload is what they
decompress to, checked against the SHA-256 in the pack.  A full filter sends more chunks by the join
and changes no result.

Defined cases: null text is empty and its payload is ``UNIT`` zeros; equal texts give equal values;
equal rows are each rebuilt; null ids stay null; very long texts are cut into as many chunks as they
need; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, filter_bits, lean, only, stored

UNIT = 64
LEAST, MOST, MASK = 512, 8192, (1 << 10) - 1
LEVEL = 6
MAGIC = b"CHUNKS1\n"

_state = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_state = (_state ^ (_state >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
_GEAR = ((_state ^ (_state >> np.uint64(27))) >> np.uint64(32)).astype(np.uint32)


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def cuts(payload: bytes) -> list[int]:
    """Ends of the chunks.  The gear hash is 2 * hash + gear[byte] in 32 bits, so it sums 32 shifted terms; five doublings give them all."""
    h = _GEAR[np.frombuffer(payload, dtype=np.uint8)]
    for k in (1, 2, 4, 8, 16):
        if k < len(h):
            h[k:] += h[:-k] << np.uint32(k)
    marks = np.flatnonzero((h >> np.uint32(16) & np.uint32(MASK)) == 0) + 1
    out, start, n = [], 0, len(payload)
    for m in [*marks.tolist(), n]:
        while m - start > MOST:
            start += MOST
            out.append(start)
        if m - start >= LEAST or (m == n and m > start):
            out.append(m)
            start = m
    return out


def chunks(payload: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) of a payload's chunks."""
    ends = cuts(payload)
    return [(hashlib.blake2b(c, digest_size=16).digest(), c) for c in (payload[a:b] for a, b in zip([0, *ends], ends))]


def frames(parts: list[tuple[bytes, bytes]]) -> list[bytes]:
    """The chunks as they are stored."""
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    return [pack(c) for _, c in parts]


def recipe_of(parts: list[tuple[bytes, bytes]], bodies: list[bytes]) -> bytes:
    return b"".join(d + len(c).to_bytes(4, "little") + len(f).to_bytes(4, "little") for (d, c), f in zip(parts, bodies))


def media(recipe: bytes, bodies: list[bytes]) -> bytes:
    """The stored form: recipe and stored chunks in order."""
    return MAGIC + len(bodies).to_bytes(8, "little") + recipe + b"".join(bodies)


def _slots(digest: bytes, bits: int) -> tuple[int, int]:
    return int.from_bytes(digest[:4], "little") % bits, int.from_bytes(digest[4:8], "little") % bits


def _per_text(docs: DataFrame, emit, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                yield emit(batch.slice(k, 256))

    return only(docs, "doc_id", "text").mapInArrow(lean(run), schema)


def repeated_filter(docs: DataFrame) -> bytes:
    """A filter of the digests that occur more than once."""

    def emit(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d for t in part.column("text") for d, _ in chunks(payload_of(t.as_py()))], pa.binary())], ["digest"])

    repeated = stored(_per_text(docs, emit, "digest binary").groupBy("digest").count().where("count > 1").select(F.hex("digest").alias("d")), "repeated")
    bits = filter_bits(repeated.count())
    at = lambda lo: F.conv(F.concat(*[F.substring("d", lo + k, 2) for k in (6, 4, 2, 0)]), 16, 10).cast("long") % bits
    return bitmap(repeated.select(F.explode(F.array(at(1), at(9))).alias("slot")), bits)


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write the store: packs (doc_id, n_bytes, sha, shared, recipe, there, own) and chunks (digest, body)."""
    found = docs.sparkSession.sparkContext.broadcast(repeated_filter(docs))

    def maybe(digest: bytes) -> bool:
        return all(found.value[s >> 3] >> (s & 7) & 1 for s in _slots(digest, 8 * len(found.value)))

    def common(part: pa.RecordBatch) -> pa.RecordBatch:
        own = {d: c for t in part.column("text") for d, c in chunks(payload_of(t.as_py())) if maybe(d)}
        return pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(frames(list(own.items())), pa.binary())], ["digest", "body"])

    def packs(part: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], [], [], []]
        for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
            payload = payload_of(text)
            parts = chunks(payload)
            bodies, there = frames(parts), bytes(maybe(d) for d, _ in parts)
            own = b"".join(f for f, s in zip(bodies, there) if not s)
            for column, value in zip(out, (doc, len((text or "").encode()), hashlib.sha256(payload).digest(), sum(there), recipe_of(parts, bodies), there, own)):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "n_bytes", "sha", "shared", "recipe", "there", "own"])

    bodies = _per_text(docs, common, "digest binary, body binary").groupBy("digest").agg(F.min("body").alias("body"))
    return stored(_per_text(docs, packs, "doc_id long, n_bytes long, sha binary, shared int, recipe binary, there binary, own binary"), "packs"), stored(bodies, "chunks")


def parsed(recipe: bytes) -> list[tuple[bytes, int, int]]:
    """(digest, length, stored length) of the chunks."""
    return [(recipe[k : k + 16], int.from_bytes(recipe[k + 16 : k + 20], "little"), int.from_bytes(recipe[k + 20 : k + 24], "little")) for k in range(0, len(recipe), 24)]


def rebuilt(recipe: bytes, there: bytes, own: bytes, shared: dict[bytes, bytes], sha: bytes) -> tuple[bytes, bytes, list[bytes]]:
    """The stored form as it was read, the payload, which is checked against its SHA-256, and the chunks' digests."""
    unpack = zstandard.ZstdDecompressor().decompress
    rows = parsed(recipe)
    bodies, at = [], 0
    for (digest, _, n), s in zip(rows, there):
        if s:
            bodies.append(shared[digest])
        else:
            bodies.append(own[at : at + n])
            at += n
    payload = b"".join(map(unpack, bodies))
    if hashlib.sha256(payload).digest() != sha:
        raise ValueError("a rebuilt payload differs from what was stored")
    return media(recipe, bodies), payload, [d for d, _, _ in rows]


def feature(payload: bytes, digests: list[bytes]) -> str:
    n = np.bincount(np.frombuffer(payload, dtype=np.uint8), minlength=256)
    p = n[n > 0] / len(payload)
    return f"chunks={len(digests)};distinct={len(set(digests))};mean={len(payload) // len(digests)};entropy={abs(float(-(p * np.log2(p)).sum())):.4f}"


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (doc_id, n_bytes, what ``rebuilt`` gives)."""
    out = []
    for doc, n, (form, payload, digests) in rows:
        out.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(form), hashlib.sha256(form).hexdigest(), feature(payload, digests)))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    columns = list(zip(*out)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in FEATURES.split(", ")])


def read_back(packs: DataFrame, chunk_table: DataFrame) -> DataFrame:
    """Features of every document's payload, from the stored bytes alone."""

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                yield _features([(r["doc_id"], r["n_bytes"], rebuilt(r["recipe"], r["there"], r["own"], {}, r["sha"])) for r in batch.slice(k, 256).to_pylist()])

    def references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests = [], []
            for doc, recipe, there in zip(batch.column("key").to_pylist(), batch.column("recipe"), batch.column("there")):
                own = {d for (d, _, _), s in zip(parsed(recipe.as_py()), there.as_py()) if s}
                ids += [doc] * len(own)
                digests += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary())], ["key", "digest"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each key the chunks come first, then the pack, or several equal ones
        shared: dict[bytes, bytes] = {}
        now = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["key"] != now:
                    shared, now = {}, r["key"]
                if r["last"]:
                    out.append((r["doc_id"], r["n_bytes"], rebuilt(r["recipe"], r["there"], r["own"], shared, r["sha"])))
                else:
                    shared[r["digest"]] = r["body"]
            yield _features(out)

    with_key = packs.where("shared > 0").withColumn("key", F.xxhash64("doc_id", "sha", "n_bytes"))
    bodies = with_key.select("key", "recipe", "there").mapInArrow(lean(references), "key long, digest binary").join(chunk_table, "digest")
    bodies = bodies.select("key", F.lit(0).alias("last"), "digest", "body")
    ends = with_key.select("key", F.lit(1).alias("last"), "doc_id", "n_bytes", "sha", "recipe", "there", "own")
    both = bodies.unionByName(ends, allowMissingColumns=True).repartition("key").sortWithinPartitions("key", "last")
    return packs.where("shared = 0").mapInArrow(lean(alone), FEATURES).unionByName(both.mapInArrow(lean(joined), FEATURES))


def op2_media(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return read_back(*store(table(spark, sf_dir, "documents")))
