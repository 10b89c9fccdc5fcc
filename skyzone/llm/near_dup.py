"""Near-duplicate groups by HyperMinHash, confirmed on full shingle sets.

A document's set holds its distinct ``n``-word shingles (of words ``[^ \\t-\\r]+``, A-Z lower-cased;
fewer words than ``n``: all of them as one shingle).  Documents are linked if the sets' Jaccard
similarity is at least ``threshold`` percent, and groups are the links' connected components.

* Equal sets form a class at once, by a 128-bit digest; all later work is on classes.
* Each class has HyperMinHash registers: the leading-zero count of a minimal 64-bit hash and the
  ``MANTISSA`` bits after its first one, in 16 bits.  Sets of up to ``SMALL`` shingles have one
  bucket in each of ``SINGLE`` independent hashings; sets from ``threshold`` percent of that have
  ``BUCKETS`` buckets of one hashing, empty ones filled from the next full one.  Two sets that can
  reach the threshold always have one of the two kinds in common.
* Registers are banded by as many rows as let all bands together miss a pair at the threshold with at
  most ``MISS``: five at 0.8, where the 40 or 51 bands miss it with less than 2e-7.  Each band's bucket
  is a candidate set.
* A bucket's hub is its smallest class.  First each member is compared with the hub that it shares
  most bands with, and what is linked so far is contracted.  All classes that share a bucket share
  its hub, so what is left are pairs of different components within a hub's group.  Groups that lie
  in one component are done.  The others are dealt into blocks of bounded size, every pair of blocks
  goes to a task, and the task gives only links that join components: no row is made per pair.
* Pairs of sizes too different, and pairs whose collision-corrected estimate from the registers is
  more than ``SLACK`` standard deviations below the threshold, are let go; all others are confirmed
  on full sets.

Nothing is collected but counts.  What is told of buckets and hubs is written before it is joined, so
that Spark can split a hot one's part, and merged, not broadcast; joins on hubs are dealt by hub and ``SALTS`` salts.

Defined cases: null and empty texts and texts of white space have empty sets, are linked with
nothing and are kept; equal rows (of different ids) form one group; very long texts have whole sets;
an id that stands with several texts gets a row for each, and is confirmed by the one whose set is
least as bytes; rows of null ids are linked with nothing, have null components and are kept; extra columns are ignored; an empty table gives
no rows; thresholds under which no bands would find all pairs are refused.  Sets are compared by
64-bit shingle hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_filter, in_filter, lean, only, stored
from ..operators.components import connected_components

MANTISSA = 10
SMALL = 512
SINGLE = 200
BUCKETS = 256
MISS = 1e-6
#: Standard deviations of an estimate from SINGLE registers.
SLACK = 6.0
SALTS = 64
#: Most classes and, about, shingles in a block of a group.
BLOCK, BLOCK_SHINGLES = 1024, 500_000

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(9, 14)]] = True


def rows_of(threshold: int) -> int:
    """Registers in a band: the most that miss a pair at the threshold (in percent) with MISS at most."""
    fits = [r for r in range(1, 9) if (1 - (threshold / 100) ** r) ** (SINGLE // r) <= MISS]
    if not fits or not 0 < threshold <= 100:
        raise ValueError(f"no bands of {SINGLE} registers find pairs at {threshold} percent")
    return max(fits)


def least_estimate(threshold: int) -> float:
    """What the estimate of a pair at the threshold does not fall below, but for SLACK deviations."""
    t = threshold / 100
    return t - SLACK * (t * (1 - t) / SINGLE) ** 0.5


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_LETTER = _mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_LETTER[65:91] = _LETTER[97:123]  # A-Z as a-z
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_SEEDS = _mix(np.arange(1, SINGLE + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93)) | _U(1)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(size + 1, _BASE, dtype=np.uint64), np.full(size + 1, _BACK, dtype=np.uint64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def shingle_sets(data: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one text given as bytes."""
    with np.errstate(over="ignore"):
        word = np.concatenate([[False], ~_SPACE[data], [False]])
        edges = np.flatnonzero(word[1:] != word[:-1])
        starts, stops = edges[::2], edges[1::2]
        if not len(starts):
            return np.empty(0, dtype=np.uint64)
        size = 1 << max(12, int(len(data)).bit_length())
        up, down = _powers(size)
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_LETTER[data] * up[: len(data)], dtype=np.uint64)])
        words = _mix((total[stops] - total[starts]) * down[starts])
        k = min(n, len(words))
        out = words[: len(words) - k + 1].copy()
        for j in range(1, k):
            out = _mix(out * _U(0x9FB21C651E98DF25) + words[j : len(words) - k + 1 + j])
        if len(words) < n:
            out = _mix(out + _U(len(words)))
        return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of 64-bit hashes, in 16 bits."""
    top = np.frexp(hashes.astype(np.float64))[1].astype(np.int64)  # bit length; may round up to one more
    top = np.where((top < 64) | (hashes >> _U(63) > 0), top, 63)
    top = np.minimum(top, 64)
    short = (hashes >> np.maximum(top - 1, 0).astype(np.uint64)) == 0
    top = np.where(short & (top > 0), top - 1, top)
    shift = np.maximum(64 - top + 1, 1).astype(np.uint64)
    mantissa = np.where(shift >= 64, _U(0), (hashes << np.minimum(shift, _U(63))) >> _U(64 - MANTISSA))
    return (((64 - top) << MANTISSA) | mantissa.astype(np.int64)).astype(np.uint16)


def sketch_single(s: np.ndarray) -> np.ndarray:
    """Registers of one bucket in each of SINGLE hashings."""
    with np.errstate(over="ignore"):
        least = np.empty(SINGLE, dtype=np.uint64)
        for at in range(0, SINGLE, 50):
            x = s[None, :] * _SEEDS[at : at + 50, None]
            x ^= x >> _U(32)
            x *= _U(0x9FB21C651E98DF25)
            least[at : at + 50] = x.min(1)
        return registers(least)


def sketch_buckets(s: np.ndarray) -> np.ndarray:
    """Registers of BUCKETS buckets of one hashing; the hashes are sorted, so a bucket's first is its least."""
    edges = np.arange(BUCKETS, dtype=np.uint64) << _U(56)
    at = np.searchsorted(s, edges)
    full = np.append(at[1:], len(s)) > at
    value = np.zeros(BUCKETS, dtype=np.uint16)
    value[full] = registers(s[at[full]] << _U(8))
    own = np.flatnonzero(full)
    step = np.searchsorted(own, np.arange(BUCKETS)) % len(own)
    return value[own[step]]


def sketches(s: np.ndarray, threshold: int) -> tuple[bytes | None, bytes | None]:
    small = sketch_single(s).tobytes() if 0 < len(s) <= SMALL else None
    large = sketch_buckets(s).tobytes() if len(s) >= SMALL * threshold // 100 else None
    return small, large


@lru_cache(maxsize=4096)
def _chance(n: int, m: int) -> float:
    """Probability that registers of unrelated minima of n and m hashes agree."""
    zeros = np.arange(0, 50)[:, None]
    low = 2.0 ** -(zeros + 1.0) * (1 + np.arange(1 << MANTISSA)[None, :] / (1 << MANTISSA))
    high = low + 2.0 ** -(zeros + 1.0) / (1 << MANTISSA)
    share = lambda k: np.exp(k * np.log1p(-low)) - np.exp(k * np.log1p(-np.minimum(high, 1 - 1e-16)))
    return float((share(n) * share(m)).sum())


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> float:
    """Jaccard similarity from registers, less the agreement expected by chance."""
    buckets = 1 if len(a) == SINGLE else BUCKETS
    level = lambda k: 1 << max(0, int(k // buckets).bit_length() - 1) or 1
    c = _chance(level(n), level(m))
    return (float((a == b).mean()) - c) / (1 - c)


def _sets(docs: DataFrame, n: int, threshold: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, and its registers of either kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[list] = [[], [], [], []]
                for text in part.column("text"):
                    s = shingle_sets(np.frombuffer((text.as_py() or "").encode(), dtype=np.uint8), n)
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                    for column, value in zip(out, (len(s), digest, *sketches(s, threshold))):
                        column.append(value)
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *map(pa.array, out, kinds)], ["doc_id", "n_shingles", "digest", "small", "large"])

    return only(docs, "doc_id", "text").mapInArrow(lean(run), "doc_id long, n_shingles long, digest binary, small binary, large binary")


def _bands(classes: DataFrame, threshold: int) -> DataFrame:
    """class_id, band: 64-bit names of the class's bands of both kinds."""
    rows = rows_of(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for kind, size in (("small", SINGLE), ("large", BUCKETS)):
                    column = batch.column(kind)
                    there = column.is_valid()
                    own = column.filter(there).to_pylist()
                    if not own:
                        continue
                    r = np.frombuffer(b"".join(own), dtype=np.uint16).reshape(len(own), size)
                    bands = size // rows
                    r = r[:, : bands * rows].reshape(len(own), bands, rows).astype(np.uint64)
                    name = np.broadcast_to(np.arange(bands, dtype=np.uint64) + _U(size << 20), r.shape[:2]).copy()
                    for j in range(rows):
                        name = _mix(name * _U(0x9FB21C651E98DF25) + r[:, :, j])
                    ids = np.repeat(batch.column("class_id").filter(there).to_numpy(), bands)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(name.reshape(-1).view(np.int64))], ["class_id", "band"])

    return classes.select("class_id", "small", "large").mapInArrow(lean(run), "class_id long, band long")


def _likely(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) that sizes and registers don't rule out."""
    known = only(classes, "class_id", "n_shingles", "small", "large")
    for side in "ab":
        pairs = pairs.join(known.select(F.col("class_id").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("small").alias(f"small_{side}"), F.col("large").alias(f"large_{side}")), side)
    pairs = pairs.where(100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))

    least = least_estimate(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for r in batch.to_pylist():
                x, y = (r["small_a"], r["small_b"]) if r["small_a"] and r["small_b"] else (r["large_a"], r["large_b"])
                good.append(bool(x and y) and estimate(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16), r["n_a"], r["n_b"]) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(lean(run), "a long, b long")


def _full_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(doc_id, s): the sorted shingle hashes, as bytes, of the documents whose ids are wanted, and of few others.

    A filter of the wanted ids, whose size has a bound, goes to every task, so texts are not shuffled;
    joins on the id drop what it lets by.
    """
    found, slots = id_filter(wanted)
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = in_filter(shared.value, [batch.column(f"_slot{k}").to_numpy() for k in range(2)])
            batch = batch.filter(pa.array(own & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)))
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [shingle_sets(np.frombuffer((t.as_py() or "").encode(), dtype=np.uint8), n).tobytes() for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(made, pa.binary())], ["doc_id", "s"])

    full = only(docs, "doc_id", "text").select("doc_id", "text", *slots).mapInArrow(lean(sets), "doc_id long, s binary")
    return full.groupBy("doc_id").agg(F.min("s").alias("s"))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if not len(small):
        return 0
    at = np.searchsorted(large, small)
    return int((large[np.minimum(at, len(large) - 1)] == small).sum())


def _linked(docs: DataFrame, pairs: DataFrame, n: int, threshold: int) -> DataFrame:
    """Pairs (a, b) confirmed on full sets.

    ``a`` is the side with few different classes.  Its set goes once to each group of about 256 of its
    partners, the partners' sets go to their groups, and sets are compared as they stream by: no row
    ever holds two sets.
    """
    pairs = stored(pairs, "pairs")
    full = _full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), n)
    # written, so that the join stands by itself and Spark can split the pairs of a hot side
    counts = stored(pairs.groupBy("a").count().withColumn("parts", F.ceil(F.col("count") / 256)).select("a", "parts"), "parts")
    placed = stored(pairs.join(counts.hint("merge"), "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts"))).select("a", "b", "part"), "placed")
    theirs = placed.join(full.withColumnRenamed("doc_id", "b"), "b").select("a", "part", "b", "s")
    ours = placed.select("a", "part").distinct().join(full.withColumnRenamed("doc_id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "s")
    both = theirs.unionByName(ours).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.empty(0, dtype=np.uint64)
        for batch in batches:
            out: list[tuple[int, int]] = []
            for a, b, s in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("s")):
                s = np.frombuffer(s.as_py(), dtype=np.uint64)
                if b is None:
                    own = s
                elif (k := common(s, own)) and 100 * k >= threshold * (len(s) + len(own) - k):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    return both.mapInArrow(lean(compare), "a long, b long")


def joins(ids: list[int], components: list[int], blocks: list[int], sets: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """Links between different components among one or two blocks, none that earlier ones imply.

    With two blocks only pairs across them are compared, as each block is met by itself elsewhere.
    """
    parent = {c: c for c in components}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    order = sorted(range(len(ids)), key=lambda k: (len(sets[k]), ids[k]))
    ids, components, blocks, sets = ([x[k] for k in order] for x in (ids, components, blocks, sets))
    n, comp, block = np.asarray([len(s) for s in sets]), np.asarray(components), np.asarray(blocks)
    across = len(set(blocks)) > 1
    both = [sketches(s, threshold) for s in sets]
    tables = []
    for k, size in ((0, SINGLE), (1, BUCKETS)):
        table = np.zeros((len(ids), size), dtype=np.uint16)
        for i, r in enumerate(both):
            if r[k] is not None:
                table[i] = np.frombuffer(r[k], dtype=np.uint16)
        tables.append((table, np.asarray([r[k] is not None for r in both])))
    xs, ys = [], []
    for x in range(len(ids)):
        # sizes rise, so partners end where they are too large
        end = int(np.searchsorted(n, n[x] * 100 / threshold, side="right"))
        y = np.arange(x + 1, end)
        y = y[(comp[y] != comp[x]) & ((block[y] != block[x]) | (not across))]
        if not len(y):
            continue
        table, there = tables[0] if tables[0][1][x] else tables[1]
        other, also = tables[1]
        use = there[y]
        score = np.zeros(len(y))
        score[use] = (table[y[use]] == table[x]).mean(1)
        rest = ~use & also[y] & also[x]
        score[rest] = (other[y[rest]] == other[x]).mean(1)
        chance = _chance(max(1, int(n[x]) // (1 if tables[0][1][x] else BUCKETS)), max(1, int(n[x]) // (1 if tables[0][1][x] else BUCKETS)))
        y = y[(score - chance) / (1 - chance) >= least_estimate(threshold)]
        xs.append(np.full(len(y), x))
        ys.append(y)
    if not xs:
        return []
    x, y = np.concatenate(xs), np.concatenate(ys)
    if len(x) > 4 * len(ids):
        shared = _intersections(sets)
        k = shared[x, y]
    else:
        k = np.asarray([common(sets[i], sets[j]) for i, j in zip(x, y)])
    good = (100 * k >= threshold * (n[x] + n[y] - k)) & (k > 0)
    out = []
    for i, j in zip(x[good].tolist(), y[good].tolist()):
        a, b = root(components[i]), root(components[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((ids[i], ids[j]))
    return out


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the hashes that occur twice or more."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times[at] > 1
    owner, at = owner[often], (np.cumsum(times > 1) - 1)[at[often]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, 2048):
        a, b = np.searchsorted(at, [lo, lo + 2048])
        m = np.zeros((len(sets), 2048), dtype=np.float32)
        m[owner[a:b], at[a:b] - lo] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _salted(rows: DataFrame, facts: DataFrame, salt: str) -> DataFrame:
    """``rows`` joined to one row of facts a hub; a hub's rows are dealt by SALTS salts of a column."""
    every = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(every.hint("merge"), ["hub", "_salt"]).drop("_salt")


def _joined(docs: DataFrame, members: DataFrame, n: int, threshold: int) -> DataFrame:
    """Links within groups: ``members`` has (hub, class_id, component, n_shingles) of all groups."""
    facts = members.groupBy("hub").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"), F.sum("n_shingles").alias("all"))
    # only groups that more than one component has part in
    facts = facts.where("lo < hi").select("hub", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("all") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = stored(_salted(members, stored(facts, "facts"), "class_id"), "mixed")
    dealt = members.withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks").cast("long")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class_id", "component")
    full = _full_sets(docs, members.select(F.col("class_id").alias("doc_id")).distinct(), n)
    dealt = dealt.join(full.withColumnRenamed("doc_id", "class_id"), "class_id")
    dealt = dealt.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        now = None

        def done() -> pa.RecordBatch:
            out = joins(*held, threshold) if len(set(held[1])) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

        for batch in batches:
            for hub, i, j, block, name, component, s in zip(*(batch.column(c) for c in ("hub", "i", "j", "block", "class_id", "component", "s"))):
                key = (hub.as_py(), i.as_py(), j.as_py())
                if key != now:
                    if held[0]:
                        yield done()
                    held, now = [[], [], [], []], key
                for column, value in zip(held, (name.as_py(), component.as_py(), block.as_py(), np.frombuffer(s.as_py(), dtype=np.uint64))):
                    column.append(value)
        if held[0]:
            yield done()

    return dealt.mapInArrow(lean(run), "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the group), kept."""
    found = stored(_sets(docs, n, threshold).withColumn("digest", F.when(F.col("doc_id").isNotNull(), F.col("digest"))), "sets")
    named = found.where(F.col("digest").isNotNull())
    classes = named.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "small", "large")).alias("x"))
    classes = stored(classes.select("digest", F.col("x.doc_id").alias("class_id"), "x.n_shingles", "x.small", "x.large"), "classes")

    bands = _bands(classes, threshold)
    # written, so that the join stands by itself and Spark can split a hot bucket's part
    hubs = stored(bands.groupBy("band").agg(F.min("class_id").alias("hub"), F.count("*").alias("size")).where(F.col("size") > 1).select("band", "hub"), "hubs")
    members = bands.join(hubs.hint("merge"), "band")
    spokes = stored(members.where(F.col("hub") != F.col("class_id")).groupBy("class_id", "hub").count(), "spokes")
    best = spokes.groupBy("class_id").agg(F.max(F.struct("count", (-F.col("hub")).alias("hub"))).alias("x"))
    first = best.select((-F.col("x.hub")).alias("a"), F.col("class_id").alias("b"))
    links = stored(_linked(docs, _likely(first, classes, threshold), n, threshold), "links")
    parts = connected_components(links)

    own = spokes.select("hub", "class_id").unionByName(spokes.select("hub", F.col("hub").alias("class_id")).distinct())
    own = own.join(parts, own.class_id == parts.node, "left").select("hub", "class_id", F.coalesce("component", "class_id").alias("component"))
    own = stored(own.join(only(classes, "class_id", "n_shingles"), "class_id"), "groups")
    more = stored(_joined(docs, own, n, threshold), "links")
    parts = connected_components(links.unionByName(more)) if more.take(1) else parts

    groups = only(classes, "digest", "class_id").join(parts, F.col("class_id") == F.col("node"), "left")
    groups = groups.select("digest", F.coalesce("component", "class_id").alias("component_id"))
    out = only(found, "doc_id", "n_shingles", "digest").join(groups, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, n: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept: one of each group."""
    gone = near_duplicates(docs, n, threshold).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti")


def op4_near_dup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"), n=2)


#: The query as DuckDB SQL: pairs that share one of their rarest shingles (two sets at 0.8 share one of the
#: rarest fifth of either) are compared in full, and links are followed to their ends.
ORACLE = r"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]) ELSE w END) AS s FROM w),
    e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s), f AS MATERIALIZED (SELECT x, count(*) AS df FROM e GROUP BY x),
    p AS MATERIALIZED (SELECT doc_id, e.x FROM e JOIN f ON e.x = f.x QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY df, e.x) <= n - (n * 80 + 99) // 100 + 1),
    c AS MATERIALIZED (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id),
    l AS MATERIALIZED (SELECT a, b FROM (SELECT a, b, len(x.s) AS m, len(y.s) AS n, len(list_intersect(x.s, y.s)) AS k FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * least(len(x.s), len(y.s)) >= 80 * greatest(len(x.s), len(y.s))) WHERE 100 * k >= 80 * (m + n - k)),
    g AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r(doc_id, o) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, g.b FROM r JOIN g ON r.o = g.a)
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, z.c AS component_id, s.doc_id = z.c AS kept FROM s JOIN (SELECT doc_id, min(o) AS c FROM r GROUP BY doc_id) z ON s.doc_id = z.doc_id"""
