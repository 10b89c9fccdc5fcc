"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard, with routed queries.

Vectors of one direction (unit vectors equal to ``PLACES`` decimals) form a class, kept once with its
``k + 1`` smallest ids (no more can be among k neighbours).  Spherical k-means over a bounded sample
(``PER_CELL`` classes a cell, ``MOST_SAMPLE`` bytes at most) gives about one centroid for ``SHARD`` classes,
``MOST_CELLS`` at most.  Every class goes to its nearest cell.  A cell of over ``2 * SHARD`` classes, however many
it holds, is split by hash into shards.  Each shard builds a graph: vertices come in random order in
batches that double; a greedy beam search over the graph so far proposes neighbours; relaxed distance
pruning keeps a proposal unless a kept one is ``1 / ALPHA`` as near to it; edges are mirrored and
pruned again beyond ``DEGREE``.

A query goes to the shards of its nearest cells alone.  How many is measured on the sample: as few as
hold ``COVER`` of the sample's true neighbours.  Vectors without structure need many cells, at worst
all.  A beam search of width ``BEAM`` answers a block of queries in a shard, and answers are merged by
exact cosine in double precision on the original vectors, rounded to 12 decimals for the order, ties
to the smaller id.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part,
as queries or candidates, nor do rows of null ids; vectors are compared with those of their own length
alone; parallel vectors tie; fewer than k candidates give all of them; an id with several vectors asks
with the least of them as bytes, and is no candidate of its own; equal rows (same id and vector) count
once; very long vectors are kept whole; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lowest, stored

SHARD = 2048
DEGREE = 32
BUILD_BEAM = 64
BEAM = 96
ALPHA = 1.2
WIDE = 4
BATCH = 256
BLOCK = 2048
PLACES = 13
MOST_CELLS, PER_CELL, MOST_SAMPLE = 8192, 512, 64 << 20
COVER = 0.97
ROUNDS = 8
ASKED = 512
FOUND = "query_id long, rank int, vec_id long, score double"


def valid(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, size, key, v): length, a digest of the direction, and the components as little-endian doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or not row or any(x is None for x in row):
                    continue
                v = np.asarray(row, dtype="<f8")
                if np.isfinite(v).all() and v.any():
                    way = np.round(_unit(v[None])[0], PLACES) + 0.0  # no negative zeros
                    for c, x in zip(out, (i, len(v), hashlib.blake2b(way.tobytes(), digest_size=16).digest(), (v + 0.0).tobytes())):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["vec_id", "size", "key", "v"])

    return vectors.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{column}`")).mapInArrow(run, "vec_id long, size int, key binary, v binary")


def beam_search(x: np.ndarray, edges: np.ndarray, start: np.ndarray, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and dot products of the ``width`` best vertices found for each row of ``q`` (-1: none)."""
    b, n = len(q), len(x)
    seen = np.zeros((b, n + 1), dtype=bool)
    seen[:, n] = True  # the place of missing edges
    rows = np.arange(b)[:, None]
    ids = np.broadcast_to(start, (b, len(start))).copy()
    seen[rows, ids] = True
    score = np.einsum("bd,bkd->bk", q, x[ids])
    done = np.zeros(ids.shape, dtype=bool)
    while True:
        if ids.shape[1] > width:
            top = np.argpartition(-score, width - 1, axis=1)[:, :width]
            ids, score, done = (np.take_along_axis(a, top, 1) for a in (ids, score, done))
        open_score = np.where(done, -np.inf, score)
        live = np.flatnonzero(~np.isneginf(open_score.max(1)))
        if not len(live):
            order = np.argsort(-score, axis=1, kind="stable")
            return np.where(np.isneginf(np.take_along_axis(score, order, 1)), -1, np.take_along_axis(ids, order, 1)), np.take_along_axis(score, order, 1)
        k = min(WIDE, ids.shape[1])
        pick = np.argpartition(-open_score[live], k - 1, axis=1)[:, :k]
        ok = ~np.isneginf(np.take_along_axis(open_score[live], pick, 1))
        at = np.where(ok, np.take_along_axis(ids[live], pick, 1), n)
        mark = done[live]
        np.put_along_axis(mark, pick, True, 1)
        done[live] = mark
        near = edges[at].reshape(len(live), -1)
        near = np.sort(near, axis=1)
        fresh = ~seen[live[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[live[:, None], near] = True
        width_now = int(fresh.sum(1).max())
        new_ids = np.full((b, max(1, width_now)), n)
        new_score = np.full(new_ids.shape, -np.inf, dtype=score.dtype)
        if width_now:
            r, c = np.nonzero(fresh)
            place = np.arange(len(r)) - np.searchsorted(r, r)
            new_ids[live[r], place] = near[r, c]
            new_score[live[r], place] = np.einsum("kd,kd->k", q[live[r]], x[near[r, c]])
        ids, score = np.concatenate([ids, new_ids], 1), np.concatenate([score, new_score], 1)
        done = np.concatenate([done, np.isneginf(new_score)], 1)


def robust_prune(x: np.ndarray, points: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Kept neighbours of each point among candidates (-1: none), nearest first, at most ``degree``."""
    n = len(x)
    c = np.where(cand < 0, n, cand)
    c = np.sort(c, axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = n
    c[c == points[:, None]] = n
    y = np.concatenate([x, np.zeros((1, x.shape[1]), dtype=x.dtype)])
    own = y[c]
    d = np.where(c == n, np.inf, np.maximum(2 - 2 * np.einsum("bd,bkd->bk", x[points], own), 0))
    out = np.full((len(points), degree), n)
    rows = np.arange(len(points))
    alive = d.copy()
    for k in range(degree):
        best = alive.argmin(1)
        there = ~np.isinf(alive[rows, best])
        if not there.any():
            break
        out[there, k] = c[rows, best][there]
        between = np.maximum(2 - 2 * np.einsum("bd,bkd->bk", own[rows, best], own), 0)
        alive = np.where((alpha * alpha * between <= d) & there[:, None], np.inf, alive)
        alive[rows[there], best[there]] = np.inf
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Edges (n + 1 rows; n stands for no edge) and the vertices a search starts from; ``x`` has unit rows."""
    n = len(x)
    edges = np.full((n + 1, degree), n)
    order = np.random.default_rng(seed).permutation(n)
    start = order[:1]
    at = 1
    while at < n:
        batch = order[at : at + min(BATCH, max(1, at))]
        found, _ = beam_search(x, edges, start, x[batch], beam)
        if len(batch) > 1:  # the batch's own members can be neighbours too
            near = x[batch] @ x[batch].T
            k = min(16, len(batch))
            found = np.concatenate([found, batch[np.argpartition(-near, k - 1, axis=1)[:, :k]]], 1)
        edges[batch] = robust_prune(x, batch, found, degree, alpha)
        src = np.repeat(batch, degree)
        dst = edges[batch].reshape(-1)
        src, dst = src[dst < n], dst[dst < n]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        points, first, count = np.unique(dst, return_index=True, return_counts=True)
        if len(points):
            extra = np.full((len(points), int(count.max())), n)
            extra[np.repeat(np.arange(len(points)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
            both = np.sort(np.concatenate([edges[points], extra], 1), axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = n
            size = (both < n).sum(1)
            few = size <= degree
            edges[points[few]] = np.sort(both[few], axis=1)[:, :degree]
            if (~few).any():
                edges[points[~few]] = robust_prune(x, points[~few], np.where(both[~few] == n, -1, both[~few]), degree, alpha)
        at += len(batch)
    return edges, start


def _matrix(column: pd.Series | list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<f8").reshape(len(column), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


@dataclass
class Cells:
    """Cells of the vectors of one length: their centroids, the number of the first, and how many a query tries."""

    first: int
    centroids: np.ndarray
    probes: int = 1

    def order(self, unit: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the ``n`` nearest centroids of each row, nearest first."""
        cosine = unit @ self.centroids.T
        n = min(n, cosine.shape[1])
        top = np.argpartition(-cosine, n - 1, axis=1)[:, :n] if n < cosine.shape[1] else np.broadcast_to(np.arange(n), cosine.shape)
        by = np.argsort(-np.take_along_axis(cosine, top, 1), axis=1, kind="stable")
        top = np.take_along_axis(top, by, 1)
        return top, np.take_along_axis(cosine, top, 1)


def cells_of(unit: np.ndarray, n: int, first: int, k: int) -> Cells:
    """Spherical k-means with ``n`` centroids, and the probes that find ``COVER`` of the sample's own neighbours."""
    rng = np.random.default_rng(11)
    unit = unit.astype(np.float32)
    out = Cells(first, unit[rng.permutation(len(unit))[:n]])
    for _ in range(ROUNDS if n > 1 else 0):
        near = np.concatenate([out.order(unit[at : at + 4096], 1)[0][:, 0] for at in range(0, len(unit), 4096)])
        total = np.zeros_like(out.centroids)
        np.add.at(total, near, unit)
        norm = np.linalg.norm(total, axis=1)
        empty = np.flatnonzero(norm < 1e-6)
        total[empty], norm[empty] = unit[rng.choice(len(unit), len(empty))], 1.0
        out.centroids = total / norm[:, None]
    if n > 1:
        asked = rng.permutation(len(unit))[:ASKED]
        cosine = unit[asked] @ unit.T
        cosine[np.arange(len(asked)), asked] = -2
        near = np.argpartition(-cosine, k, axis=1)[:, :k] if cosine.shape[1] > k else np.broadcast_to(np.arange(cosine.shape[1]), cosine.shape)
        place = np.empty((len(asked), n), dtype=np.int64)  # place of each cell in a query's order
        np.put_along_axis(place, out.order(unit[asked], n)[0], np.broadcast_to(np.arange(n), place.shape), 1)
        homes = out.order(unit[near.reshape(-1)], 1)[0][:, 0]
        needed = place[np.repeat(np.arange(len(asked)), near.shape[1]), homes]
        out.probes = int(np.sort(needed)[min(len(needed) - 1, int(COVER * len(needed)))]) + 1
    return out


def index(placed: DataFrame, parts: Column) -> DataFrame:
    """One row a shard: its vectors, their ids (arrays), the graph's edges and start."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        edges, start = build(_unit(_matrix(pdf.v)).astype(np.float32))
        return pd.DataFrame({"cell": [pdf.cell.iloc[0]], "part": [pdf.part.iloc[0]], "n": [len(pdf)], "v": [b"".join(pdf.v)], "ids": [[list(map(int, x)) for x in pdf.ids]], "edges": [edges.astype("<i4").tobytes()], "start": [int(start[0])]})

    dealt = placed.withColumn("part", F.pmod(F.xxhash64("key"), parts).cast("int"))
    return dealt.groupBy("cell", "part").applyInPandas(one, "cell int, part int, n int, v binary, ids array<array<bigint>>, edges binary, start int")


def _counted(df: DataFrame, cells: int, size: int) -> list[int]:
    """Into how many pieces of about ``size`` rows each cell falls; one row a cell is collected."""
    out = [1] * cells
    for r in df.groupBy("cell").count().collect():
        out[r.cell] = max(1, -(-r["count"] // size))
    return out


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, *, shard: int = SHARD, beam: int = BEAM, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows found for each row whose id ``every`` divides."""
    spark = vectors.sparkSession
    known = stored(valid(vectors, id_col, column), "vectors")
    # the k + 1 smallest ids of each class, in two steps so that a frequent vector has no task of its own
    salted = Window.partitionBy("key", F.pmod(F.xxhash64("vec_id"), F.lit(16))).orderBy("vec_id")
    ids = known.select("key", "vec_id").withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    ids = ids.groupBy("key").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    bodies = known.groupBy("key").agg(F.min(F.struct("v", "size")).alias("x"))
    classes = stored(ids.join(bodies, "key").select("key", "ids", "x.size", "x.v"), "classes")

    routes: dict[int, Cells] = {}
    total = 0
    for r in sorted(classes.groupBy("size").count().collect()):  # as many rows as there are lengths
        most = MOST_SAMPLE // (8 * r["size"])
        n = max(1, min(MOST_CELLS, most // 16, -(-r["count"] // shard)))
        own = classes.where(F.col("size") == r["size"]).select("key", "v")
        sample = lowest(own, "key", min(most, PER_CELL * n) if n > 1 else 1, r["count"]).collect()
        routes[r["size"]] = cells_of(np.stack([_unit(np.frombuffer(x.v, "<f8")[None])[0] for x in sample]), n, total, k)
        total += n
    if not routes:
        return spark.createDataFrame([], FOUND)
    shared = spark.sparkContext.broadcast(routes)  # MOST_CELLS vectors of each length at most

    def routed(batches: Iterator[pa.RecordBatch], asking: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                cells, at = shared.value[int(size)], np.flatnonzero(sizes == size)
                for lo in range(0, len(at), 1024):
                    part = batch.take(pa.array(at[lo : lo + 1024]))
                    top, _ = cells.order(_unit(_matrix(part.column("v").to_pylist())).astype(np.float32), cells.probes if asking else 1)
                    out = part.take(pa.array(np.repeat(np.arange(len(top)), top.shape[1])))
                    yield out.append_column("cell", pa.array((top + cells.first).reshape(-1), pa.int32()))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from routed(batches, False)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from routed(batches, True)

    placed = stored(classes.mapInArrow(homes, "key binary, ids array<bigint>, size int, v binary, cell int"), "placed")
    parts = F.get(F.lit(_counted(placed, total, 2 * shard)), F.col("cell"))
    graphs = stored(index(placed, parts), "graphs")

    asked = known.where(F.col("vec_id") % every == 0).groupBy("vec_id", "size").agg(F.min("v").alias("v"))
    asked = stored(asked.mapInArrow(probes, "vec_id long, size int, v binary, cell int"), "asked")
    blocks = F.get(F.lit(_counted(asked, total, BLOCK)), F.col("cell"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    asked = asked.groupBy("cell", "part", "block").agg(F.collect_list(F.struct("vec_id", "v")).alias("asked"))
    pairs = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).join(asked, ["cell", "part", "block"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at_row in range(batch.num_rows):
                r = batch.slice(at_row, 1).to_pylist()[0]
                v = np.frombuffer(r["v"], dtype="<f8").reshape(r["n"], -1)
                q = np.frombuffer(b"".join(a["v"] for a in r["asked"]), dtype="<f8").reshape(len(r["asked"]), -1)
                x, unit = _unit(v), _unit(q)
                narrow = x.astype(np.float32)
                edges = np.frombuffer(r["edges"], dtype="<i4").reshape(r["n"] + 1, -1)
                names = [a["vec_id"] for a in r["asked"]]
                out: list[list] = [[], [], []]
                for at in range(0, len(q), BATCH):
                    part = unit[at : at + BATCH]
                    found, _ = beam_search(narrow, edges, np.asarray([r["start"]]), part.astype(np.float32), max(beam, k + 1))
                    exact = np.where(found < 0, -np.inf, np.einsum("bd,bkd->bk", part, x[np.maximum(found, 0)]))
                    key = np.round(exact, 12)
                    # all classes as near as the (k + 1)-th, so that ties are told apart by id alone
                    least = -np.sort(-key, axis=1)[:, min(k, key.shape[1] - 1)]
                    for name, own, score, order, low in zip(names[at : at + BATCH], found, exact, key, least):
                        near = np.flatnonzero((order >= low) & (own >= 0))
                        hits = sorted((-order[j], w, score[j]) for j in near for w in r["ids"][own[j]] if w != name)[:k]
                        for _, w, s in hits:
                            for c, y in zip(out, (name, w, float(s))):
                                c.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    # one task for a graph and a block, as far as the session has partitions
    found = pairs.repartition("cell", "part", "block").mapInArrow(search, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_graph_ann(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return nearest(table(spark, sf_dir, "embeddings"))
