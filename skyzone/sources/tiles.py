"""Catalogues tiled on the sphere: ``dataset/Norder=k/Dir=d/Npix=p.parquet`` with ``properties``."""

from __future__ import annotations

import csv
import io
import os
import re
import uuid
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError
from ..functions import healpix
from ..functions.geometry import cone
from ..shared import stored
from .storage import Storage, uri_of

# Files that mark a tiled catalogue.
MARKERS = ("properties", "hats.properties", "catalog_info.json", "_metadata")
DEEPEST = 10


def _store() -> Storage | None:
    return Storage(SparkSession.getActiveSession()) if SparkSession.getActiveSession() else None


def _there(path: str) -> bool:
    store = _store()
    return store.exists(path) if store else os.path.exists(path)


def is_tiled(path: str) -> bool:
    return any(_there(f"{path.rstrip('/')}/{m}") for m in MARKERS)


def properties(path: str) -> dict[str, str]:
    for name in ("properties", "hats.properties"):
        file = f"{path.rstrip('/')}/{name}"
        if _there(file):
            store = _store()
            text = store.read(file).decode() if store else Path(file).read_text()
            pairs = (line.partition("=") for line in text.splitlines() if "=" in line and not line.lstrip().startswith("#"))
            return {k.strip(): v.strip() for k, _, v in pairs}
    return {}


def partitions(path: str) -> list[tuple[int, int, str]]:
    """(order, nested pixel, path) of all tiles, in ``dataset`` or at the top, whatever numbering their names have."""
    numbering = properties(path).get("hats_ordering", "NESTED").upper()
    if numbering not in ("NESTED", "RING"):
        raise InputError(f"tiles under {path!r} are numbered by {numbering!r}, which is not known", path)
    store = Storage()
    for root in (f"{path.rstrip('/')}/dataset", path):
        # a tile is a file, or a folder of files, whose path ends with a slash
        found = (re.match(r"Norder=(\d+)/Dir=\d+/Npix=(\d+)(\.parquet)?(/|$)", file) for file, _ in store.files(root))
        out = sorted({(int(m[1]), int(m[2]), f"{uri_of(root)}/{m[0]}") for m in found if m})
        if out:
            break
    if numbering == "RING":
        out = [(o, p, file) for (o, _, file), p in zip(out, _by_order(healpix.ring_to_nested, out)[0].astype(np.int64).tolist())]
    return sorted(out)


def _by_order(of, tiles: list[tuple[int, int, str]]) -> np.ndarray:
    """Rows of what ``of(order, pixels)`` gives, for tiles in their order."""
    orders, pix = (np.asarray([t[k] for t in tiles], dtype=np.int64) for k in range(2))
    out = None
    for o in np.unique(orders):
        own = np.atleast_2d(np.asarray(of(int(o), pix[orders == o])))
        out = np.empty((len(own), len(tiles)), dtype=own.dtype) if out is None else out
        out[:, orders == o] = own
    return np.empty((2, 0)) if out is None else out


def check_overlap(tiles: list[tuple[int, int, str]]) -> None:
    """A tile must not lie within another."""
    known = {(o, p) for o, p, _ in tiles}
    for order, pix, _ in tiles:
        if any((k, pix >> (2 * (order - k))) in known for k in range(order)):
            raise InputError(f"tile Norder={order} Npix={pix} overlaps another")


def _paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(*paths)


def _tiles(spark: SparkSession, kept: list[str], every: list[tuple[int, int, str]]) -> DataFrame:
    """Rows of some tiles.  Folders of which all tiles are wanted are read as folders, since each path costs the driver."""
    wanted, folders = set(kept), {}
    for _, _, path in every:
        folder = path.rstrip("/").rpartition("/")[0]
        folders[folder] = folders.get(folder, True) and path in wanted and not path.endswith("/")
    whole = sorted(f for f, x in folders.items() if x)
    single = [p for p in kept if not folders[p.rstrip("/").rpartition("/")[0]]]
    if not whole:
        return _paths(spark, single)
    df = spark.read.option("mergeSchema", "true").option("pathGlobFilter", "Npix=*").parquet(*whole)
    return df.unionByName(_paths(spark, single), allowMissingColumns=True) if single else df


def read(spark: SparkSession, path: str) -> DataFrame:
    tiles = partitions(path)
    if not tiles:
        rows = properties(path).get("hats_nrows", "0")
        for common in ("_common_metadata", "dataset/_common_metadata"):
            file = f"{path.rstrip('/')}/{common}"
            if _there(file) and not int(rows or 0):
                import pyarrow as pa
                import pyarrow.parquet as pq
                from pyspark.sql.pandas.types import from_arrow_schema

                return spark.createDataFrame([], from_arrow_schema(pq.read_schema(pa.BufferReader(Storage(spark).read(file)))))
        raise InputError(f"no tiles under {path!r}, which should hold {rows} rows", path)
    return _tiles(spark, [p for _, _, p in tiles], tiles)


def read_cone(spark: SparkSession, path: str, centre: tuple[float, float], radius_deg: float, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """Rows within a cone; only tiles whose centre is near enough are read."""
    every = partitions(path)
    a, d = _by_order(healpix.centre, every)
    h = np.sin(np.radians(d - centre[1]) / 2) ** 2 + np.cos(np.radians(d)) * np.cos(np.radians(centre[1])) * np.sin(np.radians(a - centre[0]) / 2) ** 2
    near = np.degrees(2 * np.arcsin(np.sqrt(np.minimum(1.0, h)))) <= radius_deg + np.asarray([healpix.diagonal(t[0]) for t in every])
    kept = [t[2] for t, x in zip(every, near) if x]
    whole = read(spark, path) if not kept else _tiles(spark, kept, every)
    return cone(whole if kept else whole.where("false"), ra, dec, centre, radius_deg)


def near_tiles(left: list[tuple[int, int, str]], right: list[tuple[int, int, str]], radius_deg: float) -> tuple[list[str], list[str]]:
    """Paths of the tiles of either side that have a tile of the other within reach."""

    def places(tiles: list[tuple[int, int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, d = np.radians(_by_order(healpix.centre, tiles))
        return np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], 1), np.degrees(d), np.asarray([healpix.diagonal(o) for o, _, _ in tiles])

    if not left or not right:
        return [], []
    (u, d, a), (v, e, b) = places(left), places(right)
    hit_l, hit_r = np.zeros(len(left), dtype=bool), np.zeros(len(right), dtype=bool)
    # a tile is held against those of its band of declination only, of one reach at a time
    for reach in np.unique(b):
        own = np.flatnonzero(b == reach)
        own = own[np.argsort(e[own])]
        far = a + reach + radius_deg
        lo, hi = np.searchsorted(e[own], d - far - 1e-6), np.searchsorted(e[own], d + far + 1e-6)
        for k in np.flatnonzero(hi > lo):
            at = own[lo[k] : hi[k]]
            near = np.degrees(np.arccos(np.clip(v[at] @ u[k], -1, 1))) <= far[k]
            hit_l[k] |= near.any()
            hit_r[at[near]] = True
    return [t[2] for t, x in zip(left, hit_l) if x], [t[2] for t, x in zip(right, hit_r) if x]


def match_tiles(spark: SparkSession, left: str, right: str, spec, **roles) -> DataFrame:
    """Match two tiled catalogues by position.

    Tiles that have no neighbour on the other side within the radius are not read, unless the join type
    keeps rows without partners of their side.
    """
    from ..catalogue import Catalogue
    from ..operators.match import match

    l, r = partitions(left), partitions(right)
    paths = near_tiles(l, r, spec.radius_arcsec / 3600.0) if spec.matcher == "sky" else ([t[2] for t in l], [t[2] for t in r])
    whole = {"all1": (True, False), "1not2": (True, False), "all2": (False, True), "2not1": (False, True), "1and2": (False, False)}.get(spec.join_type, (True, True))
    sides = []
    for path, tiles, kept, every in zip((left, right), (l, r), paths, whole):
        df = read(spark, path) if every or not kept else _tiles(spark, kept, tiles)
        own = df if every or kept else df.where("false")
        sides.append(Catalogue(own, name=Path(path).stem, **{k: v for k, v in roles.items() if v in own.columns}))
    return match(*sides, spec)


def routed(df: DataFrame, hubs: list[tuple[int, int]], pixel: str = "_pix", name: str = "hub") -> DataFrame:
    """Each row's hub: struct(order, pix) of the hub tile that its deepest pixel lies in, else that pixel itself.

    Hubs don't overlap.  They meet rows by ranges of pixels in order: a binary search in an array as long
    as there are hubs.
    """
    ranges = np.asarray(sorted((p << 2 * (DEEPEST - o), (p + 1) << 2 * (DEEPEST - o), o, p) for o, p in hubs), dtype=np.int64).reshape(-1, 4)

    @F.pandas_udf("order int, pix long")
    def hub(pix: pd.Series) -> pd.DataFrame:
        own = pix.to_numpy()
        if not len(ranges):
            return pd.DataFrame({"order": np.full(len(own), DEEPEST), "pix": own})
        at = np.maximum(np.searchsorted(ranges[:, 0], own, side="right") - 1, 0)
        inside = (ranges[at, 0] <= own) & (own < ranges[at, 1])
        return pd.DataFrame({"order": np.where(inside, ranges[at, 2], DEEPEST), "pix": np.where(inside, ranges[at, 3], own)})

    return df.withColumn(name, hub(F.col(pixel)))


def pixels(df: DataFrame, ra: str, dec: str, order: int, name: str) -> DataFrame:
    @F.pandas_udf("long")
    def of(a: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(healpix.pixel(order, a.to_numpy(), d.to_numpy()))

    return df.withColumn(name, of(F.col(ra).cast("double"), F.col(dec).cast("double")))


def leaves(df: DataFrame, pixel: str, threshold: int) -> list[tuple[int, int, int]]:
    """(order, pixel, rows) of the tiles: a tile splits while it has more rows than ``threshold``.

    Rows are counted once, by their deepest pixels; the orders above are summed from those counts.  What the
    driver sees is a row a tile.
    """
    counts = stored(df.groupBy(F.col(pixel).alias("p")).agg(F.count("*").alias("n")), "pixels")
    tiles, above = None, None
    for order in range(DEEPEST + 1):
        own = counts.groupBy(F.shiftright("p", 2 * (DEEPEST - order)).alias("pix")).agg(F.sum("n").alias("n"))
        if above is not None:
            own = own.join(above.select(F.col("pix").alias("parent")), F.shiftright("pix", 2) == F.col("parent"), "left_semi")
        ends = own if order == DEEPEST else own.where(F.col("n") <= threshold)
        ends = ends.select(F.lit(order).alias("order"), "pix", "n")
        tiles = ends if tiles is None else tiles.unionByName(ends)
        above = stored(own.where(F.col("n") > threshold), "splitting")
        if not above.take(1):
            break
    return sorted((r.order, r.pix, r.n) for r in tiles.collect())


def write(df: DataFrame, path: str, ra: str, dec: str, threshold: int = 100_000, ordering: str = "NESTED") -> None:
    """Adaptive tiles of at most ``threshold`` rows, to order 10, with partition info and properties.

    Rows stream to their tiles' files on the executors, tile by tile, so memory doesn't grow with a tile.
    ``properties`` comes last: a folder without it is no catalogue.  Tiles are named by their numbers in
    ``ordering``.
    """
    numbers = {"NESTED": lambda order, pix: pix, "RING": healpix.nested_to_ring}[ordering]
    spark = df.sparkSession
    store, target = Storage(spark), uri_of(path).rstrip("/")
    if store.exists(target):
        raise FileExistsError(path)
    columns = df.columns
    placed = stored(pixels(df, ra, dec, DEEPEST, "_pix"), "placed")
    tiles = leaves(placed, "_pix", threshold)
    names = {(o, p): n for (o, p, _), n in zip(tiles, _by_order(numbers, tiles)[0].astype(np.int64).tolist())}
    name_of = lambda order, pix: names[order, pix]
    place = {(o, p): f"dataset/Norder={o}/Dir={healpix.directory(name_of(o, p))}/Npix={name_of(o, p)}.parquet" for o, p, _ in tiles}
    try:
        if tiles:
            keyed = routed(placed, [(o, p) for o, p, _ in tiles]).select(F.col("hub.order").alias("_order"), F.col("hub.pix").alias("_p"), *[f"`{c}`" for c in columns])

            def save(batches):
                import pyarrow as pa
                import pyarrow.parquet as pq
                from pyarrow import fs

                files, root = fs.FileSystem.from_uri(target)
                writer, now, n, part = None, None, 0, ""

                def done():
                    writer.close()
                    files.move(part, f"{root}/{place[now]}")  # a task that runs again replaces what it left
                    return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([n], pa.int64())], ["order", "pix", "n"])

                for batch in batches:
                    orders, pixs = batch.column("_order").to_numpy(), batch.column("_p").to_numpy()
                    edges = np.flatnonzero((orders[1:] != orders[:-1]) | (pixs[1:] != pixs[:-1])) + 1
                    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(orders)]):
                        if hi == lo:
                            continue
                        key = (int(orders[lo]), int(pixs[lo]))
                        own = pa.Table.from_batches([batch.slice(lo, hi - lo).select(columns)])
                        if key != now:
                            if writer is not None:
                                yield done()
                            now, n = key, 0
                            folder = f"{root}/{place[key]}".rpartition("/")[0]
                            files.create_dir(folder, recursive=True)
                            part = f"{root}/{place[key]}.{uuid.uuid4().hex}"
                            writer = pq.ParquetWriter(part, own.schema, filesystem=files)
                        writer.write_table(own)
                        n += hi - lo
                if writer is not None:
                    yield done()

            dealt = keyed.repartition("_order", "_p").sortWithinPartitions("_order", "_p")
            written = {(r.order, r.pix): r.n for r in dealt.mapInArrow(save, "order int, pix long, n long").collect()}
            if written != {(o, p): n for o, p, n in tiles}:
                raise InputError("tiles differ from their counts", path)
        else:
            import pyarrow as pa
            import pyarrow.parquet as pq
            from pyspark.sql.pandas.types import to_arrow_schema

            sink = pa.BufferOutputStream()
            pq.write_metadata(to_arrow_schema(df.schema), sink)
            store.write(f"{target}/dataset/_common_metadata", sink.getvalue().to_pybytes())
        info = io.StringIO()
        csv.writer(info).writerows([("Norder", "Dir", "Npix"), *((o, healpix.directory(name_of(o, p)), name_of(o, p)) for o, p, _ in tiles)])
        store.write(f"{target}/partition_info.csv", info.getvalue().encode())
        facts = {"obs_collection": Path(path).stem, "dataproduct_type": "object", "hats_nrows": sum(n for _, _, n in tiles), "hats_col_ra": ra, "hats_col_dec": dec, "hats_npix_suffix": ".parquet", "hats_ordering": ordering, "hats_order": max((o for o, _, _ in tiles), default=0), "hats_max_rows": threshold}
        store.write(f"{target}/properties", "".join(f"{k}={v}\n" for k, v in facts.items()).encode())
    except BaseException:
        store.remove(target)
        raise
