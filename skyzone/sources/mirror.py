"""Local copies of remote trees and tables, replicas, and where they are kept."""

from __future__ import annotations

import math
import os
import re
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from html.parser import HTMLParser
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError
from .storage import Storage, uri_of

# Files that describe a tree, which must not be newer than its data.
DESCRIBING = ("properties", "hats.properties", "partition_info.csv", "_metadata", "_common_metadata", "catalog_info.json")


@dataclass
class Report:
    copied: list[str] = field(default_factory=list)
    kept: list[str] = field(default_factory=list)
    pruned: list[str] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)


def listing(store: Storage, root: str) -> dict[str, int]:
    """Sizes of a tree's files by their path within it."""
    return {path: size for path, size in store.files(root) if not path.endswith(".crc")}


def sync(spark: SparkSession, source: str, target: str, *, wanted: Callable[[str], bool] = lambda path: True) -> Report:
    """Make the target hold what the source holds: data first, then what describes it, then nothing else.

    Files of one path and size are kept.  A file comes under a name of its own and takes its place when it is
    whole.  What the source has no longer is pruned only if nothing failed.
    """
    store, out = Storage(spark), Report()
    there, here = {k: v for k, v in listing(store, source).items() if wanted(k)}, listing(store, target)
    wrong = []
    for path in sorted(there, key=lambda p: (p.rpartition("/")[2] in DESCRIBING, p)):
        if here.get(path) == there[path]:
            out.kept.append(path)
        else:
            wrong.append(path)
    data = [p for p in wrong if p.rpartition("/")[2] not in DESCRIBING]
    if len(data) > FEW and _reached(source) and _reached(target):
        said = _copied(spark, source, target, data)
        out.copied += [p for p in data if p not in said]
        out.failed |= {p: said[p] for p in data if p in said}
        wrong = [] if said else wrong[len(data) :]  # a description of data that isn't there would lie
    for path in wrong:
        to, part = f"{uri_of(target).rstrip('/')}/{path}", f"{uri_of(target).rstrip('/')}/{path}.{uuid.uuid4().hex}.part"
        try:
            store.copy(f"{uri_of(source).rstrip('/')}/{path}", part)
            store.remove(to)
            store.move(part, to)
            out.copied.append(path)
        except Exception as e:
            store.remove(part)
            out.failed[path] = str(e)[:200]
            if path.rpartition("/")[2] not in DESCRIBING:
                # a description of data that isn't there would lie
                break
    if not out.failed:
        for path in sorted(set(here) - set(there)):
            store.remove(f"{uri_of(target).rstrip('/')}/{path}")
            out.pruned.append(path)
    return out


#: Files that the driver copies by itself; more are copied by tasks.
FEW = 32


def _reached(root: str) -> bool:
    """Whether tasks can open the root's file system."""
    from pyarrow import ArrowException, fs

    try:
        fs.FileSystem.from_uri(uri_of(root))
    except (ArrowException, OSError):
        return False
    return True


def _copied(spark: SparkSession, source: str, target: str, paths: list[str]) -> dict[str, str]:
    """Copy files by tasks, each under a name of its own before it takes its place; what failed, and why."""
    frm, to = uri_of(source).rstrip("/"), uri_of(target).rstrip("/")

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        (a, base), (b, root) = fs.FileSystem.from_uri(frm), fs.FileSystem.from_uri(to)
        for batch in batches:
            failed: list[tuple[str, str]] = []
            for path in batch.column("path").to_pylist():
                part = f"{root}/{path}.{uuid.uuid4().hex}.part"
                try:
                    b.create_dir(part.rpartition("/")[0], recursive=True)
                    fs.copy_files(f"{base}/{path}", part, source_filesystem=a, destination_filesystem=b, use_threads=False)
                    folder, _, name = path.rpartition("/")
                    sums = f"{root}/{folder}/.{name}.crc"  # Hadoop's checksums are of what was there before
                    if b.get_file_info(sums).type != fs.FileType.NotFound:
                        b.delete_file(sums)
                    b.move(part, f"{root}/{path}")
                except Exception as e:
                    failed.append((path, str(e)[:200]))
                    if b.get_file_info(part).type != fs.FileType.NotFound:
                        b.delete_file(part)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in failed], pa.string()) for k in range(2)], ["path", "said"])

    tasks = max(1, min(len(paths) // 16, 4 * spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks)
    return {r.path: r.said for r in rows.mapInArrow(run, "path string, said string").collect()}


def replicate(spark: SparkSession, source: str, roots: Iterable[str]) -> dict[str, Report]:
    return {root: sync(spark, source, root) for root in roots}


def first_of(roots: Iterable[str], read: Callable[[str], DataFrame], schema: list[tuple[str, str]] | None = None) -> DataFrame:
    """The first replica that can be read and, where types are given, has them."""
    said = []
    for root in roots:
        try:
            df = read(root)
        except Exception as e:
            said.append(f"{root}: {str(e)[:100]}")
            continue
        if schema is None or df.dtypes == schema:
            return df
        said.append(f"{root}: other columns")
    raise InputError("no replica can be read: " + "; ".join(said))


def page_query(table: str, key: str, after, size: int) -> str:
    """One page of a table in the order of a key."""
    where = "" if after is None else f" WHERE {key} > " + (repr(after) if not isinstance(after, str) else "'" + after.replace("'", "''") + "'")
    return f"SELECT TOP {size} * FROM {table}{where} ORDER BY {key}"


def mirror_table(spark: SparkSession, fetch: Callable[[object, int], DataFrame], key: str, target: str, size: int) -> int:
    """Fetch a table's pages after the largest key that is held already; how many pages came.

    ``fetch(after, size)`` gives the ``size`` rows of smallest keys beyond ``after`` (None: from the start).
    Keys must be unique and not null; a page that isn't leaves nothing behind.
    """
    store, pages = Storage(spark), 0
    held = [e.path for e in store.children(target) if e.folder and store.exists(f"{e.path}/_SUCCESS")]
    last = spark.read.parquet(*held).agg(F.max(key)).first()[0] if held else None
    while True:
        path = f"{uri_of(target).rstrip('/')}/page-{len(held) + pages:06d}"
        fetch(last, size).write.mode("overwrite").parquet(path)
        row = spark.read.parquet(path).agg(F.count("*").alias("n"), F.count(key).alias("k"), F.countDistinct(key).alias("d"), F.max(key).alias("m")).first()
        if not row.n == row.k == row.d:
            store.remove(path)
            raise InputError(f"keys {key!r} of a page are null or repeated", target)
        if not row.n:
            store.remove(path)
            return pages
        pages, last = pages + 1, row.m
        if row.n < size:
            return pages


class _Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.found += [v for k, v in attrs if k == "href" and v]


def links(page: str) -> list[str]:
    """Names of files and folders (with a slash) that a listing page links, but parents, queries and other places."""
    parser = _Links()
    parser.feed(page)
    return sorted({x for x in parser.found if not re.match(r"[a-z]+:|[/?#.]", x)})


def roots(env: Mapping[str, str], config: Mapping[str, str], name: str = "cache") -> str:
    """A folder by environment, then by configuration, then the user's own."""
    return env.get(f"SKYZONE_{name.upper()}") or config.get(name) or str(Path(env.get("HOME", "~")) / ".cache" / "skyzone" / name)


def basic_auth(env: Mapping[str, str]) -> dict[str, str]:
    """Headers of a request, from SKYZONE_TOKEN, or SKYZONE_USER and SKYZONE_PASSWORD; none without them."""
    import base64

    if token := env.get("SKYZONE_TOKEN"):
        return {"Authorization": f"Bearer {token}"}
    if env.get("SKYZONE_USER") and env.get("SKYZONE_PASSWORD"):
        return {"Authorization": "Basic " + base64.b64encode(f"{env['SKYZONE_USER']}:{env['SKYZONE_PASSWORD']}".encode()).decode()}
    return {}


def spill_order(stored_bytes: int, fraction: float, budget_bytes: int, explicit: int | None = None) -> int | None:
    """Order of tiles at which a cell of a catalogue's read columns fits the budget; None if it fits whole."""
    if explicit is not None:
        if not 0 <= explicit <= 12:
            raise InputError("an order of tiles lies between 0 and 12")
        return explicit
    if not 0 < fraction <= 1 or budget_bytes <= 0:
        raise InputError("a share of columns lies in (0, 1] and a budget above 0")
    cells = stored_bytes * fraction / budget_bytes
    return None if cells <= 1 else min(10, max(0, math.ceil(math.log(cells / 2, 4)))) if cells > 2 else 0


def free_bytes(path: str) -> int:
    s = os.statvfs(path)
    return s.f_bavail * s.f_frsize
