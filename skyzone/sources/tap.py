"""Queries for remote table services, as text, and a client whose transport can be replaced."""

from __future__ import annotations

import hashlib
import importlib
import math
import re
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from ..errors import ServiceError
from ..functions.geometry import cone, separation
from ..operators.zonejoin import zone_join

POLL_SECONDS, MOST_SECONDS = 0.5, 6 * 3600
_PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


def quoted(name: str) -> str:
    """Each dotted part in double quotes, unless it is plain or quoted already."""
    parts = re.findall(r'"(?:[^"]|"")*"|[^.]+', name)
    return ".".join(p if p.startswith('"') or _PLAIN.match(p) else '"' + p.replace('"', '""') + '"' for p in parts)


def box_predicate(ra: str, dec: str, centre: tuple[float, float], radius_deg: float) -> str:
    """Bounds of a cone in coordinates, for services without CONTAINS."""
    lo, hi = max(-90.0, centre[1] - radius_deg), min(90.0, centre[1] + radius_deg)
    band = f"{quoted(dec)} BETWEEN {lo!r} AND {hi!r}"
    if centre[1] + radius_deg >= 90 or centre[1] - radius_deg <= -90 or radius_deg >= 90:
        return band
    spread = math.degrees(math.asin(min(1.0, math.sin(math.radians(radius_deg)) / math.cos(math.radians(centre[1])))))
    a, b = (centre[0] - spread) % 360, (centre[0] + spread) % 360
    if spread >= 180:
        return band
    turn = f"{quoted(ra)} BETWEEN {a!r} AND {b!r}" if a <= b else f"({quoted(ra)} >= {a!r} OR {quoted(ra)} <= {b!r})"
    return f"{band} AND {turn}"


def cone_query(table: str, columns: list[str], ra: str, dec: str, centre: tuple[float, float], radius_deg: float, *, contains: bool = True, id_column: str | None = None) -> str:
    """ADQL for a cone; coordinates and id are always selected."""
    names = list(dict.fromkeys([*columns, ra, dec, *([id_column] if id_column else [])]))
    where = f"1=CONTAINS(POINT('ICRS', {quoted(ra)}, {quoted(dec)}), CIRCLE('ICRS', {centre[0]!r}, {centre[1]!r}, {radius_deg!r}))" if contains else box_predicate(ra, dec, centre, radius_deg)
    return f"SELECT {', '.join(map(quoted, names)) if columns else '*'} FROM {quoted(table)} WHERE {where}"


def self_join_query(tables: tuple[str, str], columns: tuple[list[str], list[str]], coords: tuple[tuple[str, str], tuple[str, str]], radius_arcsec: float) -> str:
    """ADQL for a fixed-radius join of two tables of one service; columns become ``a_*`` and ``b_*``."""
    names = [f"{s}.{quoted(c)} AS {s}_{c}" for s, own in zip("ab", columns) for c in own]
    points = [f"POINT('ICRS', {s}.{quoted(ra)}, {s}.{quoted(dec)})" for s, (ra, dec) in zip("ab", coords)]
    return (
        f"SELECT {', '.join(names)}, DISTANCE({points[0]}, {points[1]}) * 3600 AS all_sep_arcsec FROM {quoted(tables[0])} AS a JOIN {quoted(tables[1])} AS b "
        f"ON 1=CONTAINS({points[0]}, CIRCLE('ICRS', b.{quoted(coords[1][0])}, b.{quoted(coords[1][1])}, {radius_arcsec / 3600!r}))"
    )


@dataclass(frozen=True)
class Cone:
    """A cone over one table: as text for a service, or over a DataFrame of the same columns."""

    table: str
    columns: tuple[str, ...]
    ra: str
    dec: str
    centre: tuple[float, float]
    radius_deg: float
    contains: bool = True

    def text(self) -> str:
        return cone_query(self.table, list(self.columns), self.ra, self.dec, self.centre, self.radius_deg, contains=self.contains)

    def over(self, tables: dict[str, DataFrame]) -> DataFrame:
        df = tables[self.table]
        names = list(dict.fromkeys([*self.columns, self.ra, self.dec])) if self.columns else df.columns
        found = cone(df, self.ra, self.dec, self.centre, self.radius_deg) if self.contains else df.where(box_predicate(self.ra, self.dec, self.centre, self.radius_deg).replace('"', "`"))
        return found.select(*[f"`{c}`" for c in names])


@dataclass(frozen=True)
class SelfJoin:
    """A fixed-radius join of two tables of one service, as text or over DataFrames."""

    tables: tuple[str, str]
    columns: tuple[tuple[str, ...], tuple[str, ...]]
    coords: tuple[tuple[str, str], tuple[str, str]]
    radius_arcsec: float

    def text(self) -> str:
        return self_join_query(self.tables, tuple(map(list, self.columns)), self.coords, self.radius_arcsec)

    def over(self, tables: dict[str, DataFrame]) -> DataFrame:
        sides = []
        for tag, name, own, (ra, dec) in zip("lr", self.tables, self.columns, self.coords):
            named = [F.col(f"`{c}`").alias(f"{'ab'['lr'.index(tag)]}_{c}") for c in own]
            sides.append(tables[name].select(*named, F.col(f"`{ra}`").cast("double").alias(f"{tag}_ra"), F.col(f"`{dec}`").cast("double").alias(f"{tag}_dec")))
        sep = separation(F.col("l_ra"), F.col("l_dec"), F.col("r_ra"), F.col("r_dec"))
        pairs = zone_join(*sides, self.radius_arcsec + 1e-6).withColumn("all_sep_arcsec", sep)
        return pairs.where(F.col("all_sep_arcsec") <= self.radius_arcsec).drop("l_ra", "l_dec", "r_ra", "r_dec")


def table_search_query(words: list[str]) -> str:
    like = " AND ".join("(LOWER(table_name) LIKE '%{0}%' OR LOWER(description) LIKE '%{0}%')".format(w.lower().replace("'", "''")) for w in words)
    return f"SELECT table_name, description FROM TAP_SCHEMA.tables WHERE {like}" if words else "SELECT table_name, description FROM TAP_SCHEMA.tables"


def columns_query(table: str) -> str:
    return "SELECT column_name, datatype, unit, ucd FROM TAP_SCHEMA.columns WHERE table_name = '{}'".format(table.replace("'", "''"))


def coordinates_by_ucd(columns: list[tuple[str, str | None]]) -> tuple[str | None, str | None]:
    """The columns whose UCD is a right ascension and a declination; main ones first."""
    find = lambda key: next((n for want in (f"{key};meta.main", key) for n, u in columns if u and u.lower().startswith(want)), None)
    return find("pos.eq.ra"), find("pos.eq.dec")


def uploaded(local: DataFrame, columns: list[str], key: str = "_key") -> tuple[DataFrame, DataFrame]:
    """The local rows with a key of their own, written once so that it stays, and the part of them to send."""
    rows = numbered_once(local, key)
    return rows, rows.select(key, *[f"`{c}`" for c in columns])


def numbered_once(df: DataFrame, key: str) -> DataFrame:
    from ..shared import stored

    return stored(df.withColumn(key, F.monotonically_increasing_id()), "uploaded")


def rejoined(rows: DataFrame, answer: DataFrame, key: str = "_key") -> DataFrame:
    """A service's answer, which carries the key, with the local rows; taken names get ``_2``."""
    taken = set(rows.columns)
    own = [F.col(f"`{c}`").alias(c + "_2" if c in taken and c != key else c) for c in answer.columns]
    return rows.join(answer.select(*own), key).drop(key)


def endpoint(url: str) -> str:
    """A service's base from the address of any of its resources."""
    return re.sub(r"/(?:a?sync|tables|capabilities|availability|examples)(?:[/?#].*)?$", "", url.rstrip("/"))


def table_id(text: str) -> tuple[str | None, str] | None:
    """(service address or None, table) that a text names: ``https://host/tap#schema.table`` or ``schema.table``."""
    m = re.fullmatch(r"(?:(https?://[^#\s]+)#)?([A-Za-z_]\w*(?:\.(?:[A-Za-z_]\w*|\"[^\"]+\"))+)", text.strip())
    return (m[1] and endpoint(m[1]), m[2]) if m else None


def searched(tables: DataFrame, words: list[str]) -> DataFrame:
    """Rows of a service's list of tables (table_name, description) that hold all words, as ``table_search_query`` asks."""
    for w in words:
        tables = tables.where(F.contains(F.lower("table_name"), F.lit(w.lower())) | F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lit(w.lower())))
    return tables.select("table_name", "description")


def entry_of(table: str, url: str, columns: list[tuple[str, str | None]]) -> dict[str, str]:
    """A registry entry of a table whose columns' UCDs say where its positions are."""
    ra, dec = coordinates_by_ucd(columns)
    if ra is None or dec is None:
        raise ServiceError(f"table {table!r} has no columns of positions")
    key = next((n for n, u in columns if u and u.lower().startswith("meta.id;meta.main")), None)
    return {"path": f"{endpoint(url)}#{table}", "ra": ra, "dec": dec, **({"id": key} if key else {})}


class Service:
    """An asynchronous job: submit, poll, fetch.  ``transport`` has submit(query), phase(job) and fetch(job)."""

    def __init__(self, transport, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.transport, self.sleep, self.clock = transport, sleep, clock

    def run(self, query: str) -> str:
        """The path of the result."""
        job, began = self.transport.submit(query), self.clock()
        while True:
            phase = self.transport.phase(job)
            if phase == "COMPLETED":
                return self.transport.fetch(job)
            if phase in ("ERROR", "ABORTED"):
                raise ServiceError(f"job {job} ended as {phase}")
            if self.clock() - began > MOST_SECONDS:
                raise ServiceError(f"job {job} took more than {MOST_SECONDS} s")
            self.sleep(POLL_SECONDS)

    def read(self, spark: SparkSession, query: str) -> DataFrame:
        from .files import read

        return read(spark, self.run(query))


class Recorded:
    """A transport that answers from a folder of results, each a CSV file named by its query's digest."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def submit(self, query: str) -> str:
        return hashlib.sha256(query.encode()).hexdigest()[:32]

    def phase(self, job: str) -> str:
        return "COMPLETED"

    def fetch(self, job: str) -> str:
        return f"{self.folder}/{job}.csv"


class ServiceTable(DataSource):
    """``spark.read.format("skyzone_service")``: the result of a query, fetched by one executor task.

    Options: ``query``; ``transport``, the ``module:function`` that makes a transport on the executor, with
    ``argument`` if that is given; and the schema, given by ``.schema``.  Results are CSV files with a
    header, at a path or a URI that Arrow can open.
    """

    @classmethod
    def name(cls) -> str:
        return "skyzone_service"

    def reader(self, schema) -> DataSourceReader:
        return _ServiceReader(self.options, schema)


class _ServiceReader(DataSourceReader):
    def __init__(self, options, schema):
        self.options, self.types = dict(options), schema

    def read(self, partition):
        import pyarrow as pa
        from pyarrow import csv, fs
        from pyspark.sql.pandas.types import to_arrow_schema

        module, _, factory = self.options["transport"].partition(":")
        make = getattr(importlib.import_module(module), factory)
        transport = make(self.options["argument"]) if "argument" in self.options else make()
        shape = to_arrow_schema(self.types)
        path = retried(lambda: Service(transport).run(self.options["query"]))
        store, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        found = csv.read_csv(store.open_input_stream(at), convert_options=csv.ConvertOptions(column_types=shape, include_columns=shape.names))
        yield from pa.Table.cast(found, shape).to_batches()


def retried(call: Callable, *, times: int = 3, most: float = 60.0, sleep: Callable[[float], None] = time.sleep):
    """Call again after ServiceErrors, waiting 1, 2, 4.. seconds."""
    for k in range(times):
        try:
            return call()
        except ServiceError:
            if k == times - 1:
                raise
            sleep(min(most, 2.0**k))
    return None


class RateLimiter:
    """A token bucket."""

    def __init__(self, per_second: float, burst: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = per_second, burst, clock, sleep
        self.tokens, self.last = float(burst), clock()

    def take(self) -> None:
        now = self.clock()
        self.tokens, self.last = min(self.burst, self.tokens + (now - self.last) * self.rate), now
        if self.tokens < 1:
            wait = (1 - self.tokens) / self.rate
            self.sleep(wait)
            self.last += wait
            self.tokens = 1.0
        self.tokens -= 1
