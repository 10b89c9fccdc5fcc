"""Tables from and to files, by suffix; FITS tables by a small reader and writer of our own."""

from __future__ import annotations

import math
import os
import re
import shutil
import uuid
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..errors import InputError

SUFFIXES = (".parquet", ".csv", ".tsv", ".tab", ".fits", ".fit")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A table by suffix; a folder of tiles by its layout."""
    from . import tiles

    suffix = Path(path).suffix.lower()
    if suffix in (".fits", ".fit"):
        return read_fits(spark, path)
    if tiles.is_tiled(path):
        return tiles.read(spark, path)
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix in (".csv", ".tsv", ".tab"):
        return spark.read.csv(path, header=True, inferSchema=True, sep="," if suffix == ".csv" else "\t")
    raise InputError(f"can't tell the format of {path!r}; known suffixes are {', '.join(SUFFIXES)}", path)


def write(df: DataFrame, path: str, *, single: bool = False, ra: str | None = None, dec: str | None = None, threshold: int = 100_000) -> None:
    """Write by suffix: a folder of part files, or with ``single`` one file; ``.hats`` makes tiles."""
    from . import tiles

    suffix = Path(path).suffix.lower()
    if suffix == ".hats":
        tiles.write(df, path, ra, dec, threshold)
    elif suffix in (".fits", ".fit"):
        write_fits(df, path)
    elif suffix in (".parquet", ".csv", ".tsv", ".tab"):
        kind = "parquet" if suffix == ".parquet" else "csv"
        options = {} if kind == "parquet" else {"header": True, "sep": "," if suffix == ".csv" else "\t"}
        if not single:
            df.write.format(kind).options(**options).save(path)
            return
        own = f"{path}.{uuid.uuid4().hex}"
        try:
            df.coalesce(1).write.format(kind).options(**options).save(own)
            os.replace(next(Path(own).glob(f"part-*.{kind}")), path)
        finally:
            shutil.rmtree(own, ignore_errors=True)
    else:
        raise InputError(f"can't tell the format of {path!r}", path)


# ---- FITS ----

BLOCK = 2880
#: Rows that one task reads.
FITS_ROWS = 250_000
#: Letters of binary table columns, and their big-endian types (fixed values).
KINDS = {"L": "S1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "A": "S"}


def _cards(f) -> dict[str, str | int | float | bool]:
    out: dict = {}
    while True:
        block = f.read(BLOCK)
        if len(block) < BLOCK:
            raise EOFError
        for k in range(0, BLOCK, 80):
            card = block[k : k + 80].decode("ascii", "replace")
            name = card[:8].strip()
            if name == "END":
                return out
            if card[8:10] == "= ":
                raw = card[10:]
                m = re.match(r"\s*'((?:[^']|'')*)'", raw)
                if m:
                    out[name] = m[1].replace("''", "'").rstrip()
                else:
                    raw = raw.partition("/")[0].strip()
                    out[name] = raw == "T" if raw in ("T", "F") else float(raw.replace("D", "E")) if re.search(r"[.EeDd]", raw) else int(raw) if raw else ""


def _opened(path: str):
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
    return store.open_input_file(at)


@dataclass
class FitsTable:
    """Where the first binary table of a file lies and how its rows are laid out."""

    path: str
    head: dict
    start: int
    fields: list[tuple[str, str, str, int]]

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(f"f{k}", kind, (n,)) if n != 1 else (f"f{k}", kind) for k, (_, _, kind, n) in enumerate(self.fields)])

    @property
    def rows(self) -> int:
        return int(self.head["NAXIS2"])

    def columns(self, lo: int, hi: int) -> dict[str, np.ma.MaskedArray | list]:
        """Columns of some rows; TNULL integers and NaN stay masked or NaN; array columns are left out."""
        with _opened(self.path) as f:
            f.seek(self.start + lo * self.dtype.itemsize)
            rows = np.frombuffer(f.read((hi - lo) * self.dtype.itemsize), dtype=self.dtype)
        out: dict = {}
        for k, (name, letter, _, n) in enumerate(self.fields):
            if n != 1:
                continue
            v = rows[f"f{k}"]
            if letter == "A":
                out[name] = [x.rstrip(b" \0").decode("utf-8", "replace") for x in v]
            elif letter == "L":
                out[name] = [None if x not in (b"T", b"F") else x == b"T" for x in v]
            else:
                null = self.head.get(f"TNULL{k + 1}")
                scale, zero = self.head.get(f"TSCAL{k + 1}", 1), self.head.get(f"TZERO{k + 1}", 0)
                own = v.astype(v.dtype.newbyteorder("="))
                mask = own == null if null is not None else np.zeros(len(own), bool)
                own = own if (scale, zero) == (1, 0) else own * scale + zero
                out[name] = np.ma.array(own, mask=mask)
        return out


def fits_table(path: str) -> FitsTable:
    with _opened(path) as f:
        while True:
            try:
                head = _cards(f)
            except EOFError:
                raise InputError(f"no binary table in {path!r}", path) from None
            size = abs(int(head.get("BITPIX", 8))) // 8
            count = math.prod(int(head[f"NAXIS{k}"]) for k in range(1, int(head.get("NAXIS", 0)) + 1)) if head.get("NAXIS") else 0
            total = size * (count + int(head.get("PCOUNT", 0)))
            if head.get("XTENSION") == "BINTABLE":
                break
            f.seek(f.tell() + -(-total // BLOCK) * BLOCK)
        fields = []
        for k in range(1, int(head["TFIELDS"]) + 1):
            m = re.match(r"(\d*)([A-Z])", str(head[f"TFORM{k}"]))
            n, letter = int(m[1] or 1), m[2]
            if letter not in KINDS:
                raise InputError(f"column format {head[f'TFORM{k}']!r} isn't known", path)
            kind = f"S{n}" if letter == "A" else KINDS[letter]
            fields.append((str(head.get(f"TTYPE{k}", f"col{k}")), letter, kind, 1 if letter == "A" else n))
        return FitsTable(path, head, f.tell(), fields)


def read_fits(spark: SparkSession, path: str) -> DataFrame:
    """A FITS table as a DataFrame.  Rows have one length, so each task reads a range of ``FITS_ROWS`` of them."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    def batch(columns: dict) -> pa.RecordBatch:
        arrays = [pa.array(v.tolist(), pa.from_numpy_dtype(v.dtype)) if isinstance(v, np.ma.MaskedArray) else pa.array(v) for v in columns.values()]
        return pa.RecordBatch.from_arrays(arrays, list(columns))

    table = fits_table(path)
    schema = from_arrow_schema(batch(table.columns(0, min(1, table.rows))).schema)
    ranges = max(1, -(-table.rows // FITS_ROWS))

    def run(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                yield batch(table.columns(k * FITS_ROWS, min(table.rows, (k + 1) * FITS_ROWS)))

    return spark.range(ranges, numPartitions=ranges).mapInArrow(run, schema)


def write_fits(df: DataFrame, path: str) -> None:
    """A single FITS binary table; nulls become NaN, blanks or TNULL.

    Tasks write their rows' bytes to the shared folder, and the driver puts them one after another, block by block.
    """
    from pyarrow import fs

    from ..shared import bound_batches, fresh, settled

    letters = {"bigint": ("K", ">i8"), "int": ("J", ">i4"), "smallint": ("I", ">i2"), "tinyint": ("I", ">i2"), "double": ("D", ">f8"), "float": ("E", ">f4"), "boolean": ("L", "S1")}
    types = dict(df.dtypes)
    if odd := [c for c, t in types.items() if t not in letters and t != "string"]:
        raise InputError(f"columns {odd} have types that FITS tables can't hold", path)
    from pyspark.sql import functions as F

    df = settled(df)
    texts = [c for c, t in types.items() if t == "string"]
    size = df.agg(F.count("*").alias("_n"), *[F.max(F.octet_length(f"`{c}`")).alias(c) for c in texts]).first()
    width = {c: max(1, size[c] or 1) for c in texts}
    dtype = np.dtype([(f"f{k}", f"S{width[c]}" if t == "string" else letters[t][1]) for k, (c, t) in enumerate(types.items())])
    card = lambda name, value: f"{name:<8}= {value}".ljust(80)
    text = lambda s: "'" + str(s).replace("'", "''").ljust(8) + "'"
    least = {"bigint": -(2**63), "int": -(2**31), "smallint": -(2**15), "tinyint": -(2**15)}

    def block(cards: list[str]) -> bytes:
        return "".join([*cards, "END".ljust(80)]).encode().ljust(-(-(80 * (len(cards) + 1)) // BLOCK) * BLOCK)

    parts, kinds = fresh(df.sparkSession, "fits"), list(types.items())

    def encoded(batch) -> bytes:
        import pyarrow as pa

        out = np.empty(batch.num_rows, dtype=dtype)
        for k, (c, t) in enumerate(kinds):
            v = batch.column(k)
            if t == "string":
                out[f"f{k}"] = [b"" if x is None else x.encode() for x in v.to_pylist()]
            elif t == "boolean":
                out[f"f{k}"] = [b"\0" if x is None else b"T" if x else b"F" for x in v.to_pylist()]
            else:
                v = v.cast(pa.int16()) if t == "tinyint" else v
                out[f"f{k}"] = v.fill_null(least.get(t, float("nan"))).to_numpy(zero_copy_only=False)
        return out.tobytes()

    def save(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(parts)
        store.create_dir(root, recursive=True)
        n, name = 0, uuid.uuid4().hex
        with store.open_output_stream(f"{root}/{name}") as sink:
            for batch in batches:
                sink.write(encoded(batch))
                n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64()), pa.array([name])], ["k", "n", "name"])

    bound_batches(df.sparkSession)
    told = sorted(df.mapInArrow(save, "k long, n long, name string").collect())
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.write(block([card("SIMPLE", "T".rjust(20)), card("BITPIX", "8".rjust(20)), card("NAXIS", "0".rjust(20)), card("EXTEND", "T".rjust(20))]))
        cards = [card("XTENSION", text("BINTABLE")), card("BITPIX", "8".rjust(20)), card("NAXIS", "2".rjust(20)), card("NAXIS1", str(dtype.itemsize).rjust(20)), card("NAXIS2", str(size["_n"]).rjust(20)), card("PCOUNT", "0".rjust(20)), card("GCOUNT", "1".rjust(20)), card("TFIELDS", str(len(types)).rjust(20))]
        for k, (c, t) in enumerate(types.items(), 1):
            cards += [card(f"TTYPE{k}", text(c)), card(f"TFORM{k}", text(f"{width[c]}A" if t == "string" else f"1{letters[t][0]}"))]
            if t in least:
                cards.append(card(f"TNULL{k}", str(least[t]).rjust(20)))
        f.write(block(cards))
        store, root = fs.FileSystem.from_uri(parts)
        total = 0
        for r in told:
            total += r.n
            with store.open_input_stream(f"{root}/{r.name}") as part:
                shutil.copyfileobj(part, f, 8 << 20)
        store.delete_dir(root)
        if total != size["_n"]:
            raise InputError("rows differ from their count", path)
        f.write(bytes(-(total * dtype.itemsize) % BLOCK))
    os.replace(own, path)
