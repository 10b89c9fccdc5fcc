"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import BATCH_BYTES as BATCH_BYTES
from ..shared import BATCH_ROWS as BATCH_ROWS
from ..shared import bound_batches as bound_batches
from ..shared import stored as stored  # cuts the lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col, mod: int):
    """crc32 of an id written as text, modulo ``mod``."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(mod)


def lean(run):
    """A function over Arrow batches that gives its memory back when a task ends.

    Workers stay for the next task, and what they have freed would stay with them, beside the JVM's own.
    """

    @functools.wraps(run)
    def over(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return over


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra columns can't clash with those added later, in bounded batches."""
    bound_batches(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") for c in columns])


def lowest(df: DataFrame, column: str, n: int, total: int) -> DataFrame:
    """The ``n`` rows whose hash of ``column`` is lowest, of about ``total``.

    Hashes above twice the share that is wanted are let go before the sort, so what meets in one task
    is about ``2 * n + 64`` rows, however many partitions there are; fewer than ``n`` are left with
    less than 1e-15.
    """
    top = 1 << 31
    h = F.pmod(F.xxhash64(column), F.lit(top))
    share = min(1.0, (2 * n + 64) / max(1, total))
    return df.where(h < int(top * share)).orderBy(h, column).limit(n)


#: Bits of a filter for each thing it holds, and its least and most bits (32 MiB).
PER_THING, LEAST_BITS, MOST_BITS, PAGE = 16, 1 << 16, 1 << 28, 1 << 16


def filter_bits(things: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (PER_THING * things).bit_length()))


def bitmap(slots: DataFrame, bits: int) -> bytes:
    """``bits`` bits, those set that ``slots`` (slot long) names; pages of PAGE bits are made by tasks."""

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(PAGE, dtype=np.uint8)
        own[pdf["at"].to_numpy()] = 1
        return pd.DataFrame({"page": pdf["page"].iloc[:1], "body": [np.packbits(own, bitorder="little").tobytes()]})

    at = slots.select((F.col("slot") / PAGE).cast("int").alias("page"), (F.col("slot") % PAGE).cast("int").alias("at")).distinct()
    out = bytearray(bits // 8)
    for r in at.groupBy("page").applyInPandas(page, "page int, body binary").collect():  # bits / 8 bytes
        out[r.page * PAGE // 8 : (r.page + 1) * PAGE // 8] = r.body
    return bytes(out)


def id_filter(ids: DataFrame) -> tuple[bytes, list[Column]]:
    """A filter of the ids in the first column, which lets all of them by and few others, and an id's two slots as columns of ``doc_id``."""
    bits = filter_bits(ids.count())
    slots = lambda c: [F.pmod(F.xxhash64(c, F.lit(k)), F.lit(bits)) for k in (1, 2)]
    found = bitmap(ids.select(F.explode(F.array(*slots(F.col(ids.columns[0])))).alias("slot")), bits)
    return found, [c.alias(f"_slot{k}") for k, c in enumerate(slots(F.col("doc_id")))]


def in_filter(found: bytes, slots: list[np.ndarray]) -> np.ndarray:
    """Which rows' slots are all set."""
    bits = np.frombuffer(found, dtype=np.uint8)
    out = np.ones(len(slots[0]), dtype=bool)
    for at in slots:
        out &= (bits[at >> 3] >> (at & 7)) & 1 > 0
    return out


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often and in whatever loops it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
