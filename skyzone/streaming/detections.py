"""A stream of detections matched with a static catalogue, batch by batch.

The zone join is an equi-join, so it runs unchanged between a stream and a table: each micro-batch is dealt to
cells and meets the table's rows there, without state.  All pairs come out as they are found (append mode);
the best per detection needs an aggregation over the detection's own row, which ``foreachBatch`` gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..catalogue import Catalogue
from ..functions.geometry import separation_of, unit_vector
from ..operators.match import match
from ..operators.zonejoin import zone_join
from ..specs import MatchSpec


def pairs(detections: DataFrame, static: Catalogue, radius_arcsec: float, *, id: str = "id", ra: str = "ra", dec: str = "dec") -> DataFrame:
    """All pairs within a radius: detection columns, the catalogue's columns (``_2`` where taken) and ``sep_arcsec``.

    Detections without finite coordinates are left out, as a stream can't be checked beforehand.
    """
    static = static.resolved()
    good = detections.where(F.col(ra).isNotNull() & F.col(dec).isNotNull() & ~F.isnan(ra) & (F.abs(F.col(dec)) <= 90))
    left = good.select(F.struct("*").alias("_left"), F.col(ra).cast("double").alias("l_ra"), F.col(dec).cast("double").alias("l_dec"))
    right = static.df.select(F.struct("*").alias("_right"), static.column("ra").alias("r_ra"), static.column("dec").alias("r_dec"))
    for side in "lr":
        own = dict(zip((f"{side}_ux", f"{side}_uy", f"{side}_uz"), unit_vector(F.col(f"{side}_ra"), F.col(f"{side}_dec"))))
        left, right = (left.withColumns(own), right) if side == "l" else (left, right.withColumns(own))
    out = zone_join(left, right, radius_arcsec + 1e-6).withColumn("sep_arcsec", separation_of(tuple(F.col(f"l_u{k}") for k in "xyz"), tuple(F.col(f"r_u{k}") for k in "xyz")))
    taken = set(detections.columns)
    columns = [F.col(f"_left.`{c}`").alias(c) for c in detections.columns] + [F.col(f"_right.`{c}`").alias(c + "_2" if c in taken else c) for c in static.df.columns]
    return out.where(F.col("sep_arcsec") <= radius_arcsec).select(*columns, "sep_arcsec")


def match_batches(detections: DataFrame, static: Catalogue, spec: MatchSpec, sink: Callable[[DataFrame, int], None], *, id: str | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Match each micro-batch with the full operator and hand it to ``sink(result, batch)``."""

    def one(batch: DataFrame, number: int) -> None:
        sink(match(Catalogue(batch, name="detections", id=id), static, spec), number)

    writer = detections.writeStream.foreachBatch(one)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
