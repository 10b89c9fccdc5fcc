"""The sphere's equi-join: every left row lies in one cell, right rows go to all cells they can reach.

The sphere is cut into zones of declination and each zone into cells of right ascension, so wide that
a right row rarely touches more than one.  Left and right then meet by (zone, cell), which Catalyst
plans as a hash or sort-merge join with the exact predicate as a residual.  No pair is met twice, as a
left row has one cell only, and none is lost: a right row's cells cover its halo, at the poles all of
them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least height of a zone in degrees, and its height in halos.
LEAST_HEIGHT = 0.02
HALOS = 4.0
#: Least cells of a zone that is at most a degree high, so that rows crowded at a pole don't meet in one task.
LEAST_CELLS = 64
EPS = 1e-9


class Zones:
    def __init__(self, halo_deg: float, height: float | None = None):
        want = min(180.0, max(HALOS * halo_deg, LEAST_HEIGHT) if height is None else height)
        self.halo = halo_deg
        self.count = max(1, math.floor(180.0 / want))
        self.height = 180.0 / self.count

    def _clamped(self, dec: Column) -> Column:
        return F.least(F.greatest(F.floor((dec + 90.0) / self.height), F.lit(0)), F.lit(self.count - 1)).cast("int")

    def _cells(self, zone: Column) -> Column:
        lo = F.radians(zone * self.height - 90.0)
        hi = F.radians((zone + 1) * self.height - 90.0)
        least = LEAST_CELLS if self.height <= 1.0 else 1
        return F.greatest(F.lit(least), F.floor(360.0 * F.least(F.cos(lo), F.cos(hi)) / self.height)).cast("int")

    def one(self, df: DataFrame, ra: str, dec: str) -> DataFrame:
        """Each row with its own ``_zone`` and ``_cell``."""
        out = df.withColumn("_zone", self._clamped(F.col(dec)))
        n = self._cells(F.col("_zone"))
        return out.withColumn("_cell", (F.floor(F.pmod(F.col(ra), F.lit(360.0)) / 360.0 * n).cast("int") % n).cast("int"))

    def reached(self, df: DataFrame, ra: str, dec: str) -> DataFrame:
        """Each row once for every ``_zone`` and ``_cell`` that its halo touches."""
        reach = self.halo + EPS
        zones = F.sequence(self._clamped(F.col(dec) - reach), self._clamped(F.col(dec) + reach))
        out = df.withColumn("_zone", F.explode(zones))
        n = self._cells(F.col("_zone"))
        if self.halo >= 90.0:
            cells = F.sequence(F.lit(0), n - 1)
        else:
            polar = F.abs(F.col(dec)) + reach >= 90.0
            spread = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(math.radians(self.halo))) / F.cos(F.radians(F.col(dec)))))) + EPS
            at = F.pmod(F.col(ra), F.lit(360.0))
            lo, hi = F.floor((at - spread) / 360.0 * n), F.floor((at + spread) / 360.0 * n)
            every = polar | (hi - lo + 1 >= n)
            cells = F.when(every, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.sequence(lo, hi))
            cells = F.transform(cells, lambda c: F.pmod(c, n.cast("long")).cast("int"))
        return out.withColumn("_cell", F.explode(cells))


def zone_join(left: DataFrame, right: DataFrame, halo_arcsec: float, on: Column | None = None, height: float | None = None) -> DataFrame:
    """Pairs of rows (l_ra, l_dec, ...) and (r_ra, r_dec, ...) that can lie within the halo and satisfy ``on``."""
    zones = Zones(min(180.0, halo_arcsec / 3600.0), height)
    pairs = zones.one(left, "l_ra", "l_dec").join(zones.reached(right, "r_ra", "r_dec"), ["_zone", "_cell"]).drop("_zone", "_cell")
    return pairs if on is None else pairs.where(on)


#: Share of rows that the first level of reaches holds, and the most levels above it.
MOST_ROWS, MOST_LEVELS = 0.95, 6


def levels(left: DataFrame, right: DataFrame) -> list[tuple[float, float]]:
    """Levels of reach, as pairs (over, up to) in arcseconds, from a histogram of powers of two.

    ``l_reach`` and ``r_reach`` say how far rows reach.  The first level has at least MOST_ROWS of each
    side's rows, so that few rows of great reach don't widen the search of all others.
    """
    power = lambda c: F.greatest(F.lit(-30), F.least(F.lit(20), F.ceil(F.log2(F.greatest(F.col(c), F.lit(1e-9)))))).cast("int")
    counts: dict[str, dict[int, int]] = {}
    for side, df in (("l", left), ("r", right)):
        counts[side] = {r.p: r["count"] for r in df.where(F.col(f"{side}_reach").isNotNull()).groupBy(power(f"{side}_reach").alias("p")).count().collect()}  # 51 rows at most
    powers = sorted(set(counts["l"]) | set(counts["r"]))
    if not powers:
        return []
    first = max((next(p for p in sorted(own) if sum(n for q, n in own.items() if q <= p) >= MOST_ROWS * sum(own.values())) for own in counts.values() if own), default=powers[-1])
    higher = [p for p in powers if p > first]
    while len(higher) > MOST_LEVELS:  # neighbouring levels in one
        higher = higher[1::2] if len(higher) % 2 == 0 else [*higher[1::2], higher[-1]]
    ends = [first, *higher]
    return [(0.0 if k == 0 else 2.0 ** ends[k - 1], 2.0 ** p) for k, p in enumerate(ends)]


def reach_join(left: DataFrame, right: DataFrame, most: float) -> DataFrame:
    """Pairs of rows (l_ra, l_dec, l_reach, ...) and (r_ra, ...) that can lie within the sum of their reaches.

    A pair is met at the greater of its rows' levels: those of the right at a level with the left's at
    it or below, then those of the left with the right's below it.  ``most`` bounds every halo.
    """
    out = None
    for low, high in levels(left, right):
        halo = min(2.0 * high, most) + 1e-6
        at = {s: (F.col(f"{s}_reach") > low) & (F.col(f"{s}_reach") <= high) if low else F.col(f"{s}_reach") <= high for s in "lr"}
        parts = [zone_join(left.where(F.col("l_reach") <= high), right.where(at["r"]), halo)]
        if low:
            zones = Zones(min(180.0, halo / 3600.0))
            near = zones.one(right.where(F.col("r_reach") <= low), "r_ra", "r_dec")
            parts.append(zones.reached(left.where(at["l"]), "l_ra", "l_dec").join(near, ["_zone", "_cell"]).drop("_zone", "_cell"))
        for p in parts:
            out = p if out is None else out.unionByName(p)
    return zone_join(left, right, 1.0).where("false") if out is None else out
