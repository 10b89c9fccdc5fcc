"""A table with the roles its columns play in matching."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import InputError, MatchError
from .functions.geometry import detect_coordinates

#: Factors from a unit of position errors to arcseconds (fixed values).
ERROR_UNITS = {"arcsec": 1.0, "mas": 1e-3, "deg": 3600.0, "arcmin": 60.0}


@dataclass(frozen=True)
class Catalogue:
    df: DataFrame
    name: str = "catalogue"
    ra: str | None = None
    dec: str | None = None
    id: str | None = None
    ra_err: str | None = None
    dec_err: str | None = None
    error_unit: str = "arcsec"
    default_error: float | None = None
    corr: str | None = None
    epoch: float | None = None
    epoch_column: str | None = None
    pm_ra: str | None = None
    pm_dec: str | None = None
    parallax: str | None = None
    radial_velocity: str | None = None
    frame: str = "icrs"
    covariance: dict[str, str] = field(default_factory=dict)
    release_namespace: str | None = None

    def resolved(self) -> Catalogue:
        """With coordinate columns, which are found by name where they aren't given."""
        ra, dec = detect_coordinates(self.df.columns)
        ra, dec = self.ra or ra, self.dec or dec
        missing = [c for c in (ra, dec) if c is None or c not in self.df.columns]
        if missing:
            raise InputError(f"catalogue {self.name!r} has no coordinate columns among {self.df.columns}", self.name)
        if self.error_unit not in ERROR_UNITS:
            raise MatchError(f"unknown unit of position errors {self.error_unit!r}")
        return replace(self, ra=ra, dec=dec)

    def has(self, *roles: str) -> bool:
        return all(getattr(self, r) in self.df.columns for r in roles)

    @property
    def factor(self) -> float:
        return ERROR_UNITS[self.error_unit]

    @property
    def floor(self) -> float | None:
        """The default error of each axis in arcseconds."""
        if self.default_error is None:
            return None
        value = float(self.default_error) * self.factor
        if not math.isfinite(value) or value < 0:
            raise MatchError("default_error must be finite and not negative")
        return value

    def column(self, role: str) -> Column:
        return F.col(f"`{getattr(self, role)}`").cast("double")


def bad_coordinate(ra: Column, dec: Column) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != math.inf)
    return ~(finite(ra) & finite(dec) & F.coalesce(F.abs(dec) <= 90.0, F.lit(False)))


def bad_error(value: Column) -> Column:
    return value.isNull() | F.isnan(value) | (F.abs(value) == math.inf) | (value < 0)


def check_frames(catalogues: list[Catalogue], target_epoch: float | None = None) -> None:
    frames = set()
    for c in catalogues:
        if not isinstance(c.frame, str) or not c.frame or c.frame != c.frame.strip():
            raise MatchError(f"catalogue {c.name!r} needs a declared coordinate frame")
        frames.add(c.frame.lower())
    if len(frames) > 1:
        raise MatchError("can't match different coordinate frames; transform inputs to one frame first")
    if target_epoch is not None and frames != {"icrs"}:
        raise MatchError("propagation to a target epoch needs ICRS coordinates")
