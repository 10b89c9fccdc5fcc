"""Position errors, their propagation, and proper motion, as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalogue import Catalogue
from ..errors import MatchError
from .geometry import galactic_latitude

#: Radians of a milliarcsecond, and km/s of one AU a year (fixed values).
MAS = 4.84813681109536e-09
AU_YEAR = 4.740470463
LIGHT = 299792.458
#: Keys of an astrometric covariance: errors in mas and mas/yr, and correlations (fixed values).
COVARIANCE_KEYS = (
    "ra_error", "dec_error", "parallax_error", "pmra_error", "pmdec_error",
    "ra_dec_corr", "ra_parallax_corr", "ra_pmra_corr", "ra_pmdec_corr", "dec_parallax_corr",
    "dec_pmra_corr", "dec_pmdec_corr", "parallax_pmra_corr", "parallax_pmdec_corr", "pmra_pmdec_corr",
)


def _zero_if_unknown(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), 0.0).otherwise(c)


def years(cat: Catalogue, target: float) -> Column | None:
    """Years from each row's epoch to the target; rows without an epoch stay where they are."""
    if cat.has("epoch_column"):
        c = cat.column("epoch_column")
        return F.when(c.isNull() | F.isnan(c), 0.0).otherwise(F.lit(float(target)) - c)
    return None if cat.epoch is None else F.lit(float(target) - float(cat.epoch))


def moved(cat: Catalogue, target: float | None) -> tuple[Column, Column]:
    """Right ascension and declination at the target epoch, by linear motion in space.

    Rows with a positive parallax and a radial velocity move radially too, unless that makes them
    faster than half the speed of light; all others move by angle alone.
    """
    ra, dec = cat.column("ra"), cat.column("dec")
    t = None if target is None else years(cat, target)
    if t is None or not cat.has("pm_ra", "pm_dec"):
        return ra, dec
    mu_a, mu_d = _zero_if_unknown(cat.column("pm_ra")) * MAS, _zero_if_unknown(cat.column("pm_dec")) * MAS
    radial = F.lit(0.0)
    if cat.has("parallax", "radial_velocity"):
        plx, rv = cat.column("parallax"), cat.column("radial_velocity")
        speed2 = rv * rv + (mu_a * mu_a + mu_d * mu_d) / (MAS * MAS) * AU_YEAR * AU_YEAR / (plx * plx)
        good = (plx > 0) & ~F.isnan(plx) & rv.isNotNull() & ~F.isnan(rv) & (speed2 < (0.5 * LIGHT) ** 2)
        radial = F.when(good, rv * plx * MAS / AU_YEAR).otherwise(0.0)
    a, d = F.radians(ra), F.radians(dec)
    grown = 1.0 + t * radial
    x = F.cos(d) * F.cos(a) * grown + t * (-mu_a * F.sin(a) - mu_d * F.sin(d) * F.cos(a))
    y = F.cos(d) * F.sin(a) * grown + t * (mu_a * F.cos(a) - mu_d * F.sin(d) * F.sin(a))
    z = F.sin(d) * grown + t * mu_d * F.cos(d)
    still = (t == 0.0) | ((mu_a == 0.0) & (mu_d == 0.0))
    new_ra = F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))
    new_dec = F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))
    return F.when(still, ra).otherwise(new_ra), F.when(still, dec).otherwise(new_dec)


def drift(cat: Catalogue, target: float | None, magnitude: str | None = None) -> Column | None:
    """Expected motion in arcseconds of rows whose motion isn't known, from their galactic latitude."""
    if target is None or cat.has("pm_ra", "pm_dec"):
        return None
    t = years(cat, target)
    if t is None:
        return None
    sigma = 3.0 + 7.0 * F.exp(-F.abs(galactic_latitude(cat.column("ra"), cat.column("dec"))) / 20.0)
    if magnitude and magnitude in cat.df.columns:
        m = F.col(f"`{magnitude}`").cast("double")
        m = F.when(m.isNull() | F.isnan(m), 15.0).otherwise(m)
        sigma = sigma * F.least(F.lit(3.0), F.greatest(F.lit(0.3), F.pow(F.lit(10.0), -0.2 * (m - 15.0))))
    return sigma * F.abs(t) / 1000.0


def _astrometric(cat: Catalogue, target: float | None) -> tuple[Column, Column, Column]:
    """Position block (east-east, north-north, east-north) in arcsec^2, carried to the target epoch."""
    missing = [k for k in ("ra_error", "dec_error") if cat.covariance.get(k) not in cat.df.columns]
    if missing:
        raise MatchError(f"catalogue {cat.name!r} lacks declared covariance columns {missing}")

    def value(key: str) -> Column:
        name = cat.covariance.get(key)
        return _zero_if_unknown(F.col(f"`{name}`").cast("double")) if name in cat.df.columns else F.lit(0.0)

    def cov(a: str, b: str) -> Column:
        return value(f"{a}_error") * value(f"{b}_error") * value(f"{a}_{b}_corr")

    ee, nn, en = value("ra_error") * value("ra_error"), value("dec_error") * value("dec_error"), cov("ra", "dec")
    t = None if target is None else years(cat, target)
    if t is not None and cat.has("pm_ra", "pm_dec"):
        ee = ee + 2.0 * t * cov("ra", "pmra") + t * t * value("pmra_error") * value("pmra_error")
        nn = nn + 2.0 * t * cov("dec", "pmdec") + t * t * value("pmdec_error") * value("pmdec_error")
        en = en + t * (cov("ra", "pmdec") + cov("dec", "pmra")) + t * t * cov("pmra", "pmdec")
    return ee * 1e-6, nn * 1e-6, en * 1e-6


def bad_covariance(cat: Catalogue) -> Column | None:
    """True where a declared five-by-five covariance has errors that are negative or not finite, or correlations that no covariance can have."""
    names = [cat.covariance.get(k) for k in COVARIANCE_KEYS]
    if not cat.covariance or any(n not in cat.df.columns for n in names):
        return None

    @F.pandas_udf("boolean")
    def bad(values: pd.Series) -> pd.Series:
        v = np.asarray(values.tolist(), dtype=float).reshape(-1, len(COVARIANCE_KEYS))
        errors, rho = v[:, :5], v[:, 5:]
        out = ~np.isfinite(v).all(1) | (errors < 0).any(1) | (np.abs(rho) > 1).any(1)
        m = np.broadcast_to(np.eye(5), (len(v), 5, 5)).copy()
        i, j = np.triu_indices(5, 1)
        m[:, i, j] = m[:, j, i] = np.where(out[:, None], 0.0, rho)
        return pd.Series(out | (np.linalg.eigvalsh(m).min(1) < -1e-9))

    return bad(F.array(*[_zero_if_unknown(F.col(f"`{n}`").cast("double")) for n in names]))


def knows_errors(cat: Catalogue) -> bool:
    return cat.has("ra_err", "dec_err") or bool(cat.covariance) or cat.default_error is not None


def sigma(cat: Catalogue, target: float | None = None, moving: Column | None = None) -> Column | None:
    """Radial error in arcseconds: the axes' root sum of squares, a floor, and drift in quadrature."""
    floor = None if cat.floor is None else cat.floor * 2.0**0.5
    if cat.has("ra_err", "dec_err"):
        a, d = cat.column("ra_err") * cat.factor, cat.column("dec_err") * cat.factor
        out = F.sqrt(a * a + d * d)
        out = out if floor is None else F.greatest(out, F.lit(floor))
    elif cat.covariance:
        ee, nn, _ = covariance(cat, target, moving)
        return F.sqrt(ee + nn)
    elif floor is not None:
        out = F.lit(floor)
    else:
        return moving
    return out if moving is None else F.sqrt(out * out + moving * moving)


def covariance(cat: Catalogue, target: float | None = None, moving: Column | None = None) -> tuple[Column, Column, Column] | None:
    """Variances along right ascension and declination in arcsec^2, and their covariance.

    A floor is applied to each axis and half of the drift's variance added to it; the measured
    covariance of the axes is kept as it is.
    """
    if cat.has("ra_err", "dec_err"):
        a, d = cat.column("ra_err") * cat.factor, cat.column("dec_err") * cat.factor
        rho = cat.column("corr") if cat.has("corr") else F.lit(0.0)
        ee, nn, en = a * a, d * d, rho * a * d
    elif cat.covariance:
        ee, nn, en = _astrometric(cat, target)
    elif cat.floor is not None:
        ee, nn, en = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    elif moving is not None:
        half = 0.5 * moving * moving
        return half, half, F.lit(0.0)
    else:
        return None
    if cat.floor is not None:
        ee, nn = F.greatest(ee, F.lit(cat.floor**2)), F.greatest(nn, F.lit(cat.floor**2))
    if moving is not None:
        ee, nn = ee + 0.5 * moving * moving, nn + 0.5 * moving * moving
    return ee, nn, en


def mahalanobis2(delta_ra: Column, delta_dec: Column, ee: Column, nn: Column, en: Column) -> Column:
    """Squared distance in units of the summed covariance; infinite where that is singular."""
    det = ee * nn - en * en
    d2 = (nn * delta_ra * delta_ra - 2.0 * en * delta_ra * delta_dec + ee * delta_dec * delta_dec) / det
    return F.when((det > 1e-30) & ~F.isnan(d2), F.greatest(d2, F.lit(0.0))).otherwise(F.lit(float("inf")))
