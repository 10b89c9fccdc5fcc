"""What each side of a request asks for: columns, roles, and the region of a remote one."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import fields, replace
from typing import Any

from .catalogue import Catalogue
from .errors import MatchError
from .functions.geometry import sky_extent
from .specs import MatchSpec

ROLES = tuple(f.name for f in fields(Catalogue) if f.name not in ("df", "name"))
#: Roles that hold a column's name.
COLUMN_ROLES = ("ra", "dec", "id", "ra_err", "dec_err", "corr", "epoch_column", "pm_ra", "pm_dec", "parallax", "radial_velocity")


def overrides(given: dict[str, Any], count: int) -> list[dict[str, Any]]:
    """Options of each side: ``ra_2`` is the second side's ``ra``, ``ra`` every side's; the more special wins."""
    out: list[dict[str, Any]] = [{} for _ in range(count)]
    for special in (False, True):
        for name, value in given.items():
            m = re.fullmatch(r"([a-z_]+?)_([1-9]\d*)", name)
            role, k = (m[1], int(m[2])) if m and m[1] in (*ROLES, "columns") else (name, None)
            if role not in (*ROLES, "columns"):
                raise MatchError(f"{name!r} is no option of a side; there are {', '.join((*ROLES, 'columns'))}")
            if k is not None and k > count:
                raise MatchError(f"{name!r} names side {k} of {count}")
            if (k is not None) == special:
                for own in out if k is None else [out[k - 1]]:
                    own[role] = value
    return out


def role_columns(cat: Catalogue, spec: MatchSpec | None = None) -> list[str]:
    """Columns that a match of the catalogue reads: of its roles, its covariance, and the spec's scores."""
    cat = cat.resolved()
    names = [getattr(cat, r) for r in COLUMN_ROLES] + list(cat.covariance.values())
    if spec is not None:
        names += [*spec.extra_distance_cols, *spec.prior_columns, *spec.ml_color_columns, spec.lr_magnitude_column, spec.pm_prior_magnitude_column]
        names += [x for c in spec.macauff_flux_columns for x in (c, f"{c}_err")]
    return [n for n in dict.fromkeys(names) if n in cat.df.columns]


def projected(cat: Catalogue, columns: str | Iterable[str] | None, spec: MatchSpec | None = None) -> Catalogue:
    """The catalogue with the wanted columns (a list, or text with commas) and those that matching needs."""
    if columns is None:
        return cat
    wanted = [c.strip() for c in columns.split(",")] if isinstance(columns, str) else list(columns)
    if missing := [c for c in wanted if c not in cat.df.columns]:
        raise MatchError(f"catalogue {cat.name!r} has no columns {missing}")
    return replace(cat, df=cat.df.select(*[f"`{c}`" for c in dict.fromkeys([*wanted, *role_columns(cat, spec)])]))


def region(local: Catalogue, spec: MatchSpec, explicit: tuple[float, float, float] | None = None) -> tuple[tuple[float, float], float]:
    """Centre and radius in degrees of the cone of a remote side that can hold partners of the local rows.

    Where errors or motion widen the search, no cone of the positions alone is safe and one must be given.
    """
    if explicit is not None:
        return (explicit[0], explicit[1]), min(180.0, explicit[2])
    if spec.matcher in ("skyerr", "skyellipse") or spec.target_epoch is not None:
        raise MatchError("searches by errors or at another epoch need an explicit region of the remote side")
    cat = local.resolved()
    e = sky_extent(cat.df, cat.ra, cat.dec)
    if e["radius_deg"] is None:
        raise MatchError(f"catalogue {local.name!r} has no rows to infer a region from")
    return (e["ra_deg"], e["dec_deg"]), min(180.0, e["radius_deg"] * (1 + 1e-9) + spec.radius_arcsec / 3600.0)
