"""What to match and how, checked when it is made."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

MATCHERS = ("sky", "skyerr", "skyellipse", "lr", "ml", "xgb", "auf", "macauff")
JOIN_TYPES = ("1and2", "all1", "all2", "1or2", "all", "1not2", "2not1")
FINDS = ("best", "all")
ENGINES = ("auto", "fast", "zone", "ray", "astropy", "stilts", "torch")


@dataclass(frozen=True)
class MatchSpec:
    radius_arcsec: float = 1.0
    matcher: str = "sky"
    find: str = "best"
    join_type: str = "1and2"
    max_error: float = 3.0
    filter_expr: str | None = None
    extra_distance_cols: dict[str, float] = field(default_factory=dict)
    probabilistic: bool = False
    prior_columns: tuple[str, ...] = ()
    lr_magnitude_column: str | None = None
    lr_q: float = 0.8
    ml_color_columns: tuple[str, ...] = ()
    ml_model_path: str | None = None
    xgb_model_path: str | None = None
    macauff_flux_columns: tuple[str, ...] = ()
    target_epoch: float | None = None
    pm_prior: bool = False
    pm_prior_magnitude_column: str | None = None
    fallback_policy: str = "warn"
    engine: str = "auto"
    batch_size: int | None = None

    def __post_init__(self) -> None:
        def need(ok: bool, message: str) -> None:
            if not ok:
                raise ValueError(message)

        for name in ("radius_arcsec", "max_error", "lr_q"):
            value = getattr(self, name)
            need(isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value), f"{name} must be a finite number")
        need(0.0 < self.radius_arcsec <= 648_000.0, "radius_arcsec must be in (0, 648000]")
        need(self.max_error > 0.0, "max_error must be positive")
        need(0.0 <= self.lr_q <= 1.0, "lr_q must be in [0, 1]")
        need(self.target_epoch is None or math.isfinite(self.target_epoch), "target_epoch must be finite")
        need(self.batch_size is None or (type(self.batch_size) is int and self.batch_size > 0), "batch_size must be a positive integer")
        need(all(isinstance(k, str) and k and math.isfinite(w) and w >= 0 for k, w in self.extra_distance_cols.items()), "extra_distance_cols must map names to finite weights that aren't negative")
        need(self.fallback_policy in ("warn", "error"), "fallback_policy must be 'warn' or 'error'")
        for name, known in (("matcher", MATCHERS), ("join_type", JOIN_TYPES), ("find", FINDS), ("engine", ENGINES)):
            need(getattr(self, name) in known, f"{name} must be one of {sorted(known)}, got {getattr(self, name)!r}")
        need(isinstance(self.probabilistic, bool), "probabilistic must be a boolean")
