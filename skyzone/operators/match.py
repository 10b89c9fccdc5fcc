"""Pairwise matching: criterion, ranking, score, filter, join type.

``match`` builds one lazy plan.  The jobs that run while it is built are one aggregation a side, for
validation and the search halo, and, for matchers that learn from the candidates, small histograms.

Rows are told apart by the catalogue's id if it declares one, which must be unique then; otherwise by
numbers that are written to the shared folder once, so that a lost executor can't change them.  Ties
go to the smaller score, the smaller separation, then the smaller right id.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..catalogue import Catalogue, bad_coordinate, bad_error, check_frames
from ..errors import MatchError
from ..functions import motion
from ..functions.geometry import separation_of, unit_vector, wrapped
from ..shared import by_measure, settled
from ..shared import stored as checkpointed
from ..specs import MatchSpec
from .zonejoin import reach_join, zone_join

log = logging.getLogger(__name__)
SUFFIX = "_2"
SEP = "sep_arcsec"
#: Search radii by default position error where a scoring matcher knows none, in arcseconds.
UNKNOWN_SIGMA = 0.5


@dataclass
class Side:
    """A catalogue ready to match: ``rows`` has all columns and ``_row``, ``slim`` what the search needs."""

    cat: Catalogue
    rows: DataFrame
    slim: DataFrame
    has_sigma: bool
    has_cov: bool
    stats: dict


def prepare(cat: Catalogue, tag: str, spec: MatchSpec, extra: tuple[str, ...] = ()) -> Side:
    """``slim`` has the columns row, ra, dec, x, y, z, sigma, ee, nn, en and ``extra``, each after ``tag``."""
    cat = cat.resolved()
    by_measure(cat.df.sparkSession)
    # read here, in the search and in the result
    rows = settled(cat.df.withColumn("_row", F.col(f"`{cat.id}`"))) if cat.id else checkpointed(cat.df.withColumn("_row", F.monotonically_increasing_id()))
    ra, dec = motion.moved(cat, spec.target_epoch)
    moving = motion.drift(cat, spec.target_epoch, spec.pm_prior_magnitude_column) if spec.pm_prior else None
    sigma, cov = motion.sigma(cat, spec.target_epoch, moving), motion.covariance(cat, spec.target_epoch, moving)
    nothing = F.lit(None).cast("double")
    ee, nn, en = cov or (nothing, nothing, nothing)
    own = {"row": F.col("_row"), "ra": ra, "dec": dec, "sigma": nothing if sigma is None else sigma, "ee": ee, "nn": nn, "en": en}
    own |= {f"x_{c}": F.col(f"`{c}`").cast("double") for c in extra}
    slim = rows.select(*[v.alias(f"{tag}_{k}") for k, v in own.items()])
    slim = slim.withColumns(dict(zip((f"{tag}_ux", f"{tag}_uy", f"{tag}_uz"), unit_vector(F.col(f"{tag}_ra"), F.col(f"{tag}_dec")))))
    checks = {"bad": F.sum(bad_coordinate(cat.column("ra"), cat.column("dec")).cast("int")), "rows": F.count("*")}
    if cat.has("ra_err", "dec_err"):
        checks["errors"] = F.sum((bad_error(cat.column("ra_err")) | bad_error(cat.column("dec_err"))).cast("int"))
        if cat.has("corr"):
            rho = cat.column("corr")
            checks["corr"] = F.sum((rho.isNull() | F.isnan(rho) | (F.abs(rho) > 1.0)).cast("int"))
    if not cat.has("ra_err", "dec_err") and (impossible := motion.bad_covariance(cat)) is not None:
        checks["covariance"] = F.sum(impossible.cast("int"))
    if sigma is not None:
        checks["sigma"] = F.max(sigma)
    if cov is not None:
        checks |= {"ee": F.max(ee), "nn": F.max(nn)}
    stats = rows.agg(*[v.alias(k) for k, v in checks.items()]).first().asDict()
    for key, what in (("bad", "coordinates that aren't finite or are out of range"), ("errors", "position errors that are null, not finite or negative"), ("corr", "correlations outside [-1, 1]"), ("covariance", "covariances that are not positive semidefinite")):
        if stats.get(key):
            raise MatchError(f"catalogue {cat.name!r} has {stats[key]} rows with {what}")
    return Side(cat, rows, slim, sigma is not None, cov is not None, stats)


def _limit(spec: MatchSpec, left: Side, right: Side) -> tuple[MatchSpec, float]:
    """The spec that errors allow, and the search halo in arcseconds."""
    known = (left.has_sigma and right.has_sigma) if spec.matcher == "skyerr" else (left.has_cov and right.has_cov)
    if spec.matcher in ("skyerr", "skyellipse") and not known:
        if spec.fallback_policy == "error" or (spec.matcher == "skyerr" and spec.target_epoch is not None):
            raise MatchError(f"matcher {spec.matcher!r} needs position errors on both sides")
        log.warning("no position errors on both sides: %s falls back to sky", spec.matcher)
        spec = replace(spec, matcher="sky")
    if spec.matcher == "skyerr":
        return spec, spec.max_error * sum(s.stats.get("sigma") or 0.0 for s in (left, right))
    if spec.matcher == "skyellipse":
        # the trace bounds the largest eigenvalue of the summed covariance
        return spec, spec.max_error * math.sqrt(sum((s.stats.get(k) or 0.0) for s in (left, right) for k in ("ee", "nn"))) * 1.001 + 1e-6
    return spec, spec.radius_arcsec


def _separation() -> Column:
    return separation_of(tuple(F.col(f"l_u{k}") for k in "xyz"), tuple(F.col(f"r_u{k}") for k in "xyz"))


def candidates(left: Side, right: Side, spec: MatchSpec, halo: float) -> DataFrame:
    """All pairs that satisfy the criterion, with ``sep_arcsec`` and ``_score`` (smaller is better)."""
    if halo <= 0:
        return zone_join(left.slim, right.slim, 1.0).where("false").withColumn(SEP, F.lit(0.0)).withColumn("_score", F.lit(0.0))
    sep = F.col(SEP)
    if spec.matcher in ("skyerr", "skyellipse"):
        # each row searches as far as its own errors let it, not as far as the largest of all
        own = lambda t: F.col(f"{t}_sigma") if spec.matcher == "skyerr" else F.sqrt(F.col(f"{t}_ee") + F.col(f"{t}_nn")) * 1.001 + 1e-6
        l, r = (s.slim.withColumn(f"{t}_reach", spec.max_error * own(t)) for t, s in (("l", left), ("r", right)))
        pairs = reach_join(l, r, min(halo, 648_000.0)).drop("l_reach", "r_reach").withColumn(SEP, _separation())
    else:
        pairs = zone_join(left.slim, right.slim, min(halo, 648_000.0) + 1e-6).withColumn(SEP, _separation())
    if spec.matcher == "skyerr":
        limit = spec.max_error * (F.col("l_sigma") + F.col("r_sigma"))
        return pairs.where(sep <= limit).withColumn("_score", F.when(limit > 0, sep / limit).otherwise(float("inf")))
    if spec.matcher == "skyellipse":
        mean = F.radians(0.5 * (F.col("l_dec") + F.col("r_dec")))
        d_ra = wrapped(F.col("l_ra") - F.col("r_ra")) * 3600.0 * F.cos(mean)
        d_dec = (F.col("l_dec") - F.col("r_dec")) * 3600.0
        d2 = motion.mahalanobis2(d_ra, d_dec, *(F.col(f"l_{k}") + F.col(f"r_{k}") for k in ("ee", "nn", "en")))
        return pairs.withColumn("_score", d2).where((F.col("_score") <= spec.max_error**2) & (F.col("_score") != float("inf")))
    return pairs.where(sep <= spec.radius_arcsec).withColumn("_score", sep)


def _ranked(pairs: DataFrame, left: Side, right: Side, spec: MatchSpec) -> DataFrame:
    """``_score`` as the distance in unit vectors and weighted z-scores of the extra columns of both sides."""
    for side in (left, right):
        for c in spec.extra_distance_cols:
            if c not in side.cat.df.columns:
                raise MatchError(f"requested extra distance column {c!r} is missing")
    names = list(spec.extra_distance_cols)
    union = left.slim.select(*[F.col(f"l_x_{c}").alias(c) for c in names]).unionByName(right.slim.select(*[F.col(f"r_x_{c}").alias(c) for c in names]))
    bad = lambda c: (F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == math.inf)).cast("int")
    row = union.agg(*[f(c).alias(f"{k}_{c}") for c in names for k, f in (("m", F.avg), ("s", F.stddev_pop), ("b", lambda c: F.sum(bad(c))))]).first()
    total = sum(((F.col(f"l_u{k}") - F.col(f"r_u{k}")) * (F.col(f"l_u{k}") - F.col(f"r_u{k}")) for k in "xyz"), F.lit(0.0))
    for c in names:
        if row[f"b_{c}"]:
            raise MatchError(f"requested extra distance column {c!r} must contain only finite values")
        d = (F.col(f"l_x_{c}") - F.col(f"r_x_{c}")) / (row[f"s_{c}"] or 1.0) * spec.extra_distance_cols[c]
        total = total + d * d
    return pairs.withColumn("_score", F.sqrt(total))


def scored(pairs: DataFrame) -> DataFrame:
    """Pairs with what scores read only."""
    return pairs.select(*[c for c in pairs.columns if c in ("l_row", "r_row", SEP, "_score", "l_sigma", "r_sigma") or c.startswith(("l_x_", "r_x_"))])


def best_per_left(pairs: DataFrame, keep: tuple[str, ...] = (SEP,)) -> DataFrame:
    """The pair of least (score, separation, right row) of every left row, by a minimum with map-side combine."""
    best = pairs.groupBy("l_row").agg(F.min(F.struct("_score", SEP, "r_row", *[c for c in keep if c not in (SEP,)])).alias("b"))
    return best.select("l_row", F.col("b.r_row").alias("r_row"), "b._score", *[F.col(f"b.{c}").alias(c) for c in keep])


def names_right(left: list[str], right: list[str], suffix: str = SUFFIX) -> dict[str, str]:
    """New names of right columns that the left has too; the suffix repeats until a name is free."""
    taken, out = {*left, *right}, {}
    for c in right:
        if c in left:
            new = c + suffix
            while new in taken:
                new += suffix
            taken.add(new)
            out[c] = new
    return out


def assemble(pairs: DataFrame, left: DataFrame, right: DataFrame, join_type: str, extra: tuple[str, ...] = (), suffix: str = SUFFIX) -> DataFrame:
    """Rows of both sides for pairs (l_row, r_row, sep_arcsec, extra); both sides carry ``_row``."""
    left_cols, right_cols = [c for c in left.columns if c != "_row"], [c for c in right.columns if c != "_row"]
    new = names_right(left_cols, right_cols, suffix)
    own = left.withColumnRenamed("_row", "l_row")
    other = right.select(F.col("_row").alias("r_row"), *[F.col(f"`{c}`").alias(new.get(c, c)) for c in right_cols])
    named = [new.get(c, c) for c in right_cols]
    if join_type == "1not2":
        return own.join(pairs.select("l_row"), "l_row", "left_anti").select(*[f"`{c}`" for c in left_cols])
    if join_type == "2not1":
        return other.join(pairs.select("r_row"), "r_row", "left_anti").select(*[f"`{c}`" for c in named])
    kept = [c for c in left_cols if c not in (SEP, *extra)]
    # rows that stay unmatched keep the separation of an earlier step
    sep = F.when(F.col("_r").isNotNull(), F.col("_sep")).otherwise(F.col(SEP)) if SEP in left_cols else F.col("_sep")
    how_left = "left" if join_type in ("all1", "1or2", "all") else "inner"
    how_right = {"1and2": "inner", "all1": "left", "all2": "right", "1or2": "full", "all": "full"}[join_type]
    links = pairs.select("l_row", F.col("r_row").alias("_r"), F.col(SEP).alias("_sep"), *[F.col(c).alias(f"_x_{c}") for c in extra])
    out = own.join(links, "l_row", how_left)
    # rows without a partner are dealt by themselves: all of them would go to the task of the null key
    out = out.withColumn("_apart", F.when(F.col("_r").isNull(), 1 + F.pmod(F.xxhash64("l_row"), F.lit(1 << 20))).otherwise(F.lit(0)))
    other = other.withColumn("_with", F.pmod(F.xxhash64("r_row"), F.lit(1)))
    out = out.join(other, (out["_r"] == other["r_row"]) & (out["_apart"] == other["_with"]), how_right)
    return out.select(*[f"`{c}`" for c in kept], *[f"`{c}`" for c in named], sep.alias(SEP), *[F.col(f"_x_{c}").alias(c) for c in extra])


def filtered(pairs: DataFrame, left: DataFrame, right: DataFrame, expression: str, suffix: str = SUFFIX) -> DataFrame:
    """Pairs whose joined row satisfies a Spark SQL expression; a best match that fails isn't replaced."""
    both = assemble(pairs.withColumn("_l", F.col("l_row")).withColumn("_rr", F.col("r_row")), left, right, "1and2", ("_l", "_rr"), suffix)
    try:
        good = both.where(F.expr(expression)).select("_l", "_rr")
    except AnalysisException as e:
        raise MatchError(f"bad filter expression {expression!r}: {e}") from e
    return pairs.join(good, (pairs.l_row == good["_l"]) & (pairs.r_row == good["_rr"]), "left_semi")


def match(left: Catalogue, right: Catalogue, spec: MatchSpec, suffix: str = SUFFIX) -> DataFrame:
    from . import scores

    check_frames([left, right], spec.target_epoch)
    extra = tuple(dict.fromkeys((*spec.extra_distance_cols, *scores.columns_of(spec, left, right))))
    l_extra = tuple(c for c in extra if c in left.df.columns)
    r_extra = tuple(c for c in extra if c in right.df.columns)
    a, b = prepare(left, "l", spec, l_extra), prepare(right, "r", spec, r_extra)
    spec, halo = _limit(spec, a, b)
    pairs = candidates(a, b, spec, halo)
    added: tuple[str, ...] = ()
    if spec.extra_distance_cols and spec.find == "best":
        pairs = _ranked(pairs, a, b, spec)
    if spec.matcher in scores.SCORERS or spec.probabilistic or spec.prior_columns:
        pairs = scored(pairs)
    if spec.matcher in scores.SCORERS:
        if spec.extra_distance_cols and spec.find == "best":
            pairs = best_per_left(pairs, tuple(c for c in pairs.columns if c not in ("l_row", "r_row", "_score")))
        pairs, added = scores.SCORERS[spec.matcher](pairs, a, b, spec)
    if spec.probabilistic or spec.prior_columns:
        pairs, added = scores.p_match(pairs, a, b, spec), (*added, "p_match")
    if spec.find == "best":
        pairs = best_per_left(pairs, (SEP, *added))
    if spec.filter_expr:
        pairs = filtered(pairs, a.rows, b.rows, spec.filter_expr, suffix)
    return assemble(pairs, a.rows, b.rows, spec.join_type, added, suffix)


def id_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, join_type: str = "1and2", suffix: str = SUFFIX) -> DataFrame:
    """Join on ids, many to many.  A full join keeps both keys; the others keep the left's (``2not1``: the right's)."""
    if join_type == "2not1":
        return right.join(left.select(F.col(f"`{left_id}`").alias(right_id)), right_id, "left_anti").select(right.columns)
    if join_type == "1not2":
        return left.join(right.select(F.col(f"`{right_id}`").alias(left_id)), left_id, "left_anti").select(left.columns)
    new = names_right(left.columns, right.columns, suffix)
    key = "_key"
    other = right.select(F.col(f"`{right_id}`").alias(key), *[F.col(f"`{c}`").alias(new.get(c, c)) for c in right.columns])
    how = {"1and2": "inner", "all1": "left", "all2": "right", "1or2": "full", "all": "full"}[join_type]
    out = left.join(other, left[left_id] == other[key], how)
    named = [new.get(c, c) for c in right.columns]
    if how == "full":
        return out.select(*[f"`{c}`" for c in left.columns], *[f"`{c}`" for c in named])
    own = [F.coalesce(left[left_id], other[key]).alias(c) if c == left_id else left[c] for c in left.columns]
    return out.select(*own, *[f"`{c}`" for c in named if c != new.get(right_id, right_id)])
