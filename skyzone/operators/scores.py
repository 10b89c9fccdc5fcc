"""Scores of candidate pairs.

Scorers take pairs (l_row, r_row, sep_arcsec, l_*, r_*) and give them their columns and ``_score``,
by which the best pair of a left row is least.  What they learn from the candidates is small: at most
100 histogram bins, extremes, a bounded sample, or a model.  Candidates are written once, as they
are read again after that.
"""

from __future__ import annotations

import logging
import math
import os

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import MatchError
from ..functions.geometry import sky_extent
from ..specs import MatchSpec
from .match import SEP, UNKNOWN_SIGMA, Side, checkpointed
from .zonejoin import zone_join

log = logging.getLogger(__name__)
TINY = 1e-300
SAMPLE = 50_000
RANDOM_PAIRS = 5000
GRID = 2048
#: Rows that a task trains with on the average, and the least number of parts they lie in.
TRAIN_ROWS, LEAST_PARTS = 100_000, 16


def columns_of(spec: MatchSpec, left, right) -> tuple[str, ...]:
    """Numeric columns that the search must carry for the spec's scores."""
    out = [*spec.prior_columns]
    if spec.matcher == "lr" and spec.lr_magnitude_column:
        out.append(spec.lr_magnitude_column)
    if spec.matcher in ("ml", "xgb"):
        out += spec.ml_color_columns
    if spec.matcher == "macauff":
        out += [x for c in spec.macauff_flux_columns for x in (c, f"{c}_err")]
    return tuple(dict.fromkeys(out))


def _literals(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _sigma(prefix: str) -> Column:
    return F.coalesce(F.col(f"{prefix}_sigma"), F.lit(UNKNOWN_SIGMA))


def combined_sigma() -> Column:
    return F.greatest(F.sqrt(_sigma("l") * _sigma("l") + _sigma("r") * _sigma("r")), F.lit(1e-6))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != math.inf)


def _area_arcsec2(side: Side) -> float:
    radius = sky_extent(side.slim, side.slim.columns[1], side.slim.columns[2])["radius_deg"]
    return (math.pi * radius**2 if radius else 1.0) * 3600.0**2


def _lerp(at: Column, values) -> Column:
    """Linear interpolation of ``values`` at a place counted in their steps, clamped to the ends."""
    table, last = _literals(values), len(values) - 1
    at = F.least(F.greatest(at, F.lit(0.0)), F.lit(float(last)))
    k = F.least(F.floor(at), F.lit(max(last - 1, 0))).cast("int")
    return F.get(table, k) + (at - k) * (F.get(table, F.least(k + 1, F.lit(last))) - F.get(table, k))


# ---- likelihood ratio ----


def likelihood_ratio(pairs: DataFrame, left: Side, right: Side, spec: MatchSpec) -> tuple[DataFrame, tuple[str, ...]]:
    """Ratio of counterparts to background by magnitude and separation, and each pair's reliability.

    The best pair has the highest reliability, then the lowest ratio, then the least separation.
    """
    name = spec.lr_magnitude_column
    even = pairs.withColumn("lr", F.lit(1.0)).withColumn("reliability", F.lit(1.0)).withColumn("_score", F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")))
    if not name or f"r_x_{name}" not in right.slim.columns:
        log.warning("no magnitude column %r on the right: likelihood ratios are 1", name)
        return even, ("lr", "reliability")
    m = F.col(f"r_x_{name}")
    known = right.slim.where(_finite(m))
    stats = known.agg(F.count("*").alias("n"), F.min(m).alias("lo"), F.max(m).alias("hi")).first()
    if stats.n < 10:
        log.warning("too few magnitudes for likelihood ratios: they are 1")
        return even, ("lr", "reliability")
    bins = min(50, int(math.sqrt(stats.n)))
    hi = stats.hi if stats.hi - stats.lo >= 1e-6 else stats.lo + 1.0
    width = (hi - stats.lo) / bins
    place = F.when(_finite(m), F.least(F.greatest(F.floor((m - stats.lo) / width), F.lit(0)), F.lit(bins - 1))).otherwise(0).cast("int")

    def histogram(df: DataFrame) -> np.ndarray:
        out = np.zeros(bins)
        for r in df.where(_finite(m)).groupBy(place.alias("k")).count().collect():  # 50 rows at most
            out[r.k] = r["count"]
        return out

    pairs = checkpointed(pairs)
    density = np.maximum(histogram(right.slim) / (_area_arcsec2(right) * width), TINY)
    q = np.maximum(histogram(pairs) - density * math.pi * spec.radius_arcsec**2 * left.stats["rows"], 0.0)
    q = q / q.sum() if q.sum() > 0 else np.ones(bins) / bins
    s2 = combined_sigma() * combined_sigma()
    f = F.greatest(F.col(SEP) / s2 * F.exp(-(F.col(SEP) * F.col(SEP)) / (2.0 * s2)), F.lit(TINY))
    ratio = F.get(_literals(q), place) * f / F.get(_literals(density), place)
    pairs = pairs.withColumn("lr", F.when(_finite(ratio), F.greatest(ratio, F.lit(0.0))).otherwise(0.0))
    total = F.sum("lr").over(Window.partitionBy("l_row")) + (1.0 - spec.lr_q)
    pairs = pairs.withColumn("reliability", F.when(total > TINY, F.least(F.lit(1.0), F.col("lr") / total)).otherwise(0.0))
    return pairs.withColumn("_score", F.struct((-F.col("reliability")).alias("a"), F.col("lr").alias("b"))), ("lr", "reliability")


# ---- empirical separations ----


def _nearest(pairs: DataFrame, name: str) -> tuple[DataFrame, tuple[str, ...]]:
    return pairs.withColumn(name, 1.0 / (1.0 + F.col(SEP))).withColumn("_score", F.col(SEP)), (name,)


def _auf(pairs: DataFrame, left: Side, right: Side, spec: MatchSpec) -> Column | None:
    """Probability from the histogram of separations less what unrelated rows give."""
    sep = F.col(SEP)
    stats = pairs.agg(F.count("*").alias("n"), F.min(F.when(sep > 0, sep)).alias("lo"), F.max(sep).alias("hi")).first()
    if not stats.n:
        return None
    background = right.stats["rows"] / max(_area_arcsec2(right), 1.0)
    bins = min(100, max(20, int(math.sqrt(stats.n))))
    lo, hi = max(stats.lo or 1e-6, 1e-6), max(stats.hi, spec.radius_arcsec)
    hi = hi if hi - lo >= 1e-6 else lo + spec.radius_arcsec
    step = (math.log10(hi) - math.log10(lo)) / bins
    edges = np.logspace(math.log10(lo), math.log10(hi), bins + 1)
    widths, centres = np.diff(edges), np.sqrt(edges[:-1] * edges[1:])
    place = F.least(F.floor((F.log10(sep) - math.log10(lo)) / step), F.lit(bins - 1)).cast("int")
    found = np.zeros(bins)
    for r in pairs.where((sep >= lo) & (sep <= hi)).groupBy(place.alias("k")).count().collect():  # 100 rows at most
        found[max(r.k, 0)] += r["count"]
    f = np.maximum(found - background * 2.0 * math.pi * centres * widths * left.stats["rows"], 0.0)
    if not f.sum() > 0:
        return None
    density = np.log(np.maximum(f / f.sum() / np.maximum(widths, TINY), TINY))
    at = (F.log(F.greatest(sep, F.lit(lo * 0.5))) - math.log(centres[0])) / (step * math.log(10.0))
    ring = F.exp(_lerp(at, density)) / F.greatest(2.0 * math.pi * sep, F.lit(1e-6))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), ring / (ring + background)))


def empirical_separation(pairs: DataFrame, left: Side, right: Side, spec: MatchSpec) -> tuple[DataFrame, tuple[str, ...]]:
    pairs = checkpointed(pairs)
    p = _auf(pairs, left, right, spec)
    if p is None:
        log.warning("no signal above the background: nearest neighbours")
        return _nearest(pairs, "auf_prob")
    return pairs.withColumn("auf_prob", p).withColumn("_score", -F.col("auf_prob")), ("auf_prob",)


def separation_and_flux(pairs: DataFrame, left: Side, right: Side, spec: MatchSpec) -> tuple[DataFrame, tuple[str, ...]]:
    """Odds from separations times the ratios that magnitude differences have among matches and at random."""
    pairs = checkpointed(pairs)
    p = _auf(pairs, left, right, spec)
    if p is None:
        log.warning("no signal above the background: nearest neighbours")
        return _nearest(pairs, "macauff_prob")
    odds = p / F.greatest(1.0 - p, F.lit(1e-10))
    used = 0
    for c in spec.macauff_flux_columns:
        if not all(f"{t}_x_{c}" in s.slim.columns for t, s in (("l", left), ("r", right))):
            continue
        used += 1
        value = lambda t: F.coalesce(F.nanvl(F.col(f"{t}_x_{c}"), F.lit(0.0)), F.lit(0.0))  # noqa: B023,E731
        dm = F.abs(value("l") - value("r"))
        sigma = F.lit(0.1)
        if all(f"{t}_x_{c}_err" in s.slim.columns for t, s in (("l", left), ("r", right))):
            e = [F.coalesce(F.nanvl(F.col(f"{t}_x_{c}_err"), F.lit(0.1)), F.lit(0.1)) for t in "lr"]
            sigma = F.greatest(F.sqrt(e[0] * e[0] + e[1] * e[1]), F.lit(1e-4))
        same = F.greatest(F.exp(-0.5 * (dm / sigma) * (dm / sigma)) / (sigma * math.sqrt(2.0 * math.pi)), F.lit(TINY))
        # the rows of a bounded sample, in the order of their digests, are partners at random
        draws = [np.asarray([r[0] for r in s.slim.select(value(t), F.md5(F.concat(F.col(f"{t}_row").cast("string"), F.lit(t))).alias("h")).orderBy("h").limit(RANDOM_PAIRS).collect()]) for t, s in (("l", left), ("r", right))]
        n = min(map(len, draws))
        random = np.abs(draws[0][:n] - draws[1][:n])
        most = max(float(random.max()), 1e-6)
        bins = min(100, max(20, int(math.sqrt(n))))
        width = most / bins
        density = np.maximum(np.histogram(random, bins=bins, range=(0, most))[0] / (n * width), TINY)
        other = F.when(dm > most - width / 2, F.lit(TINY)).otherwise(F.greatest(_lerp(dm / width - 0.5, density), F.lit(TINY)))
        odds = odds * F.least(F.lit(1e10), F.greatest(F.lit(1e-10), same / other))
    out = p if not used else F.least(F.lit(1.0), F.greatest(F.lit(0.0), odds / (1.0 + odds)))
    return pairs.withColumn("macauff_prob", out).withColumn("_score", -F.col("macauff_prob")), ("macauff_prob",)


# ---- learnt scores ----


def features(pairs: DataFrame, left: Side, right: Side, spec: MatchSpec) -> tuple[DataFrame, list[str]]:
    """x_0 separation in sigmas, x_1.. scaled colour differences, x_n log density of left neighbours; y 1 for the nearest."""
    names = [c for c in spec.ml_color_columns if f"l_x_{c}" in left.slim.columns and f"r_x_{c}" in right.slim.columns]
    if not names:
        return pairs, []
    out = pairs.withColumn("x_0", F.col(SEP) / combined_sigma())
    diff = {f"x_{k + 1}": F.abs(F.col(f"l_x_{c}") - F.col(f"r_x_{c}")) for k, c in enumerate(names)}
    row = out.agg(*[F.stddev_pop(F.when(~F.isnan(d), d)).alias(k) for k, d in diff.items()]).first()
    for k, d in diff.items():
        scaled = d / (row[k] if row[k] and math.isfinite(row[k]) else 1.0)
        out = out.withColumn(k, F.when(scaled.isNull() | F.isnan(scaled), 0.0).otherwise(scaled))
    # neighbours within twice the radius, each row its own neighbour
    twice = 2.0 * spec.radius_arcsec
    other = left.slim.select(*[F.col(c).alias("r" + c[1:]) for c in left.slim.columns])
    from .match import _separation

    near = zone_join(left.slim, other, twice + 1e-6).where(_separation() <= twice).groupBy("l_row").agg(F.count("*").alias("near"))
    last = f"x_{len(names) + 1}"
    out = out.join(near, "l_row", "left").withColumn(last, F.log1p(F.greatest(F.coalesce("near", F.lit(1)), F.lit(1)) / max(math.pi * twice**2, 1.0))).drop("near")
    first = F.row_number().over(Window.partitionBy("l_row").orderBy("x_0", "r_row"))
    return out.withColumn("y", (first == 1).cast("double")), ["x_0", *diff, last]


def heuristic(pairs: DataFrame, names: list[str]) -> Column:
    """1 / (1 + 2 x_0 + the other features)."""
    return 1.0 / (1.0 + 2.0 * F.col("x_0") + sum((F.col(c) for c in names[1:]), F.lit(0.0)))


def _learnt(kind: str, column: str, path_of):
    def score(pairs: DataFrame, left: Side, right: Side, spec: MatchSpec) -> tuple[DataFrame, tuple[str, ...]]:
        pairs, names = features(checkpointed(pairs), left, right, spec)
        if not names:
            log.warning("matcher %r has no colour columns on both sides: nearest neighbours", spec.matcher)
            return _nearest(pairs, column)
        pairs = checkpointed(pairs)
        positive = pairs.where("y = 1").limit(2).count()
        if positive < 2:
            return _nearest(pairs, column)
        try:
            from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
            from pyspark.ml.feature import VectorAssembler
            from pyspark.ml.functions import vector_to_array
        except ImportError:
            return pairs.withColumn(column, heuristic(pairs, names)).withColumn("_score", -F.col(column)), (column,)
        ready = VectorAssembler(inputCols=names, outputCol="_features").transform(pairs)
        path = path_of(spec)
        if path and os.path.isdir(path):
            model = (RandomForestClassificationModel if kind == "forest" else GBTClassificationModel).load(path)
        else:
            rows = pairs.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
            negatives = far_pairs(left, right, spec, names, min(1000, rows.n))
            weighed = pairs.select("y", *names).unionByName(negatives)
            n0 = max(1.0, rows.n - rows.p + negatives.count())
            weighed = weighed.withColumn("w", F.when(F.col("y") == 1, (n0 + rows.p) / (2 * rows.p)).otherwise((n0 + rows.p) / (2 * n0)))
            # in one order however rows were dealt, since trees draw their rows by place
            # trees hold a hundred counts a row, so a task takes a bounded number of rows
            ordered = weighed.repartition(max(LEAST_PARTS, -(-rows.n // TRAIN_ROWS)), *names).sortWithinPartitions("y", *names)
            data = VectorAssembler(inputCols=names, outputCol="_features").transform(ordered)
            shape = {"maxDepth": min(5, max(2, int(math.log2(len(names) + 1)))), "seed": 42, "labelCol": "y", "featuresCol": "_features", "weightCol": "w"}
            model = (RandomForestClassifier(numTrees=min(100, max(10, rows.n // 5)), **shape) if kind == "forest" else GBTClassifier(maxIter=20, **shape)).fit(data)
            # a copy has no training summary, which holds the session: that can't be sent to tasks once anything was observed in it
            model = model.copy()
            if path:
                model.write().overwrite().save(path)
        out = model.transform(ready).withColumn(column, vector_to_array("probability")[1])
        return out.drop("_features", "rawPrediction", "probability", "prediction").withColumn("_score", -F.col(column)), (column,)

    return score


def far_pairs(left: Side, right: Side, spec: MatchSpec, names: list[str], n: int) -> DataFrame:
    """At most ``n`` pairs of rows drawn by hash that lie over ten radii apart, as negative examples."""
    draw = lambda s, t: s.slim.orderBy(F.xxhash64(f"{t}_row", F.lit("far")), f"{t}_row").limit(n).withColumn("_k", F.monotonically_increasing_id())
    from .match import _separation

    number = lambda df: df.withColumn("_k", F.row_number().over(Window.orderBy("_k")))  # noqa: E731  n rows at most
    both = number(draw(left, "l")).join(number(draw(right, "r")), "_k").withColumn(SEP, _separation()).where(F.col(SEP) > 10.0 * spec.radius_arcsec)
    columns = [c for c in spec.ml_color_columns if f"l_x_{c}" in left.slim.columns and f"r_x_{c}" in right.slim.columns]
    diff = {f"x_{k + 1}": F.abs(F.col(f"l_x_{c}") - F.col(f"r_x_{c}")) for k, c in enumerate(columns)}
    row = both.agg(*[F.stddev_pop(d).alias(k) for k, d in diff.items()]).first()
    out = {"x_0": F.col(SEP) / combined_sigma(), **{k: F.coalesce(d / (row[k] or 1.0), F.lit(0.0)) for k, d in diff.items()}}
    density = math.log1p(1.0 / max(math.pi * (2.0 * spec.radius_arcsec) ** 2, 1.0))
    return both.select(F.lit(0.0).alias("y"), *[v.alias(k) for k, v in out.items()], F.lit(density).alias(names[-1]))


# ---- match probability ----


def kde_points(values: DataFrame, cap: int = SAMPLE) -> tuple[float, float, np.ndarray] | None:
    """Log density of a Gaussian kernel estimate (Scott's width) on an even grid over the values' range.

    ``values`` has columns v and key, a name of the row; the values of a bounded sample, those whose
    keys' digests are lowest however rows are dealt, are collected.  None where there are fewer than two
    different values.
    """
    v = F.col("v")
    own = values.where(_finite(v))
    x = np.sort(np.asarray([r[0] for r in own.orderBy(F.md5("key"), "v").limit(cap).select("v").collect()], dtype=float))
    if len(x) < 2 or x[0] == x[-1]:
        return None
    extremes = own.agg(F.min(v), F.max(v)).first()
    h = len(x) ** -0.2 * x.std(ddof=1)
    grid = np.linspace(extremes[0], extremes[1], GRID)
    out = np.empty(GRID)
    for k in range(0, GRID, 64):
        z = -0.5 * ((grid[k : k + 64, None] - x[None, :]) / h) ** 2
        top = z.max(1)
        out[k : k + 64] = top + np.log(np.exp(z - top[:, None]).sum(1))
    return float(grid[0]), float(grid[1] - grid[0]), out - math.log(len(x) * h * math.sqrt(2.0 * math.pi))


def keyed(slim: DataFrame, tag: str, column: str, name: str | None = None) -> DataFrame:
    """A prepared side's values of a column, each with a name of its row."""
    return slim.select(F.col(f"{tag}_x_{column}").alias("v"), F.concat(F.lit(name or tag), F.col(f"{tag}_row").cast("string")).alias("key"))


def kde_log(points: tuple[float, float, np.ndarray] | None, at: Column) -> Column:
    return F.lit(0.0) if points is None else _lerp((at - points[0]) / points[1], points[2])


def p_match(pairs: DataFrame, left: Side, right: Side, spec: MatchSpec) -> DataFrame:
    """Posterior of a match under a two-dimensional Gaussian against a uniform disc of the search radius."""
    for s in (left, right):
        if not s.has_sigma:
            raise MatchError(f"p_match needs position errors or a default error for catalogue {s.cat.name!r}")
    per_axis2 = 0.5 * (F.col("l_sigma") * F.col("l_sigma") + F.col("r_sigma") * F.col("r_sigma"))
    sigma = F.greatest(F.sqrt(per_axis2), F.lit(1e-6))
    z = F.col(SEP) / sigma
    log_match = -0.5 * z * z - math.log(2.0 * math.pi) - 2.0 * F.log(sigma)
    log_other = F.lit(-math.log(math.pi * max(spec.radius_arcsec, 1e-6) ** 2))
    for c in spec.prior_columns:
        if not all(f"{t}_x_{c}" in s.slim.columns for t, s in (("l", left), ("r", right))):
            log.warning("prior column %r is missing on a side and skipped", c)
            continue
        own, other = F.col(f"l_x_{c}"), F.col(f"r_x_{c}")
        points = kde_points(keyed(left.slim, "l", c).unionByName(keyed(right.slim, "r", c)))
        log_match = log_match + kde_log(points, 0.5 * (own + other))
        log_other = log_other + kde_log(points, own) + kde_log(points, other)
    return pairs.withColumn("p_match", 1.0 / (1.0 + F.exp(log_other - log_match)))


def bayes_factor(us: list[tuple[Column, Column, Column]], sigmas: list[Column]) -> Column:
    """log10 of the N-way spatial Bayes factor of unit vectors with per-axis errors in arcseconds."""
    rad = math.radians(1.0 / 3600.0)
    w = [1.0 / (s * s * rad * rad) for s in sigmas]
    total = sum(w[1:], w[0])
    out = F.lit((len(us) - 1) * math.log(2.0)) + sum((F.log(x) for x in w[1:]), F.log(w[0])) - F.log(total)
    for i in range(len(us)):
        for j in range(i + 1, len(us)):
            chord2 = sum((a - b) * (a - b) for a, b in zip(us[i], us[j]))
            psi = 2.0 * F.asin(F.least(F.lit(1.0), F.sqrt(chord2) / 2.0))
            out = out - w[i] * w[j] / total * psi * psi / 2.0
    return out / math.log(10.0)


SCORERS = {
    "lr": likelihood_ratio,
    "auf": empirical_separation,
    "macauff": separation_and_flux,
    "ml": _learnt("forest", "ml_score", lambda s: s.ml_model_path),
    "xgb": _learnt("boosted", "xgb_score", lambda s: s.xgb_model_path),
}
