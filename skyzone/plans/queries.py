"""Queries over the driver tables, by name, and the SQL each is held against.

Results are narrowed to ids and rounded numbers, since the last digits of sines differ by engine.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..functions import geometry as g
from ..functions.identity import digest
from ..operators import associations, candidates, multi, observations
from ..operators.match import id_join, match
from ..sources import tiles
from ..specs import MatchSpec
from .catalogues import banded, catalogue, cte, frame, sep
from .registry import query

def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def pair(spark: SparkSession, d: str, spec: MatchSpec, l: str = "cat_a", r: str = "cat_b", columns=("id", "ra", "dec", "mag"), **roles) -> DataFrame:
    return match(catalogue(spark, d, l, list(columns), **roles), catalogue(spark, d, r, list(columns), **roles), spec)


# ---- geometry ----

_GALACTIC = "degrees(asin(greatest(-1e0, least(1e0, sin(radians(dec))*sin(radians(2.712825e1))+cos(radians(dec))*cos(radians(2.712825e1))*cos(radians(ra)-radians(1.9285948e2))))))"


@query("galactic_latitude", f"WITH {cte('cat_a')} SELECT id, round({_GALACTIC}, 6) AS b FROM cat_a")
def galactic_latitude(spark, d):
    return frame(spark, d, "cat_a").select("id", F.round(g.galactic_latitude(F.col("ra"), F.col("dec")), 6).alias("b"))


@query("sep_identity", f"WITH {cte('cat_a')}, o AS (SELECT id, 1e1 AS ra, 2e1 AS dec, ra AS r, dec AS d FROM cat_a) SELECT l.id, round({sep('l', 'r')}, 6) AS sep_arcsec FROM cat_a l JOIN o r ON l.id = r.id")
def sep_identity(spark, d):
    a = frame(spark, d, "cat_a")
    return a.select("id", F.round(g.separation(F.col("ra"), F.col("dec"), F.lit(10.0), F.lit(20.0)), 6).alias("sep_arcsec"))


@query(
    "sky_extent",
    f"""WITH {cte('cat_a')}, v AS (SELECT cos(radians(dec))*cos(radians(ra)) AS x, cos(radians(dec))*sin(radians(ra)) AS y, sin(radians(dec)) AS z FROM cat_a),
    m AS (SELECT avg(x) AS x, avg(y) AS y, avg(z) AS z FROM v), c AS (SELECT x/sqrt(x*x+y*y+z*z) AS x, y/sqrt(x*x+y*y+z*z) AS y, z/sqrt(x*x+y*y+z*z) AS z FROM m)
    SELECT round(max(degrees(asin(c.z))), 4) AS dec_deg, round(degrees(acos(min(v.x*c.x+v.y*c.y+v.z*c.z))), 4) AS radius_deg FROM v, c""",
)
def sky_extent(spark, d):
    e = g.sky_extent(frame(spark, d, "cat_a"), "ra", "dec")
    return spark.createDataFrame([(round(e["dec_deg"], 4), round(e["radius_deg"], 4))], "dec_deg double, radius_deg double")


_HAVERSINE = "degrees(2e0*asin(sqrt(least(1e0, pow(sin(radians(dec-2e1)/2e0), 2)+cos(radians(dec))*cos(radians(2e1))*pow(sin(radians(ra-1e1)/2e0), 2)))))"


@query("cone_filter", f"WITH {cte('cat_a')} SELECT id, round(ra, 6) AS ra, round(dec, 6) AS dec FROM cat_a WHERE {_HAVERSINE} <= 1.5e1")
def cone_filter(spark, d):
    return rounded(g.cone(frame(spark, d, "cat_a").select("id", "ra", "dec"), "ra", "dec", (10.0, 20.0), 15.0), "ra", "dec")


# ---- fixed radius ----

_ALL = f"WITH {cte('cat_a', 'cat_b')}, {banded('cat_a', 'cat_b', 'sep <= 2e0')}"
_BEST = _ALL + ", best AS (SELECT l_id, arg_min(r_id, sep) AS r_id, min(sep) AS sep FROM pairs GROUP BY l_id)"
SKY = MatchSpec(radius_arcsec=2.0)


def _ids(df: DataFrame, *extra: str) -> DataFrame:
    return rounded(df, "sep_arcsec").select("id", F.col("id_2"), "sep_arcsec", *extra)


@query("sky_best_inner", _BEST + " SELECT l_id AS id, r_id AS id_2, round(sep, 6) AS sep_arcsec FROM best")
def sky_best_inner(spark, d):
    return _ids(pair(spark, d, SKY))


@query("sky_all_inner", _ALL + " SELECT l_id AS id, r_id AS id_2, round(sep, 6) AS sep_arcsec FROM pairs")
def sky_all_inner(spark, d):
    return _ids(pair(spark, d, MatchSpec(radius_arcsec=2.0, find="all")))


def _joined(name: str, join_type: str, oracle: str) -> None:
    @query(name, oracle)
    def run(spark, d):
        return _ids(pair(spark, d, MatchSpec(radius_arcsec=1.5, find="all", join_type=join_type)))


_SOME = f"WITH {cte('cat_a', 'cat_b')}, {banded('cat_a', 'cat_b', 'sep <= 1.5e0')} SELECT"
_joined("sky_left", "all1", _SOME + " a.id, p.r_id AS id_2, round(p.sep, 6) AS sep_arcsec FROM cat_a a LEFT JOIN pairs p ON a.id = p.l_id")
_joined("sky_right", "all2", _SOME + " p.l_id AS id, b.id AS id_2, round(p.sep, 6) AS sep_arcsec FROM cat_b b LEFT JOIN pairs p ON b.id = p.r_id")
_joined("sky_full", "1or2", _SOME + " a.id, b.id AS id_2, round(p.sep, 6) AS sep_arcsec FROM cat_a a LEFT JOIN pairs p ON a.id = p.l_id FULL JOIN cat_b b ON b.id = p.r_id")


@query("sky_anti_left", _SOME + " a.id, round(a.mag, 6) AS mag FROM cat_a a WHERE a.id NOT IN (SELECT l_id FROM pairs)")
def sky_anti_left(spark, d):
    return rounded(pair(spark, d, MatchSpec(radius_arcsec=1.5, join_type="1not2", find="all")).select("id", "mag"), "mag")


@query("sky_anti_right", _SOME + " b.id AS id_2, round(b.mag, 6) AS mag_2 FROM cat_b b WHERE b.id NOT IN (SELECT r_id FROM pairs)")
def sky_anti_right(spark, d):
    return rounded(pair(spark, d, MatchSpec(radius_arcsec=1.5, join_type="2not1", find="all")).select("id_2", "mag_2"), "mag_2")


@query("post_filter", _BEST + " SELECT l_id AS id, r_id AS id_2, round(sep, 6) AS sep_arcsec FROM best JOIN cat_a a ON a.id = l_id JOIN cat_b b ON b.id = r_id WHERE abs(a.mag - b.mag) < 3e0")
def post_filter(spark, d):
    return _ids(pair(spark, d, MatchSpec(radius_arcsec=2.0, filter_expr="abs(mag - mag_2) < 3e0")))


@query("sky_seam_poles", f"WITH {cte('cat_d')}, pairs AS (SELECT l.id AS l_id, r.id AS r_id, {sep('l', 'r')} AS sep FROM cat_d l JOIN cat_d r ON floor((l.dec+9e1)/1e0) BETWEEN floor((r.dec+9e1)/1e0)-1 AND floor((r.dec+9e1)/1e0)+1 AND l.id <> r.id) SELECT l_id AS id, r_id AS id_2, round(sep, 4) AS sep_arcsec FROM pairs WHERE sep <= 1.2345678e2")
def sky_seam_poles(spark, d):
    c = catalogue(spark, d, "cat_d")
    out = match(c, c, MatchSpec(radius_arcsec=123.45678, find="all"))
    return rounded(out.where("id <> id_2").select("id", "id_2", "sep_arcsec"), "sep_arcsec", places=4)


# ---- ids ----

_IDS = f"WITH {cte('cat_a', 'cat_b')}, l AS (SELECT id, mag FROM cat_a), r AS (SELECT order_id+1000 AS order_id, id AS det FROM cat_b) SELECT"
_ID_ORACLES = {
    "id_inner": ("1and2", _IDS + " l.id, round(l.mag, 6) AS mag, r.det FROM l JOIN r ON l.id = r.order_id"),
    "id_left": ("all1", _IDS + " l.id, round(l.mag, 6) AS mag, r.det FROM l LEFT JOIN r ON l.id = r.order_id"),
    "id_right": ("all2", _IDS + " r.order_id AS id, round(l.mag, 6) AS mag, r.det FROM l RIGHT JOIN r ON l.id = r.order_id"),
    "id_full": ("1or2", _IDS + " l.id, round(l.mag, 6) AS mag, r.order_id, r.det FROM l FULL JOIN r ON l.id = r.order_id"),
    "id_anti": ("1not2", _IDS + " l.id, round(l.mag, 6) AS mag FROM l WHERE l.id NOT IN (SELECT order_id FROM r)"),
    "id_anti_right": ("2not1", _IDS + " r.order_id, r.det FROM r WHERE r.order_id NOT IN (SELECT id FROM l)"),
}


def _id_query(name: str, join_type: str, oracle: str) -> None:
    @query(name, oracle)
    def run(spark, d):
        # keys a thousand apart, so that both sides have rows without partners
        l = frame(spark, d, "cat_a").select("id", "mag")
        r = frame(spark, d, "cat_b").select((F.col("order_id") + 1000).alias("order_id"), F.col("id").alias("det"))
        out = id_join(l, r, "id", "order_id", join_type)
        return rounded(out, "mag") if "mag" in out.columns else out


for _name, (_type, _oracle) in _ID_ORACLES.items():
    _id_query(_name, _type, _oracle)


# ---- position errors ----

ERR = ("id", "ra", "dec", "mag", "ra_err", "dec_err", "rho")
_SIG = "sqrt({t}.ra_err*{t}.ra_err+{t}.dec_err*{t}.dec_err)"
_ERR_COLUMNS = f"l.id AS l_id, r.id AS r_id, {_SIG.format(t='l')}+{_SIG.format(t='r')} AS s, l.ra AS l_ra, r.ra AS r_ra, l.dec AS l_dec, r.dec AS r_dec, l.ra_err AS le, l.dec_err AS ln, l.rho AS lr, r.ra_err AS re, r.dec_err AS rn, r.rho AS rr, l.mag AS l_mag, r.mag AS r_mag"
_ERRS = f"WITH {cte('cat_a', 'cat_b')}, {banded('cat_a', 'cat_b', 'sep <= 2e1', columns=_ERR_COLUMNS)}"
_SKYERR = _ERRS + ", good AS (SELECT *, sep/(1.7e0*s) AS score FROM pairs WHERE sep <= 1.7e0*s)"
_ELLIPSE = (
    _ERRS
    + """, d AS (SELECT *, ((l_ra-r_ra+1.8e2+3.6e2)%3.6e2-1.8e2)*3.6e3*cos(radians(5e-1*(l_dec+r_dec))) AS da, (l_dec-r_dec)*3.6e3 AS dd,
    le*le+re*re AS ee, ln*ln+rn*rn AS nn, lr*le*ln+rr*re*rn AS en FROM pairs),
    good AS (SELECT *, d2 AS score FROM (SELECT *, (nn*da*da-2e0*en*da*dd+ee*dd*dd)/(ee*nn-en*en) AS d2 FROM d) WHERE d2 <= 2.2e0*2.2e0)"""
)
_GOOD = " SELECT l_id AS id, r_id AS id_2, round(sep, 6) AS sep_arcsec FROM good"
_GOOD_BEST = " SELECT l_id AS id, arg_min(r_id, score) AS id_2, round(arg_min(sep, score), 6) AS sep_arcsec FROM good GROUP BY l_id"


def _errors(name: str, oracle: str, **spec) -> None:
    @query(name, oracle)
    def run(spark, d):
        return _ids(pair(spark, d, MatchSpec(**spec), columns=ERR))


_errors("skyerr_best", _SKYERR + _GOOD_BEST, matcher="skyerr", max_error=1.7)
_errors("skyerr_all", _SKYERR + _GOOD, matcher="skyerr", max_error=1.7, find="all")
_errors("skyellipse_best", _ELLIPSE + _GOOD_BEST, matcher="skyellipse", max_error=2.2)
_errors("skyellipse_all", _ELLIPSE + _GOOD, matcher="skyellipse", max_error=2.2, find="all")

_ND = f"""WITH {cte('cat_a', 'cat_b')}, {banded('cat_a', 'cat_b', 'sep <= 2e0', columns='l.id AS l_id, r.id AS r_id, l.mag AS lm, r.mag AS rm')},
    u AS (SELECT mag FROM cat_a UNION ALL SELECT mag FROM cat_b), s AS (SELECT stddev_pop(mag) AS sd FROM u),
    q AS (SELECT *, sqrt(pow(2e0*sin(radians(sep/3.6e3)/2e0), 2)+pow((lm-rm)/sd*5e-1, 2)) AS score FROM pairs, s)
    SELECT l_id AS id, arg_min(r_id, score) AS id_2, round(arg_min(sep, score), 6) AS sep_arcsec FROM q GROUP BY l_id"""


@query("nd_rank", _ND)
def nd_rank(spark, d):
    return _ids(pair(spark, d, MatchSpec(radius_arcsec=2.0, extra_distance_cols={"mag": 0.5})))


# ---- motion ----

_MAS, _T = "4.84813681109536e-9", "1e1"
_MOVED = f"""m AS (SELECT id, (degrees(atan2(y, x))+3.6e2)%3.6e2 AS ra, degrees(atan2(z, sqrt(x*x+y*y))) AS dec FROM (SELECT id,
    cos(radians(dec))*cos(radians(ra))+{_T}*(-pm_ra*{_MAS}*sin(radians(ra))-pm_dec*{_MAS}*sin(radians(dec))*cos(radians(ra))) AS x,
    cos(radians(dec))*sin(radians(ra))+{_T}*(pm_ra*{_MAS}*cos(radians(ra))-pm_dec*{_MAS}*sin(radians(dec))*sin(radians(ra))) AS y,
    sin(radians(dec))+{_T}*pm_dec*{_MAS}*cos(radians(dec)) AS z FROM cat_a))"""
MOTION = ("id", "ra", "dec", "pm_ra", "pm_dec", "epoch")


@query("epoch_match", f"WITH {cte('cat_a', 'cat_b')}, {_MOVED}, {banded('m', 'cat_b', 'sep <= 2.0012345e0')}, best AS (SELECT l_id, arg_min(r_id, sep) AS r_id, min(sep) AS sep FROM pairs GROUP BY l_id) SELECT l_id AS id, r_id AS id_2, round(sep, 5) AS sep_arcsec FROM best")
def epoch_match(spark, d):
    l = catalogue(spark, d, "cat_a", list(MOTION), pm_ra="pm_ra", pm_dec="pm_dec", epoch_column="epoch")
    r = catalogue(spark, d, "cat_b", ["id", "ra", "dec"], epoch=2010.0)
    return rounded(match(l, r, MatchSpec(radius_arcsec=2.0012345, target_epoch=2010.0)).select("id", "id_2", "sep_arcsec"), "sep_arcsec", places=5)


_DRIFT = f"(3e0+7e0*exp(-abs({_GALACTIC})/2e1))*least(3e0, greatest(3e-1, pow(1e1, -2e-1*(mag-1.5e1))))*1.6e1/1e3"


@query("pm_drift", f"WITH {cte('cat_a')} SELECT id, round({_DRIFT}, 6) AS drift FROM cat_a")
def pm_drift(spark, d):
    from ..functions.motion import drift

    c = catalogue(spark, d, "cat_a", ["id", "ra", "dec", "mag"], epoch=2000.0).resolved()
    return c.df.select("id", F.round(drift(c, 2016.0, "mag"), 6).alias("drift"))


_DRIFTED = f"""WITH {cte('cat_a', 'cat_b')}, a2 AS (SELECT id, ra, dec, sqrt(ra_err*ra_err+dec_err*dec_err+pow({_DRIFT}, 2)) AS s FROM cat_a),
    b2 AS (SELECT id, ra, dec, sqrt(ra_err*ra_err+dec_err*dec_err) AS s FROM cat_b), {banded('a2', 'b2', 'sep <= 2e1', columns='l.id AS l_id, r.id AS r_id, l.s+r.s AS s')}
    SELECT l_id AS id, r_id AS id_2, round(sep, 6) AS sep_arcsec FROM pairs WHERE sep <= 1.7e0*s"""


@query("skyerr_drift", _DRIFTED)
def skyerr_drift(spark, d):
    l = catalogue(spark, d, "cat_a", list(ERR), epoch=2000.0)
    r = catalogue(spark, d, "cat_b", list(ERR), epoch=2016.0)
    return _ids(match(l, r, MatchSpec(matcher="skyerr", max_error=1.7, find="all", target_epoch=2016.0, pm_prior=True, pm_prior_magnitude_column="mag")))


# ---- scores ----

_LOG = "-5e-1*sep*sep/v - ln(2e0*pi()) - ln(v)"
_PMATCH = f"WITH {cte('cat_a', 'cat_b')}, {banded('cat_a', 'cat_b', 'sep <= 2e0', columns='l.id AS l_id, r.id AS r_id, 5e-1*(l.ra_err*l.ra_err+l.dec_err*l.dec_err+r.ra_err*r.ra_err+r.dec_err*r.dec_err) AS v')} SELECT l_id AS id, r_id AS id_2, round(sep, 6) AS sep_arcsec, round(1e0/(1e0+exp(-ln(pi()*4e0)-({_LOG}))), 6) AS p_match FROM pairs"


@query("p_match", _PMATCH)
def p_match(spark, d):
    return rounded(_ids(pair(spark, d, MatchSpec(radius_arcsec=2.0, find="all", probabilistic=True), columns=ERR), "p_match"), "p_match")


# kernel densities on a grid of 2048 points, of the 50,000 values whose rows' digests are lowest
_KDE = _PMATCH[: _PMATCH.rindex(" SELECT l_id AS id")].replace("r.id AS r_id, 5e-1", "r.id AS r_id, l.mag AS lm, r.mag AS rm, 5e-1") + f""", u AS (SELECT mag AS v, md5('l' || CAST(id AS VARCHAR)) AS h FROM cat_a UNION ALL SELECT mag, md5('r' || CAST(id AS VARCHAR)) FROM cat_b),
    x AS MATERIALIZED (SELECT v FROM u ORDER BY h LIMIT 50000), st AS (SELECT pow(count(*), -2e-1)*stddev_samp(v) AS h, count(*) AS n FROM x),
    lim AS (SELECT min(v) AS lo, (max(v)-min(v))/2047e0 AS step FROM u),
    den AS MATERIALIZED (SELECT i, ln(sum(exp(-5e-1*pow((lo+i*step-v)/h, 2))))-ln(max(n)*max(h)*sqrt(2e0*pi())) AS d FROM (SELECT unnest(generate_series(0, 2047)) AS i), lim, x, st GROUP BY i),
    tab AS (SELECT list(d ORDER BY i) AS d FROM den),
    q AS (SELECT p.*, d, least(greatest((lm-lo)/step, 0e0), 2047e0) AS al, least(greatest((rm-lo)/step, 0e0), 2047e0) AS ar, least(greatest((5e-1*(lm+rm)-lo)/step, 0e0), 2047e0) AS am FROM pairs p, lim, tab)"""
_READ = "(d[CAST(least(floor({a}), 2046) AS BIGINT)+1]+({a}-least(floor({a}), 2046))*(d[CAST(least(floor({a}), 2046) AS BIGINT)+2]-d[CAST(least(floor({a}), 2046) AS BIGINT)+1]))"


@query("p_match_kde", f"{_KDE} SELECT l_id AS id, r_id AS id_2, round(sep, 6) AS sep_arcsec, round(1e0/(1e0+exp(-ln(pi()*4e0)+{_READ.format(a='al')}+{_READ.format(a='ar')}-({_LOG})-{_READ.format(a='am')})), 6) AS p_match FROM q")
def p_match_kde(spark, d):
    return rounded(_ids(pair(spark, d, MatchSpec(radius_arcsec=2.0, find="all", prior_columns=("mag",)), columns=ERR), "p_match"), "p_match")


_LR = f"""WITH {cte('cat_a', 'cat_b')}, {banded('cat_a', 'cat_b', 'sep <= 2e0', columns='l.id AS l_id, r.id AS r_id, r.mag AS m, l.ra_err*l.ra_err+l.dec_err*l.dec_err+r.ra_err*r.ra_err+r.dec_err*r.dec_err AS v')},
    st AS (SELECT count(*) AS n, min(mag) AS lo, max(mag) AS hi, least(50, CAST(floor(sqrt(count(*))) AS BIGINT)) AS k FROM cat_b),
    ex0 AS (SELECT avg(cos(radians(dec))*cos(radians(ra))) AS x, avg(cos(radians(dec))*sin(radians(ra))) AS y, avg(sin(radians(dec))) AS z FROM cat_b),
    ex AS (SELECT x/sqrt(x*x+y*y+z*z) AS x, y/sqrt(x*x+y*y+z*z) AS y, z/sqrt(x*x+y*y+z*z) AS z FROM ex0),
    ar AS (SELECT pi()*pow(degrees(acos(min(cos(radians(dec))*cos(radians(ra))*x+cos(radians(dec))*sin(radians(ra))*y+sin(radians(dec))*z))), 2)*3.6e3*3.6e3 AS area FROM cat_b, ex),
    bg AS (SELECT CAST(least(k-1, floor((mag-lo)/((hi-lo)/k))) AS BIGINT) AS bin, count(*)/(max(area)*max((hi-lo)/k)) AS n FROM cat_b, st, ar GROUP BY 1),
    cp AS (SELECT p.*, CAST(least(k-1, floor((m-lo)/((hi-lo)/k))) AS BIGINT) AS bin FROM pairs p, st),
    cc AS (SELECT bin, count(*) AS c FROM cp GROUP BY 1),
    q0 AS (SELECT bg.bin, bg.n, greatest(coalesce(c, 0)-bg.n*pi()*4e0*(SELECT count(*) FROM cat_a), 0e0) AS q FROM bg LEFT JOIN cc ON bg.bin = cc.bin),
    q1 AS (SELECT bin, n, q/(SELECT sum(q) FROM q0) AS q FROM q0),
    lr AS (SELECT l_id, r_id, sep, q*greatest(sep/v*exp(-sep*sep/(2e0*v)), 1e-300)/n AS lr FROM cp JOIN q1 ON cp.bin = q1.bin)
    SELECT l_id AS id, r_id AS id_2, round(sep, 6) AS sep_arcsec, round(ln(lr+1e-9), 4) AS ln_lr, round(lr/(sum(lr) OVER (PARTITION BY l_id)+1e0-8e-1), 6) AS reliability FROM lr"""


@query("lr", _LR)
def lr(spark, d):
    out = _ids(pair(spark, d, MatchSpec(radius_arcsec=2.0, find="all", matcher="lr", lr_magnitude_column="mag"), columns=ERR), "lr", "reliability")
    return rounded(out.withColumn("ln_lr", F.round(F.log(F.col("lr") + 1e-9), 4)).drop("lr"), "reliability")


_LR_BEST = _LR[: _LR.rindex("SELECT l_id AS id")] + """SELECT l_id AS id, r_id AS id_2, round(sep, 6) AS sep_arcsec, round(rel, 6) AS reliability FROM (SELECT *, lr/(sum(lr) OVER (PARTITION BY l_id)+1e0-8e-1) AS rel FROM lr)
    QUALIFY row_number() OVER (PARTITION BY l_id ORDER BY rel DESC, lr, sep, r_id) = 1"""


@query("lr_best", _LR_BEST)
def lr_best(spark, d):
    return rounded(_ids(pair(spark, d, MatchSpec(radius_arcsec=2.0, matcher="lr", lr_magnitude_column="mag"), columns=ERR), "reliability"), "reliability")


# the histogram of separations less what chance gives, in even steps of the logarithm, and the probability read from it
_AUF = f"""WITH {cte('cat_a', 'cat_b')}, {banded('cat_a', 'cat_b', 'sep <= 2e0', columns='l.id AS l_id, r.id AS r_id, abs(l.mag-r.mag) AS dm')},
    ex0 AS (SELECT avg(cos(radians(dec))*cos(radians(ra))) AS x, avg(cos(radians(dec))*sin(radians(ra))) AS y, avg(sin(radians(dec))) AS z FROM cat_b),
    ex AS (SELECT x/sqrt(x*x+y*y+z*z) AS x, y/sqrt(x*x+y*y+z*z) AS y, z/sqrt(x*x+y*y+z*z) AS z FROM ex0),
    bg AS (SELECT count(*)/(pi()*pow(degrees(acos(min(cos(radians(dec))*cos(radians(ra))*x+cos(radians(dec))*sin(radians(ra))*y+sin(radians(dec))*z))), 2)*3.6e3*3.6e3) AS b, (SELECT count(*) FROM cat_a) AS n_left FROM cat_b, ex),
    h0 AS (SELECT least(100, greatest(20, CAST(floor(sqrt(count(*))) AS BIGINT))) AS k, greatest(min(CASE WHEN sep > 0e0 THEN sep END), 1e-6) AS lo, greatest(max(sep), 2e0) AS hi FROM pairs),
    h AS (SELECT *, (log10(hi)-log10(lo))/k AS step FROM h0),
    e AS (SELECT i, pow(1e1, log10(lo)+i*step) AS a, pow(1e1, log10(lo)+(i+1)*step) AS z FROM h, (SELECT unnest(generate_series(0, 99)) AS i) WHERE i < k),
    c AS (SELECT CAST(greatest(0, least(k-1, floor((log10(sep)-log10(lo))/step))) AS BIGINT) AS i, count(*) AS n FROM pairs, h WHERE sep >= lo GROUP BY 1),
    f AS (SELECT e.i, z-a AS w, sqrt(a*z) AS m, greatest(coalesce(n, 0)-b*2e0*pi()*sqrt(a*z)*(z-a)*n_left, 0e0) AS f FROM e LEFT JOIN c ON e.i = c.i, bg),
    t AS (SELECT list(ln(greatest(f/(SELECT sum(f) FROM f)/w, 1e-300)) ORDER BY i) AS d, min(m) AS m0 FROM f),
    pl AS (SELECT p.*, least(greatest((ln(greatest(sep, lo*5e-1))-ln(m0))/(step*ln(1e1)), 0e0), CAST(k-1 AS DOUBLE)) AS pos, k, d, b FROM pairs p, h, t, bg),
    lk AS (SELECT *, CAST(least(floor(pos), k-2) AS BIGINT) AS j FROM pl),
    rg AS (SELECT *, exp(d[j+1]+(pos-j)*(d[least(j+2, k)]-d[j+1]))/greatest(2e0*pi()*sep, 1e-6) AS ring FROM lk),
    auf AS (SELECT l_id, r_id, sep, dm, least(1e0, greatest(0e0, ring/(ring+b))) AS p FROM rg)"""


@query("auf", _AUF + " SELECT l_id AS id, r_id AS id_2, round(sep, 6) AS sep_arcsec, round(p, 6) AS auf_prob FROM auf QUALIFY row_number() OVER (PARTITION BY l_id ORDER BY p DESC, sep, r_id) = 1")
def auf(spark, d):
    return rounded(_ids(pair(spark, d, MatchSpec(radius_arcsec=2.0, matcher="auf"), columns=ERR), "auf_prob"), "auf_prob")


_DRAWN = "SELECT mag, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || '{t}')) AS k FROM {c} QUALIFY k <= 5000"
_MACAUFF = _AUF + f""", dl AS ({_DRAWN.format(t='l', c='cat_a')}), dr AS ({_DRAWN.format(t='r', c='cat_b')}), rd AS (SELECT abs(dl.mag-dr.mag) AS x FROM dl JOIN dr ON dl.k = dr.k),
    rh AS (SELECT count(*) AS n, greatest(max(x), 1e-6) AS most, least(100, greatest(20, CAST(floor(sqrt(count(*))) AS BIGINT))) AS k FROM rd),
    rc AS (SELECT CAST(least(k-1, floor(x/(most/k))) AS BIGINT) AS i, count(*) AS c FROM rd, rh GROUP BY 1),
    rt AS (SELECT list(greatest(coalesce(c, 0)/(n*(most/k)), 1e-300) ORDER BY g.i) AS d FROM (SELECT unnest(generate_series(0, 99)) AS i) g LEFT JOIN rc ON g.i = rc.i, rh WHERE g.i < k),
    ma AS (SELECT l_id, r_id, sep, dm, p, most, rh.k AS k, d, least(greatest(dm/(most/rh.k)-5e-1, 0e0), CAST(rh.k-1 AS DOUBLE)) AS pos FROM auf, rh, rt),
    mb AS (SELECT *, CAST(least(floor(pos), k-2) AS BIGINT) AS j FROM ma),
    mo AS (SELECT *, CASE WHEN dm > most-most/k/2e0 THEN 1e-300 ELSE greatest(d[j+1]+(pos-j)*(d[least(j+2, k)]-d[j+1]), 1e-300) END AS other, greatest(exp(-5e-1*(dm/1e-1)*(dm/1e-1))/(1e-1*sqrt(2e0*pi())), 1e-300) AS same FROM mb),
    mp AS (SELECT l_id, r_id, sep, p/greatest(1e0-p, 1e-10)*least(1e10, greatest(1e-10, same/other)) AS odds FROM mo),
    mq AS (SELECT *, least(1e0, greatest(0e0, odds/(1e0+odds))) AS q FROM mp)"""


@query("macauff", _MACAUFF + " SELECT l_id AS id, r_id AS id_2, round(sep, 6) AS sep_arcsec, round(q, 6) AS macauff_prob FROM mq QUALIFY row_number() OVER (PARTITION BY l_id ORDER BY q DESC, sep, r_id) = 1")
def macauff(spark, d):
    return rounded(_ids(pair(spark, d, MatchSpec(radius_arcsec=2.0, matcher="macauff", macauff_flux_columns=("mag",)), columns=ERR), "macauff_prob"), "macauff_prob")


_HEURISTIC = f"""WITH {cte('cat_a', 'cat_b')}, {banded('cat_a', 'cat_b', 'sep <= 2e0', columns='l.id AS l_id, r.id AS r_id, abs(l.mag-r.mag) AS dm, sqrt(l.ra_err*l.ra_err+l.dec_err*l.dec_err+r.ra_err*r.ra_err+r.dec_err*r.dec_err) AS s')},
    {banded('cat_a', 'cat_a', 'sep <= 4e0', name='near')}, n AS (SELECT l_id, count(*) AS n FROM near GROUP BY l_id)
    SELECT p.l_id AS id, r_id AS id_2, round(sep, 6) AS sep_arcsec, round(1e0/(1e0+2e0*sep/s+dm/(SELECT stddev_pop(dm) FROM pairs)+ln(1e0+n/(pi()*1.6e1))), 6) AS ml_score FROM pairs p JOIN n ON n.l_id = p.l_id"""


@query("ml_heuristic", _HEURISTIC)
def ml_heuristic(spark, d):
    from ..operators.match import candidates, prepare, scored
    from ..operators.scores import features, heuristic

    spec = MatchSpec(radius_arcsec=2.0, find="all", matcher="ml", ml_color_columns=("mag",))
    l, r = prepare(catalogue(spark, d, "cat_a", list(ERR)), "l", spec, ("mag",)), prepare(catalogue(spark, d, "cat_b", list(ERR)), "r", spec, ("mag",))
    pairs, names = features(shared.stored(scored(candidates(l, r, spec, 2.0)), "pairs"), l, r, spec)
    out = pairs.select(F.col("l_row").alias("id"), F.col("r_row").alias("id_2"), "sep_arcsec", heuristic(pairs, names).alias("ml_score"))
    return rounded(out, "sep_arcsec", "ml_score")


@query("ml_rf")
def ml_rf(spark, d):
    return _ids(pair(spark, d, MatchSpec(radius_arcsec=2.0, matcher="ml", ml_color_columns=("mag",)), columns=ERR), "ml_score")


@query("xgb_gbt")
def xgb_gbt(spark, d):
    return _ids(pair(spark, d, MatchSpec(radius_arcsec=2.0, matcher="xgb", ml_color_columns=("mag",)), columns=ERR), "xgb_score")


# ---- many catalogues ----

NWAY = ("id", "ra", "dec", "mag", "ra_err", "dec_err")
_RAD = "radians(1e0/3.6e3)"


def _bayes(names: tuple[str, ...]) -> str:
    """log10 of the N-way Bayes factor of relations ``names`` with columns ra, dec, s2 (per axis)."""
    w = {n: f"(1e0/({n}.s2*{_RAD}*{_RAD}))" for n in names}
    total = "(" + "+".join(w.values()) + ")"
    out = f"{len(names) - 1}e0*ln(2e0)+" + "+".join(f"ln({x})" for x in w.values()) + f"-ln({total})"
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            out += f"-{w[a]}*{w[b]}/{total}*pow(({sep(a, b)})*{_RAD}, 2)/2e0"
    return out


def _s2(name: str) -> str:
    return f"{name}s AS (SELECT id, ra, dec, 5e-1*(ra_err*ra_err+dec_err*dec_err) AS s2 FROM {name})"


_AB = banded("cat_a", "cat_b", "sep <= 2e0", name="ab")
_AC = banded("cat_a", "cat_c", "sep <= 2e0", name="ac")
_BC = banded("cat_b", "cat_c", "sep <= 2e0", name="bc")
_NWAY2 = f"WITH {cte('cat_a', 'cat_b')}, {_AB}, {_s2('cat_a')}, {_s2('cat_b')} SELECT l_id AS id, r_id AS id_2, round(1e0/(1e0+exp(-({_bayes(('a', 'b'))}))), 6) AS p_match FROM ab JOIN cat_as a ON a.id = l_id JOIN cat_bs b ON b.id = r_id"
_NWAY3 = f"WITH {cte('cat_a', 'cat_b', 'cat_c')}, {_AB}, {_AC}, {_s2('cat_a')}, {_s2('cat_b')}, {_s2('cat_c')}, t AS (SELECT ab.l_id, ab.r_id AS b_id, ac.r_id AS c_id FROM ab JOIN ac ON ab.l_id = ac.l_id)"
_P3 = f"round(1e0/(1e0+exp(-({_bayes(('a', 'b', 'c'))}))), 6) AS p_match"
_JOIN3 = " JOIN cat_as a ON a.id = l_id JOIN cat_bs b ON b.id = b_id JOIN cat_cs c ON c.id = c_id"


def _many(spark, d, names, columns) -> list:
    return [catalogue(spark, d, n, list(columns)) for n in names]


@query("nway2", _NWAY2)
def nway2(spark, d):
    return rounded(multi.nway(_many(spark, d, ("cat_a", "cat_b"), NWAY), 2.0).select("id", "id_2", "p_match"), "p_match")


@query("nway3", f"{_NWAY3} SELECT l_id AS id, b_id AS id_2, c_id AS id_3, {_P3} FROM t{_JOIN3}")
def nway3(spark, d):
    return rounded(multi.nway(_many(spark, d, ("cat_a", "cat_b", "cat_c"), NWAY), 2.0).select("id", "id_2", "id_3", "p_match"), "p_match")


@query("nway_capped", f"{_NWAY3}, k AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY l_id ORDER BY b_id, c_id) <= 2) SELECT l_id AS id, b_id AS id_2, c_id AS id_3, {_P3} FROM k{_JOIN3}")
def nway_capped(spark, d):
    return rounded(multi.nway(_many(spark, d, ("cat_a", "cat_b", "cat_c"), NWAY), 2.0, cap=2).select("id", "id_2", "id_3", "p_match"), "p_match")


_BEST_AB = f"{_AB}, b1 AS (SELECT l_id, arg_min(r_id, sep) AS r_id, min(sep) AS sep FROM ab GROUP BY l_id)"
_BEST_AC = f"{_AC}, c1 AS (SELECT l_id, arg_min(r_id, sep) AS r_id, min(sep) AS sep FROM ac GROUP BY l_id)"
FEW = ("id", "ra", "dec")


@query("multi3", f"WITH {cte('cat_a', 'cat_b', 'cat_c')}, {_BEST_AB}, {_BEST_AC} SELECT b1.l_id AS id, b1.r_id AS id_2, c1.r_id AS id_3, round(c1.sep, 6) AS sep_arcsec FROM b1 JOIN c1 ON b1.l_id = c1.l_id")
def multi3(spark, d):
    out = multi.chain(_many(spark, d, ("cat_a", "cat_b", "cat_c"), FEW), MatchSpec(radius_arcsec=2.0))
    return rounded(out.select("id", "id_2", "id_3", "sep_arcsec"), "sep_arcsec")


_UNION2 = f"WITH {cte('cat_a', 'cat_b')}, {_BEST_AB} SELECT a.id, b.id AS id_2, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN '1+2' WHEN b.id IS NOT NULL THEN '2' ELSE '1' END AS src_cats, round(b1.sep, 6) AS sep_arcsec FROM cat_a a LEFT JOIN b1 ON a.id = b1.l_id FULL JOIN cat_b b ON b.id = b1.r_id"


@query("union2", _UNION2)
def union2(spark, d):
    out = multi.chain(_many(spark, d, ("cat_a", "cat_b"), FEW), MatchSpec(radius_arcsec=2.0), union=True)
    return rounded(out.select("id", "id_2", F.col("_src_cats").alias("src_cats"), "sep_arcsec"), "sep_arcsec")


# after the first step rows are (a, b) or (b alone); each takes its nearest c, by the position of a where there is one
_UNION3 = f"""WITH {cte('cat_a', 'cat_b', 'cat_c')}, {_BEST_AB},
    u AS (SELECT a.id AS a_id, b.id AS b_id, coalesce(a.ra, b.ra) AS ra, coalesce(a.dec, b.dec) AS dec, coalesce(b.id*2+1, a.id*2) AS id FROM cat_a a LEFT JOIN b1 ON a.id = b1.l_id FULL JOIN cat_b b ON b.id = b1.r_id),
    {banded('u', 'cat_c', 'sep <= 2e0', name='uc', columns='l.a_id, l.b_id, l.id AS l_id, r.id AS r_id')}, c1 AS (SELECT l_id, arg_min(r_id, sep) AS r_id, min(sep) AS sep FROM uc GROUP BY l_id)
    SELECT u.a_id AS id, u.b_id AS id_2, c.id AS id_3, concat_ws('+', CASE WHEN a_id IS NOT NULL THEN '1' END, CASE WHEN b_id IS NOT NULL THEN '2' END, CASE WHEN c.id IS NOT NULL THEN '3' END) AS src_cats
    FROM u LEFT JOIN c1 ON u.id = c1.l_id FULL JOIN cat_c c ON c.id = c1.r_id"""


@query("union3_seq", _UNION3)
def union3_seq(spark, d):
    out = multi.chain(_many(spark, d, ("cat_a", "cat_b", "cat_c"), FEW), MatchSpec(radius_arcsec=2.0), union=True)
    return out.select("id", "id_2", "id_3", F.col("_src_cats").alias("src_cats"))


_STAR = f"""WITH {cte('cat_a', 'cat_b', 'cat_c')}, {_AB}, {_AC}, {_BC},
    b0 AS (SELECT id AS l_id, NULL AS r_id, NULL AS sep FROM cat_a UNION ALL SELECT * FROM ab), c0 AS (SELECT id AS l_id, NULL AS r_id, NULL AS sep FROM cat_a UNION ALL SELECT * FROM ac),
    ca AS (SELECT b0.l_id AS a_id, b0.r_id AS b_id, c0.r_id AS c_id, least(b0.sep, c0.sep) AS sep FROM b0 JOIN c0 ON b0.l_id = c0.l_id
        WHERE b0.r_id IS NOT NULL OR c0.r_id IS NOT NULL OR (b0.l_id NOT IN (SELECT l_id FROM ab) AND b0.l_id NOT IN (SELECT l_id FROM ac))),
    fb AS (SELECT id FROM cat_b WHERE id NOT IN (SELECT r_id FROM ab)),
    cb AS (SELECT NULL AS a_id, fb.id AS b_id, bc.r_id AS c_id, bc.sep FROM fb LEFT JOIN bc ON fb.id = bc.l_id),
    cc AS (SELECT NULL AS a_id, NULL AS b_id, id AS c_id, NULL AS sep FROM cat_c WHERE id NOT IN (SELECT r_id FROM ac) AND id NOT IN (SELECT r_id FROM bc)),
    t AS (SELECT * FROM ca UNION ALL SELECT * FROM cb UNION ALL SELECT * FROM cc)
    SELECT a_id AS id, b_id AS id_2, c_id AS id_3, coalesce(round(sep, 6), -1e0) AS sep_arcsec, concat_ws('+', CASE WHEN a_id IS NOT NULL THEN '1' END, CASE WHEN b_id IS NOT NULL THEN '2' END, CASE WHEN c_id IS NOT NULL THEN '3' END) AS src_cats,
    round(coalesce(a.ra, b.ra, c.ra), 6) AS union_ra FROM t LEFT JOIN cat_a a ON a.id = a_id LEFT JOIN cat_b b ON b.id = b_id LEFT JOIN cat_c c ON c.id = c_id"""


def _starred(out: DataFrame) -> DataFrame:
    value = F.when(F.isnan("sep_arcsec"), -1.0).otherwise(F.round("sep_arcsec", 6))
    return out.select("id", "id_2", "id_3", value.alias("sep_arcsec"), F.col("_src_cats").alias("src_cats"), F.round("_union_ra", 6).alias("union_ra"))


@query("union3_star", _STAR)
def union3_star(spark, d):
    return _starred(multi.star_union(_many(spark, d, ("cat_a", "cat_b", "cat_c"), FEW), MatchSpec(radius_arcsec=2.0)))


# of centres with more than four combinations the first four, by separation and then by ids
_CAPPED = _STAR.replace("ca AS (SELECT", "ca0 AS (SELECT").replace("    fb AS (SELECT id", """    ca AS (SELECT a_id, b_id, c_id, sep FROM ca0 QUALIFY count(*) OVER (PARTITION BY a_id) <= 3 OR row_number() OVER (PARTITION BY a_id ORDER BY sep, b_id NULLS LAST, c_id NULLS LAST) <= 4),
    fb AS (SELECT id""").replace("cb AS (SELECT", "cb0 AS (SELECT").replace("    cc AS (SELECT", "    cb AS (SELECT a_id, b_id, c_id, sep FROM cb0 QUALIFY row_number() OVER (PARTITION BY b_id ORDER BY sep, c_id NULLS LAST) <= 4),\n    cc AS (SELECT", 1)


@query("union_cap", _CAPPED)
def union_cap(spark, d):
    return _starred(multi.star_union(_many(spark, d, ("cat_a", "cat_b", "cat_c"), FEW), MatchSpec(radius_arcsec=2.0), max_tuples=4))


# all links of these catalogues join rows of one order, so a bundle is an order with its linked rows
_FOF = f"""WITH {cte('cat_a', 'cat_b', 'cat_c')}, {_AB}, {_AC}, {_BC},
    e AS (SELECT l_id AS p, 0 AS kind, r_id AS m FROM ab UNION SELECT l_id, 1, r_id FROM ac UNION SELECT ab.l_id, 1, bc.r_id FROM ab JOIN bc ON ab.r_id = bc.l_id UNION SELECT ac.l_id, 0, bc.l_id FROM ac JOIN bc ON ac.r_id = bc.r_id),
    g AS (SELECT p, avg(CASE WHEN kind = 0 THEN b.mag END) AS mag_b, count(DISTINCT CASE WHEN kind = 0 THEN m END) AS nb, count(DISTINCT CASE WHEN kind = 1 THEN m END) AS nc FROM e LEFT JOIN cat_b b ON kind = 0 AND b.id = m GROUP BY p)
    SELECT row_number() OVER (ORDER BY a.id)-1 AS bundle_id, a.id, CAST(1+CASE WHEN nb > 0 THEN 1 ELSE 0 END+CASE WHEN nc > 0 THEN 1 ELSE 0 END AS INTEGER) AS n_cats,
    concat_ws('+', '1', CASE WHEN nb > 0 THEN '2' END, CASE WHEN nc > 0 THEN '3' END) AS src_cats, round(mag_b, 6) AS mag_2 FROM cat_a a LEFT JOIN g ON a.id = g.p"""


@query("fof3", _FOF)
def fof3(spark, d):
    out = multi.friends_of_friends(_many(spark, d, ("cat_a", "cat_b", "cat_c"), ("id", "ra", "dec", "mag")), MatchSpec(radius_arcsec=2.0))
    return rounded(out.select("bundle_id", "id", "n_cats", F.col("_src_cats").alias("src_cats"), "mag_2"), "mag_2")


# ---- observations and candidates ----

_SOURCE = "'skyzone.source.v1:' || sha256('[\"{ns}\",\"int\",' || CAST({id} AS VARCHAR) || ']')"
_PHOT = {"passband": "r", "value_column": "mag", "error_column": "ra_err", "unit": "ABmag", "method": "psf"}
_FLUX = {"passband": "f", "value_column": "dec", "error_column": "dec_err", "unit": "mJy"}


def _released(spark, d, name: str, ns: str):
    return replace(catalogue(spark, d, name), release_namespace=ns)


@query("source_inventory", f"WITH {cte('cat_a')} SELECT {_SOURCE.format(ns='a1', id='id')} AS source_id, 'a1' AS release_namespace, CAST(id AS VARCHAR) AS native_id, round(ra, 6) AS ra_deg, round(dec, 6) AS dec_deg, epoch AS epoch_jyear, round(mag, 6) AS native_mag FROM cat_a")
def source_inventory(spark, d):
    cat = replace(_released(spark, d, "cat_a", "a1"), epoch_column="epoch")
    out = observations.source_inventory(cat).withColumn("native_mag", F.round("native.mag", 6))
    return rounded(out.drop("native", "native_id_type"), "ra_deg", "dec_deg")


_AB_FLUX = "3.631e3*pow(1e1, -4e-1*{m})"
_PHOTOMETRY = f"""WITH {cte('cat_a')}, s AS (SELECT *, {_SOURCE.format(ns='a1', id='id')} AS source_id FROM cat_a)
    SELECT source_id, 'skyzone.photometry.v1:' || sha256('["' || source_id || '","{digest(_PHOT)}"]') AS measurement_id, 'r' AS passband, round(mag, 6) AS native_value, 'measured' AS status,
        round({_AB_FLUX.format(m='mag')}*1e6, 4) AS flux_ujy, round(({_AB_FLUX.format(m='mag')}-{_AB_FLUX.format(m='(mag+ra_err)')})*1e6, 4) AS lower_ujy, round(({_AB_FLUX.format(m='(mag-ra_err)')}-{_AB_FLUX.format(m='mag')})*1e6, 4) AS upper_ujy, CAST(0 AS INTEGER) AS n_flags FROM s
    UNION ALL SELECT source_id, 'skyzone.photometry.v1:' || sha256('["' || source_id || '","{digest(_FLUX)}"]'), 'f', round(dec, 6), 'measured', round(dec*1e3, 4), round(dec_err*1e3, 4), round(dec_err*1e3, 4), CAST(0 AS INTEGER) FROM s"""


@query("photometry", _PHOTOMETRY)
def photometry(spark, d):
    out = observations.normalize_photometry(_released(spark, d, "cat_a", "a1"), [_PHOT, _FLUX])
    ujy = {"flux_ujy": "flux_jy", "lower_ujy": "flux_error_lower_jy", "upper_ujy": "flux_error_upper_jy"}
    return out.select("source_id", "measurement_id", "passband", F.round("native_value", 6).alias("native_value"), "status", *[F.round(F.col(c) * 1e6, 4).alias(n) for n, c in ujy.items()], F.size("flags").alias("n_flags"))


_CLASS = {"property": "order", "value_column": "order_id", "category": "measured", "method": "catalogue", "unit": "none"}


@query("evidence", f"""WITH {cte('cat_b')}, s AS (SELECT *, {_SOURCE.format(ns='b1', id='id')} AS source_id FROM cat_b) SELECT source_id, 'skyzone.property.evidence.v1:' || sha256('["' || source_id || '","{digest(_CLASS)}"]') AS evidence_id,
    'order' AS property, CAST(order_id AS VARCHAR) AS native_value, 'bigint' AS native_value_type, 'none' AS native_unit, 'measured' AS category, 'unknown' AS reference_frame, '[]' AS input_features_json FROM s""")
def evidence(spark, d):
    out = observations.normalize_evidence(_released(spark, d, "cat_b", "b1"), [_CLASS])
    return out.select("source_id", "evidence_id", "property", "native_value", "native_value_type", "native_unit", "category", "reference_frame", "input_features_json")


_PAIRS = f"""WITH {cte('cat_a', 'cat_b')}, {_AB}, e AS (SELECT {_SOURCE.format(ns='a1', id='l_id')} AS source_id, {_SOURCE.format(ns='b1', id='r_id')} AS candidate_id, sep FROM ab),
    s AS (SELECT {_SOURCE.format(ns='a1', id='id')} AS source_id, 'a1' AS release_namespace FROM cat_a UNION ALL SELECT {_SOURCE.format(ns='b1', id='id')}, 'b1' FROM cat_b)"""


@query("candidate_counts", _PAIRS + ", n AS (SELECT source_id, count(*) AS n FROM (SELECT source_id FROM e UNION ALL SELECT candidate_id FROM e) GROUP BY 1) SELECT s.source_id, release_namespace, coalesce(n, 0) AS candidate_count FROM s LEFT JOIN n ON n.source_id = s.source_id")
def candidate_counts(spark, d):
    cats = [_released(spark, d, "cat_a", "a1"), _released(spark, d, "cat_b", "b1")]
    out = candidates.candidate_counts(cats, candidates.candidate_pairs(cats, 2.0))
    return out.select("source_id", "release_namespace", "candidate_count")


@query("hypotheses", _PAIRS + ", h AS (SELECT source_id, candidate_id, -sep*sep/2e0 AS w FROM e UNION ALL SELECT source_id, NULL, -1e0 FROM s WHERE release_namespace = 'a1') SELECT source_id, coalesce(candidate_id, '') AS candidate_id, round(exp(w)/sum(exp(w)) OVER (PARTITION BY source_id), 6) AS probability, CASE WHEN candidate_id IS NULL THEN 'no_match' ELSE 'counterpart' END AS hypothesis_kind FROM h")
def hypotheses(spark, d):
    cats = [_released(spark, d, "cat_a", "a1"), _released(spark, d, "cat_b", "b1")]
    pairs = candidates.candidate_pairs(cats, 2.0).withColumn("log_weight", -F.col("sep_arcsec") * F.col("sep_arcsec") / 2.0)
    sources = candidates.candidate_counts(cats, pairs)
    out = candidates.hypotheses(sources, pairs, "b1", no_match_log_weight=-1.0)
    return out.select("source_id", F.coalesce("candidate_id", F.lit("")).alias("candidate_id"), F.round("probability", 6).alias("probability"), "hypothesis_kind")


# ---- associations ----

_MADE = {"input_release_ids": ["a1", "b1"], "parameters_sha256": "sha256:" + "0" * 64, "software_version": "1"}
_RECORDS = f"""WITH {cte('cat_a', 'cat_b')}, {_AB}, r AS (SELECT 'e' || CAST(l_id AS VARCHAR) || '-' || CAST(r_id AS VARCHAR) AS evidence_id, CAST(l_id AS VARCHAR) AS source_id, CAST(r_id AS VARCHAR) AS candidate_id, sep FROM ab)"""


def _records(spark, d) -> DataFrame:
    pairs = pair(spark, d, MatchSpec(radius_arcsec=2.0, find="all"), columns=FEW)
    return pairs.select(
        F.concat(F.lit("e"), F.col("id").cast("string"), F.lit("-"), F.col("id_2").cast("string")).alias("evidence_id"),
        F.col("id").cast("string").alias("source_id"),
        F.col("id_2").cast("string").alias("candidate_id"),
        F.lit("sky").alias("method"),
        F.lit("1").alias("method_version"),
        F.col("sep_arcsec").alias("separation_arcsec"),
        F.lit(2016.0).alias("evaluation_epoch_jyear"),
        F.when(F.col("sep_arcsec") < 0.9, "selected").otherwise("candidate").alias("decision"),
        F.lit("sep").alias("score_name"),
        F.col("sep_arcsec").alias("score_value"),
        F.lit("ranking_score").alias("score_semantics"),
        F.lit(None).cast("string").alias("calibration_id"),
        F.array().cast("array<string>").alias("flags"),
    )


_IDENTITY = """'skyzone.association.v1:' || sha256('{"candidate_id":"' || candidate_id || '","evaluation_epoch_jyear":2016.0,"evidence_id":"' || evidence_id || '","input_release_ids":["a1","b1"],"method":"sky","method_version":"1","parameters_sha256":"sha256:' || repeat('0', 64) || '","schema_version":"skyzone.association.v1","software_version":"1","source_id":"' || source_id || '"}')"""


@query("assoc_ids", f"{_RECORDS} SELECT source_id, candidate_id, {_IDENTITY} AS association_id FROM r")
def assoc_ids(spark, d):
    return associations.with_identity(_records(spark, d), _MADE).select("source_id", "candidate_id", "association_id")


_MEMBERS = """m AS (SELECT 'a1' AS rel, source_id AS root, source_id AS member FROM {r} UNION SELECT 'b1', source_id, candidate_id FROM {r}),
    n AS (SELECT root, 'skyzone.association.component.v1:' || sha256('{{"association_release_id":"{release}","member_count":' || CAST(count(*) AS VARCHAR) || ',"members_sha256":"sha256:' || sha256(string_agg('{{"input_release_id":"' || rel || '","member_id":"' || member || '"}}' || chr(10), '' ORDER BY rel, member)) || '","schema_version":"skyzone.association.component.v1"}}') AS component_id FROM m GROUP BY root)"""


@query("components", f"{_RECORDS}, s AS (SELECT * FROM r WHERE sep < 9e-1), {_MEMBERS.format(r='s', release='rel1')} SELECT component_id, rel AS input_release_id, member AS member_id FROM m JOIN n ON m.root = n.root")
def components(spark, d):
    return associations.components(_records(spark, d), "rel1", "a1", "b1", ("selected",))


# two partitions of the same records: those under 0.9 arcseconds, then those from 0.5 to 1.3
_DELTAS = f"""{_RECORDS}, pc AS (SELECT DISTINCT source_id FROM r WHERE sep < 9e-1), qc AS (SELECT DISTINCT source_id FROM r WHERE sep > 5e-1 AND sep < 1.3e0)
    SELECT kind, count(*) AS n FROM (SELECT CASE WHEN pc.source_id IS NULL THEN 'created' WHEN qc.source_id IS NULL THEN 'retired' ELSE 'continued' END AS kind FROM pc FULL JOIN qc ON pc.source_id = qc.source_id) GROUP BY kind"""


@query("deltas", _DELTAS)
def deltas(spark, d):
    records = _records(spark, d)
    was = associations.components(records, "rel1", "a1", "b1", ("selected",))
    sep_ = F.col("separation_arcsec")
    other = records.withColumn("decision", F.when((sep_ > 0.5) & (sep_ < 1.3), "selected").otherwise("candidate"))
    now = associations.components(other, "rel2", "a1", "b1", ("selected",))
    return associations.deltas(now, was).groupBy("kind").agg(F.count("*").alias("n"))


# ---- tiles ----


def _tiled(spark, d: str, name: str) -> str:
    """The folder of a catalogue's tiles, written anew."""
    path = f"{shared.fresh(spark, name).removeprefix('file://').removeprefix('file:')}.hats"
    tiles.write(frame(spark, d, name).select("id", "ra", "dec", "mag"), path, "ra", "dec", 500)
    return path


@query("hats_roundtrip", f"WITH {cte('cat_a')} SELECT id, round(ra, 6) AS ra, round(dec, 6) AS dec, round(mag, 6) AS mag FROM cat_a")
def hats_roundtrip(spark, d):
    return rounded(tiles.read(spark, _tiled(spark, d, "cat_a")), "ra", "dec", "mag")


@query("hats_cone", f"WITH {cte('cat_a')} SELECT id, round(ra, 6) AS ra, round(dec, 6) AS dec, round(mag, 6) AS mag FROM cat_a WHERE {_HAVERSINE} <= 1.5e1")
def hats_cone(spark, d):
    return rounded(tiles.read_cone(spark, _tiled(spark, d, "cat_a"), (10.0, 20.0), 15.0), "ra", "dec", "mag")
