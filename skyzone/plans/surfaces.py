"""Queries of sources, sinks, requests, checks, motion and releases over the driver tables."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import functions as F

from .. import shared, sides
from ..catalogue import Catalogue
from ..errors import MatchError
from ..functions import geometry as g
from ..functions import healpix, motion
from ..operators import associations, candidates, multi, observations, releases
from ..operators.components import numbered
from ..operators.match import match
from ..sources import config, files, mirror, storage, tap, tiles
from ..specs import ENGINES, MatchSpec
from ..streaming import detections
from . import queries as q
from .catalogues import banded, catalogue, cte, frame
from .queries import rounded
from .registry import query

SKY = MatchSpec(radius_arcsec=2.0)
_POSITIONS = "SELECT id, round(ra, 6) AS ra, round(dec, 6) AS dec, round(mag, 6) AS mag FROM cat_a"
_CONE = f"WITH {cte('cat_a')} {_POSITIONS} WHERE {q._HAVERSINE} <= 1.5e1"
_PAIRS = f"WITH {cte('cat_a', 'cat_b')}, {banded('cat_a', 'cat_b', 'sep <= 2e0')}"
FEW = ["id", "ra", "dec", "mag"]


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def values(rows: list[tuple], *names: str) -> str:
    """SQL of constant rows."""
    said = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"CAST({x} AS BIGINT)" if type(x) is int else str(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(said, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


# ---- files ----


def _round_trip(name: str, suffix: str) -> None:
    @query(name, f"WITH {cte('cat_a')} {_POSITIONS}")
    def run(spark, d):
        path = f"{shared.fresh(spark, name)}{suffix}"
        files.write(frame(spark, d, "cat_a").select(*FEW), path if suffix != ".fits" else local(path))
        return rounded(files.read(spark, path if suffix != ".fits" else local(path)), "ra", "dec", "mag")


for _name, _suffix in (("parquet_roundtrip", ".parquet"), ("csv_roundtrip", ".csv"), ("tsv_roundtrip", ".tsv"), ("fits_roundtrip", ".fits")):
    _round_trip(_name, _suffix)


@query("fits_text", "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment, c_acctbal > 0 AS owes FROM customer")
def fits_text(spark, d):
    path = local(f"{shared.fresh(spark, 'customers')}.fits")
    files.write(spark.read.parquet(f"{d}/customer.parquet").withColumn("owes", F.col("c_acctbal") > 0), path)
    return files.read(spark, path).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("single_file_sink", f"WITH {cte('cat_a')} {_POSITIONS}")
def single_file_sink(spark, d):
    path = local(f"{shared.fresh(spark, 'single')}.csv")
    files.write(frame(spark, d, "cat_a").select(*FEW), path, single=True)
    return rounded(files.read(spark, path), "ra", "dec", "mag")


@query("storage_walk", values([("a.txt", 3), ("b.txt", 5), ("c.txt", 3)], "name", "size"))
def storage_walk(spark, d):
    store, root = storage.Storage(spark), shared.fresh(spark, "storage")
    store.write(f"{root}/one/a.txt", b"abc")
    store.write(f"{root}/one/deep/b.txt", b"hello")
    store.copy(f"{root}/one", f"{root}/two")
    store.move(f"{root}/two/a.txt", f"{root}/two/c.txt")
    store.remove(f"{root}/one/deep")
    found = {e.name: e.size for e in [*store.walk(f"{root}/one"), *store.walk(f"{root}/two")] if not e.name.startswith(".")}
    return spark.createDataFrame(sorted(found.items()), "name string, size long")


# ---- tiles ----


def _tiled(spark, d, name: str, **options) -> str:
    path = f"{local(shared.fresh(spark, name))}.hats"
    tiles.write(frame(spark, d, name).select(*FEW), path, "ra", "dec", 500, **options)
    return path


@query("hats_ring_cone", _CONE)
def hats_ring_cone(spark, d):
    return rounded(tiles.read_cone(spark, _tiled(spark, d, "cat_a", ordering="RING"), (10.0, 20.0), 15.0), "ra", "dec", "mag")


@query("hats_match", _PAIRS + ", best AS (SELECT l_id, arg_min(r_id, sep) AS r_id, min(sep) AS sep FROM pairs GROUP BY l_id) SELECT l_id AS id, r_id AS id_2, round(sep, 6) AS sep_arcsec FROM best")
def hats_match(spark, d):
    return q._ids(tiles.match_tiles(spark, _tiled(spark, d, "cat_a"), _tiled(spark, d, "cat_b"), SKY, id="id"))


@query("union_tiles", q._UNION2.replace(", round(b1.sep, 6) AS sep_arcsec", ", round(coalesce(a.ra, b.ra), 6) AS union_ra"))
def union_tiles(spark, d):
    """A union written as tiles by the position that each row has."""
    out = multi.chain([catalogue(spark, d, n, ["id", "ra", "dec"]) for n in ("cat_a", "cat_b")], SKY, union=True, position=True)
    path = f"{local(shared.fresh(spark, 'union'))}.hats"
    tiles.write(out, path, "_union_ra", "_union_dec", 5000)
    return tiles.read(spark, path).select("id", "id_2", F.col("_src_cats").alias("src_cats"), F.round("_union_ra", 6).alias("union_ra"))


@query("cone_intervals", f"{_CONE.replace(', round(ra, 6) AS ra, round(dec, 6) AS dec, round(mag, 6) AS mag', '')}")
def cone_intervals(spark, d):
    ranges = healpix.intervals(healpix.cone_pixels(6, (10.0, 20.0), 15.0), 6, tiles.DEEPEST)
    placed = tiles.pixels(frame(spark, d, "cat_a"), "ra", "dec", tiles.DEEPEST, "pix")
    inside = F.lit(False)
    for lo, hi in ranges:
        inside = inside | F.col("pix").between(lo, hi - 1)
    return g.cone(placed.where(inside), "ra", "dec", (10.0, 20.0), 15.0).select("id")


@query("ring_numbers", values([(o, 12 * 4**o) for o in range(6)], "ring_order", "n"))
def ring_numbers(spark, d):
    """Pixels of each order whose number survives the way to rings and back."""
    import numpy as np

    same = lambda o: int((healpix.ring_to_nested(o, healpix.nested_to_ring(o, np.arange(12 * 4**o))) == np.arange(12 * 4**o)).sum())
    return spark.createDataFrame([(o, same(o)) for o in range(6)], "ring_order long, n long")


# ---- services ----

_ASKED = tap.Cone("sky.a", ("id", "mag"), "ra", "dec", (10.0, 20.0), 15.0)


@query("tap_cone", _CONE)
def tap_cone(spark, d):
    return rounded(_ASKED.over({"sky.a": frame(spark, d, "cat_a")}), "ra", "dec", "mag")


@query("tap_box", f"WITH {cte('cat_a')} {_POSITIONS} WHERE dec BETWEEN -5e0 AND 5e0 AND (ra >= 3.56e2 OR ra <= 6e0)")
def tap_box(spark, d):
    # a box around (1, 0) that crosses the seam; the band of 5 degrees widens by the secant of the declination
    found = replace(_ASKED, centre=(1.0, 0.0), radius_deg=5.0, contains=False).over({"sky.a": frame(spark, d, "cat_a")})
    return rounded(found, "ra", "dec", "mag")


@query("tap_self_join", _PAIRS + " SELECT l_id AS a_id, r_id AS b_id, round(sep, 6) AS all_sep_arcsec FROM pairs")
def tap_self_join(spark, d):
    asked = tap.SelfJoin(("sky.a", "sky.b"), (("id",), ("id",)), (("ra", "dec"), ("ra", "dec")), 2.0)
    return rounded(asked.over({"sky.a": frame(spark, d, "cat_a"), "sky.b": frame(spark, d, "cat_b")}), "all_sep_arcsec")


@query("tap_service", _CONE)
def tap_service(spark, d):
    """The result of a query as a service left it, read through the data source."""
    root = shared.fresh(spark, "service")
    job = tap.Recorded(root).submit(_ASKED.text())
    rows = _ASKED.over({"sky.a": frame(spark, d, "cat_a")})
    files.write(rows, local(f"{root}-{job}.csv"), single=True)
    _put(spark, f"{root}-{job}.csv", f"{root}/{job}.csv")
    spark.dataSource.register(tap.ServiceTable)
    reader = spark.read.format("skyzone_service").schema("id long, mag double, ra double, dec double")
    found = reader.options(query=_ASKED.text(), transport="skyzone.sources.tap:Recorded", argument=root).load()
    return rounded(found, "ra", "dec", "mag")


def _put(spark, source: str, target: str) -> None:
    storage.Storage(spark).copy(source, target)
    storage.Storage(spark).remove(source)


@query("service_retries", values([("ends", 3, "3.0"), ("fails", 3, "3.0"), ("paced", 5, "2.0")], "how", "calls", "waited"))
def service_retries(spark, d):
    def calls(fail: int) -> tuple[int, float, bool]:
        n, waits = [0], []

        def call() -> str:
            n[0] += 1
            if n[0] <= fail:
                raise tap.ServiceError("busy")
            return "done"

        try:
            tap.retried(call, sleep=waits.append)
        except tap.ServiceError:
            return n[0], sum(waits), False
        return n[0], sum(waits), True

    a, b = calls(2), calls(9)
    now = [0.0]
    limiter = tap.RateLimiter(2.0, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(5):
        limiter.take()
    return spark.createDataFrame([("ends", a[0], str(a[1])), ("fails", b[0], str(b[1])), ("paced", 5, str(round(now[0], 6)))], "how string, calls long, waited string")


@query("service_names", values([("plain", "a.b_c"), ("odd", 'a."b-c"'), ("quoted", '"x.y".z'), ("doubled", '"q""r"')], "kind", "quoted"))
def service_names(spark, d):
    given = {"plain": "a.b_c", "odd": "a.b-c", "quoted": '"x.y".z', "doubled": 'q"r'}
    return spark.createDataFrame([(k, tap.quoted(v)) for k, v in given.items()], "kind string, quoted string")


# ---- names and roles ----


@query("sky_detected", q._BEST + " SELECT l_id AS id, r_id AS id_2, round(sep, 6) AS sep_arcsec FROM best")
def sky_detected(spark, d):
    """Coordinates found by their columns' names."""
    l = frame(spark, d, "cat_a").select("id", F.col("ra").alias("RAJ2000"), F.col("dec").alias("DEJ2000"))
    r = frame(spark, d, "cat_b").select("id", F.col("dec").alias("de_icrs"), F.col("ra").alias("RA_ICRS"), F.lit(0.0).alias("delta"))
    return q._ids(match(Catalogue(l, id="id"), Catalogue(r, id="id"), SKY))


@query("registry", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lines', count(*) FROM lineitem UNION ALL SELECT 'parts', count(*) FROM part")
def registry(spark, d):
    root = local(shared.fresh(spark, "registry"))
    storage.Storage(spark).write(f"{root}/base.yaml", json.dumps({"catalogues": {"Orders": {"path": f"{d}/orders.parquet"}, "Lines": {"path": "nowhere"}, "Parts": {"path": f"{d}/nowhere.parquet", "fallbacks": [f"{d}/part.parquet"]}}}).encode())
    storage.Storage(spark).write(f"{root}/over.yaml", json.dumps({"catalogues": {"Lines": {"path": f"{d}/lineitem.parquet"}}, "aliases": {"o": "Orders"}}).encode())
    known = config.load(f"{root}/base.yaml", f"{root}/over.yaml")
    return spark.createDataFrame([("orders", config.resolve(spark, "O", known).df.count()), ("lines", config.resolve(spark, "lines", known).df.count()), ("parts", config.resolve(spark, "PARTS", known).df.count())], "name string, n long")


@query("engines", f"{q._BEST}, n AS (SELECT count(*) AS n, round(sum(sep), 3) AS total FROM best) SELECT engine, n, total FROM n, (SELECT unnest([{', '.join(map(repr, ENGINES))}]) AS engine)")
def engines(spark, d):
    """Every engine's name runs the one engine there is."""
    out = None
    for name in ENGINES:
        own = q.pair(spark, d, replace(SKY, engine=name), columns=("id", "ra", "dec")).agg(F.lit(name).alias("engine"), F.count("*").alias("n"), F.round(F.sum("sep_arcsec"), 3).alias("total"))
        out = own if out is None else out.unionByName(own)
    return out


# ---- checks ----


def _cases(spark, d) -> dict:
    a = frame(spark, d, "cat_a")
    ok = Catalogue(a, ra="ra", dec="dec", id="id", ra_err="ra_err", dec_err="dec_err", corr="rho", release_namespace="n")
    flux = {"passband": "r", "value_column": "mag", "unit": "ABmag"}
    bad = lambda c, v: replace(ok, df=a.withColumn(c, F.expr(v)))
    skyerr = MatchSpec(matcher="skyerr")
    run = lambda cat, spec=SKY: (lambda: match(cat, ok, spec))
    spec = lambda **k: (lambda: MatchSpec(**k))
    photometry = lambda *m: (lambda: observations.normalize_photometry(ok, list(m)))
    covariance = {k: k for k in motion.COVARIANCE_KEYS}
    errors = {k: F.lit(1.0) for k in motion.COVARIANCE_KEYS[:5]}
    rho = lambda v: replace(ok, df=a.withColumns(errors | {k: F.lit(v) for k in motion.COVARIANCE_KEYS[5:]}), ra_err=None, dec_err=None, corr=None, covariance=covariance)
    return {
        "good match": run(ok),
        "null coordinate": run(bad("ra", "CAST(NULL AS DOUBLE)")),
        "infinite coordinate": run(bad("dec", "CAST('Infinity' AS DOUBLE)")),
        "declination over 90": run(bad("dec", "9.1e1")),
        "no coordinates": run(replace(ok, ra=None, dec=None, df=a.select("id"))),
        "negative error": run(bad("ra_err", "-1e0"), skyerr),
        "not-a-number error": run(bad("dec_err", "CAST('NaN' AS DOUBLE)"), skyerr),
        "correlation over 1": run(bad("rho", "1.5e0"), MatchSpec(matcher="skyellipse")),
        "good covariance": run(rho(0.5), MatchSpec(matcher="skyellipse", max_error=1.0)),
        "impossible covariance": run(rho(-0.9), MatchSpec(matcher="skyellipse")),
        "missing errors": run(replace(ok, ra_err=None, dec_err=None), replace(skyerr, fallback_policy="error")),
        "missing errors at an epoch": run(replace(ok, ra_err=None, dec_err=None, epoch=2000.0), replace(skyerr, target_epoch=2010.0)),
        "other frames": run(replace(ok, frame="fk5")),
        "blank frame": run(replace(ok, frame=" ")),
        "epoch of other frames": lambda: match(replace(ok, frame="fk5"), replace(ok, frame="fk5"), replace(SKY, target_epoch=2010.0)),
        "good spec": spec(radius_arcsec=1.0),
        "radius 0": spec(radius_arcsec=0.0),
        "unknown matcher": spec(matcher="sky2"),
        "unknown join": spec(join_type="1xor2"),
        "batch of half a row": spec(batch_size=0.5),
        "good mapping": photometry(flux),
        "unknown key": photometry(flux | {"colour": 1}),
        "no unit": photometry({k: v for k, v in flux.items() if k != "unit"}),
        "zero point below 0": photometry(flux | {"zeropoint_jy": -1.0}),
        "confidence of 1": photometry(flux | {"limit_confidence": 1.0}),
        "time without scale": photometry(flux | {"observation_time": 5.0, "time_format": "mjd"}),
        "codes without names": photometry(flux | {"status_column": "id"}),
        "mapping twice": photometry(flux, dict(flux)),
        "no mapping": photometry(),
        "column not there": photometry(flux | {"error_column": "nowhere"}),
        "unknown category": lambda: observations.normalize_evidence(ok, [{"property": "p", "value_column": "mag", "category": "guess", "method": "m"}]),
        "prediction without model": lambda: observations.normalize_evidence(ok, [{"property": "p", "value_column": "mag", "category": "prediction", "method": "m"}]),
        "ids once": lambda: observations.validate_inventory(a.select(F.col("id").alias("source_id"))),
        "ids twice": lambda: observations.validate_inventory(a.unionAll(a).select(F.col("id").alias("source_id"))),
        "tiles apart": lambda: tiles.check_overlap([(1, 4, "x"), (1, 5, "y")]),
        "tile within a tile": lambda: tiles.check_overlap([(1, 4, "x"), (2, 17, "y")]),
        "unknown decision": lambda: associations.components(a.select(F.col("id").cast("string").alias("source_id"), F.col("id").cast("string").alias("candidate_id"), F.lit("x").alias("decision")), "r", "a", "b", ("maybe",)),
        "one input release": lambda: associations.provenance(["a"], "1", {}),
    }


_GOOD = ("good match", "good covariance", "good spec", "good mapping", "ids once", "tiles apart")
_NAMES = (
    "null coordinate", "infinite coordinate", "declination over 90", "no coordinates", "negative error", "not-a-number error", "correlation over 1", "impossible covariance",
    "missing errors", "missing errors at an epoch", "other frames", "blank frame", "epoch of other frames", "radius 0", "unknown matcher", "unknown join", "batch of half a row",
    "unknown key", "no unit", "zero point below 0", "confidence of 1", "time without scale", "codes without names", "mapping twice", "no mapping", "column not there",
    "unknown category", "prediction without model", "ids twice", "tile within a tile", "unknown decision", "one input release",
)


@query("refusals", values([(n, True) for n in _NAMES] + [(n, False) for n in _GOOD], "given", "refused"))
def refusals(spark, d):
    """What is refused, and what is not."""

    def refused(call) -> bool:
        try:
            call()
        except (MatchError, ValueError):
            return True
        return False

    return spark.createDataFrame([(k, refused(f)) for k, f in _cases(spark, d).items()], "given string, refused boolean")


@query("words", values([("category", c) for c in observations.CATEGORIES] + [("decision", c) for c in associations.DECISIONS] + [("delta", c) for c in associations.DELTA_KINDS] + [("semantics", c) for c in associations.SEMANTICS] + [("status", c) for c in observations.STATUSES], "vocabulary", "word"))
def words(spark, d):
    """Each vocabulary's words that the checks let by."""
    own = spark.createDataFrame([(w,) for w in ("measured", "inferred_spectroscopy", "inferred_photometry_astrometry", "literature_assertion", "prediction", "candidate", "selected", "rejected", "ranking_score", "assumed_prior_posterior", "calibrated_probability", "created", "continued", "merged", "split", "retired", "upper_limit", "missing", "masked", "outside_footprint", "not_detected", "ambiguous", "invalid", "other")], "word string")
    sets = {"category": observations.CATEGORIES, "decision": associations.DECISIONS, "delta": associations.DELTA_KINDS, "semantics": associations.SEMANTICS, "status": observations.STATUSES}
    out = None
    for name, known in sets.items():
        part = own.where(F.col("word").isin(*known)).select(F.lit(name).alias("vocabulary"), "word")
        out = part if out is None else out.unionByName(part)
    return out


@query("required_columns", values([(k, c) for k, c in enumerate(("id", "ra", "dec", "ra_err", "dec_err", "rho", "mag", "epoch"))], "k", "name"))
def required_columns(spark, d):
    cat = replace(catalogue(spark, d, "cat_a"), release_namespace="n")
    found = observations.required_columns(cat, [{"passband": "r", "value_column": "mag", "error_column": "ra_err", "unit": "ABmag"}], [{"property": "p", "value_column": "epoch"}])
    return spark.createDataFrame(list(enumerate(found)), "k long, name string")


@query("no_pairs", "SELECT 0 AS n, 'id,ra,dec,mag,id_2,ra_2,dec_2,mag_2,sep_arcsec' AS names")
def no_pairs(spark, d):
    """A match that finds nothing has its columns all the same."""
    out = q.pair(spark, d, MatchSpec(radius_arcsec=1e-6, find="all"))
    return out.agg(F.count("*").cast("int").alias("n")).withColumn("names", F.lit(",".join(out.columns)))


@query("union_types", q._UNION2.replace("round(b1.sep, 6) AS sep_arcsec FROM", "a.status, b.order_id FROM").replace("cat_a a LEFT", "(SELECT *, CASE WHEN id%2 = 0 THEN 'even' ELSE 'odd' END AS status FROM cat_a) a LEFT"))
def union_types(spark, d):
    """Columns of one side alone are typed nulls in rows of the other."""
    l = frame(spark, d, "cat_a").select("id", "ra", "dec").withColumn("status", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    r = frame(spark, d, "cat_b").select("id", "ra", "dec", "order_id")
    out = multi.chain([Catalogue(l, ra="ra", dec="dec", id="id"), Catalogue(r, ra="ra", dec="dec", id="id")], SKY, union=True)
    return out.select("id", "id_2", F.col("_src_cats").alias("src_cats"), "status", "order_id")


# ---- order ----


@query("numbered_rows", f"WITH {cte('cat_b')} SELECT id, row_number() OVER (ORDER BY id)-1 AS k FROM cat_b")
def numbered_rows(spark, d):
    return numbered(frame(spark, d, "cat_b").select("id"), "id", "k")


@query("nearest_pairs", _PAIRS + " SELECT l_id AS id, r_id AS id_2, round(sep, 6) AS sep_arcsec FROM pairs ORDER BY round(sep, 6), l_id, r_id LIMIT 25")
def nearest_pairs(spark, d):
    """A top-k report: the 25 closest pairs."""
    return q._ids(q.pair(spark, d, replace(SKY, find="all"))).orderBy("sep_arcsec", "id", "id_2").limit(25)


@query("canonical_full", q._SOME + " DISTINCT a.id, b.id AS id_2, round(p.sep, 6) AS sep_arcsec FROM cat_a a LEFT JOIN pairs p ON a.id = p.l_id FULL JOIN cat_b b ON b.id = p.r_id")
def canonical_full(spark, d):
    """A full join of both catalogues' rows given twice, each row once and in order."""
    l, r = (frame(spark, d, n).select("id", "ra", "dec") for n in ("cat_a", "cat_b"))
    sides = [Catalogue(df.unionAll(df).distinct(), ra="ra", dec="dec", id="id") for df in (l, r)]
    return q._ids(match(*sides, MatchSpec(radius_arcsec=1.5, find="all", join_type="1or2"))).distinct().orderBy("id", "id_2")


@query("stream_pairs", _PAIRS + " SELECT l_id AS id, r_id AS id_2, round(sep, 6) AS sep_arcsec FROM pairs")
def stream_pairs(spark, d):
    """Detections that stream in, matched with a static catalogue; what has come when the input ends."""
    root = shared.fresh(spark, "stream")
    frame(spark, d, "cat_a").select("id", "ra", "dec").write.parquet(f"{root}/in")
    stream = spark.readStream.schema("id long, ra double, dec double").parquet(f"{root}/in")
    found = detections.pairs(stream, catalogue(spark, d, "cat_b", ["id", "ra", "dec"]), 2.0)
    found.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    return rounded(spark.read.parquet(f"{root}/out"), "sep_arcsec").select("id", "id_2", "sep_arcsec")


# ---- motion ----

_RV = "CAST(id%100 AS DOUBLE)-5e1"
_PLX = "CAST(id%7 AS DOUBLE)*1e2"
_GROW = f"(CASE WHEN {_PLX} > 0e0 THEN ({_RV})*({_PLX})*{q._MAS}/4.740470463e0 ELSE 0e0 END)"
_FAST = f"""SELECT id, round((degrees(atan2(y, x))+3.6e2)%3.6e2, 7) AS ra, round(degrees(atan2(z, sqrt(x*x+y*y))), 7) AS dec FROM (SELECT id,
    cos(radians(dec))*cos(radians(ra))*(1e0+1e2*g)+1e2*(-m_a*sin(radians(ra))-m_d*sin(radians(dec))*cos(radians(ra))) AS x,
    cos(radians(dec))*sin(radians(ra))*(1e0+1e2*g)+1e2*(m_a*cos(radians(ra))-m_d*sin(radians(dec))*sin(radians(ra))) AS y,
    sin(radians(dec))*(1e0+1e2*g)+1e2*m_d*cos(radians(dec)) AS z FROM (SELECT id, ra, dec, (pm_ra+1e0)*1e2*{q._MAS} AS m_a, pm_dec*1e2*{q._MAS} AS m_d, {_GROW} AS g FROM cat_a))"""


@query("motion_in_space", f"WITH {cte('cat_a')} {_FAST}")
def motion_in_space(spark, d):
    """Positions a century on of rows that move on the sky and along the line of sight."""
    df = frame(spark, d, "cat_a").withColumns({"pm_ra": (F.col("pm_ra") + 1) * 100, "pm_dec": F.col("pm_dec") * 100, "rv": (F.col("id") % 100).cast("double") - 50, "plx": (F.col("id") % 7).cast("double") * 100})
    cat = Catalogue(df, ra="ra", dec="dec", id="id", pm_ra="pm_ra", pm_dec="pm_dec", parallax="plx", radial_velocity="rv", epoch=2000.0)
    ra, dec = motion.moved(cat, 2100.0)
    return df.select("id", F.round(ra, 7).alias("ra"), F.round(dec, 7).alias("dec"))


_CARRIED = """SELECT id, round((re*re+2e1*re*pr*3e-1+1e2*pr*pr)*1e-6, 9) AS ee, round((de*de+2e1*de*pd*2e-1+1e2*pd*pd)*1e-6, 9) AS nn,
    round((re*de*1e-1+1e1*(re*pd*5e-2+de*pr*-1e-1)+1e2*pr*pd*1.5e-1)*1e-6, 9) AS en FROM (SELECT id, ra_err*1e2 AS re, dec_err*1e2 AS de, CAST(id%5 AS DOUBLE)+1e0 AS pr, CAST(id%3 AS DOUBLE)+2e0 AS pd FROM cat_a)"""


@query("covariance_transport", f"WITH {cte('cat_a')} {_CARRIED}")
def covariance_transport(spark, d):
    """The position block of a five-by-five covariance, carried ten years."""
    given = {"ra_error": F.col("ra_err") * 100, "dec_error": F.col("dec_err") * 100, "parallax_error": F.lit(0.1), "pmra_error": (F.col("id") % 5 + 1).cast("double"), "pmdec_error": (F.col("id") % 3 + 2).cast("double")}
    given |= {"ra_dec_corr": F.lit(0.1), "ra_pmra_corr": F.lit(0.3), "ra_pmdec_corr": F.lit(0.05), "dec_pmra_corr": F.lit(-0.1), "dec_pmdec_corr": F.lit(0.2), "pmra_pmdec_corr": F.lit(0.15)}
    given |= {k: F.lit(0.0) for k in motion.COVARIANCE_KEYS if k not in given}
    df = frame(spark, d, "cat_a").withColumns({f"c_{k}": v for k, v in given.items()})
    cat = Catalogue(df, ra="ra", dec="dec", id="id", pm_ra="pm_ra", pm_dec="pm_dec", epoch=2000.0, covariance={k: f"c_{k}" for k in given})
    ee, nn, en = motion.covariance(cat, 2010.0)
    return df.select("id", F.round(ee, 9).alias("ee"), F.round(nn, 9).alias("nn"), F.round(en, 9).alias("en"))


# ---- releases ----


def _surveys(spark, d):
    return [(q._released(spark, d, "cat_a", "a1"), [q._PHOT, q._FLUX], []), (q._released(spark, d, "cat_b", "b1"), [], [q._CLASS])]


@query("observation_release", f"WITH {cte('cat_a', 'cat_b')} SELECT 'sources' AS name, (SELECT count(*) FROM cat_a)+(SELECT count(*) FROM cat_b) AS n UNION ALL SELECT 'photometry', 2*count(*) FROM cat_a UNION ALL SELECT 'evidence', count(*) FROM cat_b")
def observation_release(spark, d):
    path = shared.fresh(spark, "release")
    releases.write_observations(_surveys(spark, d), path)
    made = releases.verify_observations(spark, path)
    return spark.createDataFrame([(k, releases.read_table(spark, path, k).count()) for k in made["files"]], "name string, n long")


@query("candidate_release", q._PAIRS + " SELECT source_id, candidate_id, round(sep, 6) AS sep_arcsec FROM e")
def candidate_release(spark, d):
    path = shared.fresh(spark, "release")
    releases.write_candidates([q._released(spark, d, "cat_a", "a1"), q._released(spark, d, "cat_b", "b1")], 2.0, path)
    releases.verify_candidates(spark, path)
    return rounded(releases.read_table(spark, path, "pairs").select("source_id", "candidate_id", "sep_arcsec"), "sep_arcsec")


def _published(spark, d) -> str:
    path = shared.fresh(spark, "release")
    releases.write_associations(q._records(spark, d), path, q._MADE)
    releases.verify_associations(path)
    return path


@query("association_release", f"{q._RECORDS} SELECT source_id, candidate_id, {q._IDENTITY} AS association_id, CASE WHEN sep < 9e-1 THEN 'selected' ELSE 'candidate' END AS decision FROM r")
def association_release(spark, d):
    return releases.read_lines(_published(spark, d), releases.ASSOCIATION_ROW).select("source_id", "candidate_id", "association_id", "decision")


@query("release_order", f"{q._RECORDS} SELECT count(*) AS n, CAST(0 AS BIGINT) AS falls FROM r")
def release_order(spark, d):
    """Records read one by one, each part by a task, and how often an id does not rise."""
    return spark.createDataFrame([releases.order_of(_published(spark, d), "association_id")], "n long, falls long")


@query("component_release", f"{q._RECORDS}, s AS (SELECT * FROM r WHERE sep < 9e-1), {q._MEMBERS.format(r='s', release='rel1')} SELECT component_id, rel AS input_release_id, member AS member_id FROM m JOIN n ON m.root = n.root")
def component_release(spark, d):
    path = shared.fresh(spark, "release")
    releases.write_components(associations.components(q._records(spark, d), "rel1", "a1", "b1", ("selected",)), path, "rel1", ("selected",))
    releases.verify_components(spark, path)
    return releases.read_table(spark, path, "members")


@query("delta_release", q._DELTAS)
def delta_release(spark, d):
    records, sep_ = q._records(spark, d), F.col("separation_arcsec")
    was = associations.components(records, "rel1", "a1", "b1", ("selected",))
    other = records.withColumn("decision", F.when((sep_ > 0.5) & (sep_ < 1.3), "selected").otherwise("candidate"))
    now = associations.components(other, "rel2", "a1", "b1", ("selected",))
    path = shared.fresh(spark, "release")
    releases.write_deltas(associations.deltas(now, was), path, {"parent_association_release_id": "rel1", "current_association_release_id": "rel2"})
    releases.verify_deltas(path)
    return releases.read_lines(path, releases.DELTA_ROW).groupBy("kind").agg(F.count("*").alias("n"))


_SAME = """'skyzone.association.equivalence.v1:' || sha256('{"current_association_release_id":"rel2","current_member":{"input_release_id":"a2","member_id":"n' || CAST(id AS VARCHAR) || '"},"parent_association_release_id":"rel1","parent_member":{"input_release_id":"a1","member_id":"' || CAST(id AS VARCHAR) || '"},"schema_version":"skyzone.association.equivalence.v1"}')"""


@query("equivalence_release", f"WITH {cte('cat_a')} SELECT {_SAME} AS equivalence_id, 'n' || CAST(id AS VARCHAR) AS current_member_id, CAST(id AS VARCHAR) AS parent_member_id FROM cat_a")
def equivalence_release(spark, d):
    own = F.col("id").cast("string")
    rows = frame(spark, d, "cat_a").select(F.lit("a2").alias("current_release_id"), F.concat(F.lit("n"), own).alias("current_member_id"), F.lit("a1").alias("parent_release_id"), own.alias("parent_member_id"))
    path = shared.fresh(spark, "release")
    releases.write_equivalences(rows, path, {"release_id": "rel1", "input_release_ids": ["a1", "b1"]}, {"release_id": "rel2", "input_release_ids": ["a2", "b1"]})
    releases.verify_equivalences(path)
    return releases.read_lines(path, releases.EQUIVALENCE_ROW).select("equivalence_id", "current_member_id", "parent_member_id")


@query("resumed_run", "SELECT count(*) AS n, 1 AS made FROM orders")
def resumed_run(spark, d):
    """A request that was answered before is read, not run again."""
    made = []

    def run():
        made.append(1)
        return spark.read.parquet(f"{d}/orders.parquet")

    request = {"table": d, "spec": repr(SKY), "run": shared.fresh(spark, "request")}
    for _ in range(3):
        out = shared.resumed(spark, request, run)
    return out.agg(F.count("*").alias("n")).withColumn("made", F.lit(len(made)))


@query("candidate_hypothesis_space", q._PAIRS + " SELECT release_namespace, count(*) AS n FROM s GROUP BY 1")
def candidate_hypothesis_space(spark, d):
    cats = [q._released(spark, d, "cat_a", "a1"), q._released(spark, d, "cat_b", "b1")]
    return candidates.candidate_counts(cats, candidates.candidate_pairs(cats, 2.0)).groupBy("release_namespace").agg(F.count("*").alias("n"))


# ---- sides and regions ----


@query("side_options", q._BEST + " SELECT l_id AS id, round(a.mag, 6) AS mag, r_id AS id_2, order_id, round(sep, 6) AS sep_arcsec FROM best JOIN cat_a a ON a.id = l_id JOIN cat_b b ON b.id = r_id")
def side_options(spark, d):
    """Columns and roles of each side by its number; what matching needs comes along unasked."""
    own = sides.overrides({"id": "id", "ra": "ra", "dec_1": "d1", "dec_2": "dec", "columns_1": "mag", "columns_2": ["order_id"]}, 2)
    frames = [frame(spark, d, "cat_a").withColumnRenamed("dec", "d1"), frame(spark, d, "cat_b")]
    cats = [sides.projected(Catalogue(df, **{k: v for k, v in o.items() if k != "columns"}), o.get("columns"), SKY) for df, o in zip(frames, own)]
    out = match(*cats, SKY)
    assert "mag_2" not in out.columns and "epoch" not in out.columns
    return rounded(out.select("id", "mag", "id_2", "order_id", "sep_arcsec"), "mag", "sep_arcsec")


@query("remote_region", q._BEST + f" SELECT l_id AS id, r_id AS id_2, round(sep, 6) AS sep_arcsec FROM best JOIN cat_a ON id = l_id WHERE {q._HAVERSINE} <= 1.5e1")
def remote_region(spark, d):
    """A local cone matched with a remote table of which only the inferred region is asked for."""
    local_rows = Catalogue(g.cone(frame(spark, d, "cat_a").select("id", "ra", "dec"), "ra", "dec", (10.0, 20.0), 15.0), id="id")
    centre, radius = sides.region(local_rows, SKY)
    remote = tap.Cone("sky.b", ("id",), "ra", "dec", centre, radius).over({"sky.b": frame(spark, d, "cat_b")})
    return q._ids(match(local_rows, Catalogue(remote, id="id"), SKY))


@query("surrogate_rejoin", _PAIRS + " SELECT a.id, round(a.mag, 6) AS mag, r_id AS id_2 FROM pairs JOIN cat_a a ON a.id = l_id")
def surrogate_rejoin(spark, d):
    """Rows sent to a service under keys of their own, and its answer brought back to them."""
    rows, sent = tap.uploaded(frame(spark, d, "cat_a").select("id", "ra", "dec", "mag"), ["ra", "dec"])
    asked = tap.SelfJoin(("up", "sky.b"), (("_key",), ("id",)), (("ra", "dec"), ("ra", "dec")), 2.0)
    answer = asked.over({"up": sent, "sky.b": frame(spark, d, "cat_b")}).select(F.col("a__key").alias("_key"), F.col("b_id").alias("id"))
    return rounded(tap.rejoined(rows, answer).select("id", "mag", "id_2"), "mag")


@query("true_separation", q._SOME + " a.id, b.id AS id_2, round(p.sep, 6) AS again FROM cat_a a LEFT JOIN pairs p ON a.id = p.l_id FULL JOIN cat_b b ON b.id = p.r_id")
def true_separation(spark, d):
    out = q.pair(spark, d, MatchSpec(radius_arcsec=1.5, find="all", join_type="1or2"), columns=("id", "ra", "dec"))
    again = g.true_separation(*[F.col(c) for c in ("ra", "dec", "ra_2", "dec_2")])
    return out.select("id", "id_2", F.round(again, 6).alias("again"))


@query("matcher_expression", values([("3.0 * (hypot(e1, e2) + hypot(f1, f2))",)], "said"))
def matcher_expression(spark, d):
    return spark.createDataFrame([(g.error_expression(("e1", "e2"), ("f1", "f2"), 3.0),)], "said string")


# ---- mirrors ----


@query("mirror_tiles", f"WITH {cte('cat_a')} {_POSITIONS}")
def mirror_tiles(spark, d):
    """A tree copied, broken and copied again, and what a replica of it holds."""
    source, target = _tiled(spark, d, "cat_a"), local(shared.fresh(spark, "mirror"))
    first = mirror.sync(spark, source, target)
    store = storage.Storage(spark)
    store.remove(f"{target}/{first.copied[0]}")
    store.write(f"{target}/dataset/left-over.parquet", b"x")
    again = mirror.sync(spark, source, target)
    assert again.copied == first.copied[:1] and again.pruned == ["dataset/left-over.parquet"] and not again.failed
    df = mirror.first_of(["file:///nowhere/at/all", target], lambda root: tiles.read(spark, root))
    return rounded(df, "ra", "dec", "mag")


@query("mirror_table", f"WITH {cte('cat_a')} {_POSITIONS}")
def mirror_table(spark, d):
    """A table fetched in pages by its key, in two visits of which the first sees half of it."""
    rows, target = frame(spark, d, "cat_a").select(*FEW), shared.fresh(spark, "pages")
    half = rows.agg(F.max("id")).first()[0] // 2
    page = lambda df: (lambda after, size: df.where(F.col("id") > (-1 if after is None else after)).orderBy("id").limit(size))
    size = max(1, half // 2)
    mirror.mirror_table(spark, page(rows.where(F.col("id") <= half)), "id", target, size)
    mirror.mirror_table(spark, page(rows), "id", target, size)
    return rounded(spark.read.parquet(f"{target}/page-*"), "ra", "dec", "mag")


@query("hub_routing", f"WITH {cte('cat_b')} SELECT count(*) AS n, 0 AS strays FROM cat_b")
def hub_routing(spark, d):
    """Every row of a catalogue goes to a hub tile, or to its own pixel, that its position lies in."""
    hubs = [(o, p) for o, p, _ in tiles.partitions(_tiled(spark, d, "cat_a"))]
    rows = tiles.routed(tiles.pixels(frame(spark, d, "cat_b"), "ra", "dec", tiles.DEEPEST, "_pix"), hubs)
    stray = (F.col("hub.pix") != F.expr("shiftright(_pix, 2 * (10 - hub.order))")).cast("int")
    return rows.agg(F.count("*").alias("n"), F.sum(stray).cast("int").alias("strays"))


@query("listing_links", values([("Dir=0/",), ("Npix=1.parquet",), ("properties",)], "name"))
def listing_links(spark, d):
    page = '<html><a href="../">up</a><a href="?C=N">sort</a><a href="Dir=0/">d</a><A HREF="Npix=1.parquet">n</A><a href="https://x.org/">x</a><a href="/root">r</a><a href="properties">p</a><a href="properties">p</a></html>'
    return spark.createDataFrame([(x,) for x in mirror.links(page)], "name string")


@query("places", values([("auth basic", "Basic dTpw"), ("auth none", "-"), ("auth token", "Bearer t"), ("cache by config", "/c"), ("cache by environment", "/e"), ("cache by home", "/h/.cache/skyzone/cache"), ("endpoint", "https://h.org/tap"), ("order fits", "None"), ("order given", "3"), ("order large", "2"), ("page", "SELECT TOP 5 * FROM t WHERE k > 7 ORDER BY k"), ("table", "https://h.org/tap s.t"), ("table bare", "None s.t"), ("table none", "None")], "what", "said"))
def places(spark, d):
    asked = {
        "auth basic": mirror.basic_auth({"SKYZONE_USER": "u", "SKYZONE_PASSWORD": "p"}).get("Authorization", "-"),
        "auth none": mirror.basic_auth({"SKYZONE_USER": "u"}).get("Authorization", "-"),
        "auth token": mirror.basic_auth({"SKYZONE_TOKEN": "t", "SKYZONE_USER": "u", "SKYZONE_PASSWORD": "p"}).get("Authorization", "-"),
        "cache by config": mirror.roots({"HOME": "/h"}, {"cache": "/c"}),
        "cache by environment": mirror.roots({"HOME": "/h", "SKYZONE_CACHE": "/e"}, {"cache": "/c"}),
        "cache by home": mirror.roots({"HOME": "/h"}, {}),
        "endpoint": tap.endpoint("https://h.org/tap/async/17?x=1"),
        "order fits": mirror.spill_order(1000, 0.5, 1000),
        "order given": mirror.spill_order(10**9, 1.0, 1, explicit=3),
        "order large": mirror.spill_order(32_000, 1.0, 1000),
        "page": mirror.page_query("t", "k", 7, 5),
        "table": " ".join(tap.table_id("https://h.org/tap/sync#s.t")),
        "table bare": "{} {}".format(*tap.table_id("s.t")),
        "table none": tap.table_id("no table"),
    }
    return spark.createDataFrame([(k, str(v)) for k, v in asked.items()], "what string, said string")


@query("discovered", values([("sky.a", "ra,dec,source"), ("sky.b", "-")], "table_name", "roles"))
def discovered(spark, d):
    """Tables that a search finds, and the registry entries that their columns make."""
    known = spark.createDataFrame([("sky.a", "Bright stars"), ("sky.b", "bright STARS, no positions"), ("sky.c", "faint stars"), ("sky.d", None)], "table_name string, description string")
    columns = {"sky.a": [("ra", "pos.eq.ra;meta.main"), ("dec", "pos.eq.dec;meta.main"), ("source", "meta.id;meta.main"), ("ra2", "pos.eq.ra")], "sky.b": [("x", None)]}
    out = []
    for r in tap.searched(known, ["bright", "Stars"]).collect():
        try:
            e = tap.entry_of(r.table_name, "https://h.org/tap/sync", columns[r.table_name])
            out.append((r.table_name, ",".join((e["ra"], e["dec"], e["id"]))))
        except tap.ServiceError:
            out.append((r.table_name, "-"))
    return spark.createDataFrame(out, "table_name string, roles string")


@query("registry_drift", values([("a", "outdated"), ("b", "informational"), ("c", "missing"), ("d", "user"), ("x", "alias")], "name", "how"))
def registry_drift(spark, d):
    bundled = {"catalogues": {"a": {"path": "1"}, "b": {"path": "2", "description": "old"}, "c": {"path": "3"}, "e": {"path": "5"}}, "aliases": {"x": "a", "y": "b"}}
    own = {"catalogues": {"a": {"path": "9"}, "b": {"path": "2", "description": "new"}, "d": {"path": "4"}, "e": {"path": "5"}}, "aliases": {"x": "e", "z": "d"}}
    assert config.drift(bundled, config.adopted(own, bundled, ["a", "b", "c"])) == [("d", "user"), ("x", "alias")]
    return spark.createDataFrame(config.drift(bundled, own), "name string, how string")
