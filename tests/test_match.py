import math

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from skyzone.catalogue import Catalogue
from skyzone.errors import MatchError
from skyzone.functions import geometry as g
from skyzone.operators import multi
from skyzone.operators.match import id_join, match
from skyzone.specs import MatchSpec

ARC = 1 / 3600.0


def cat(spark, rows, columns="id long, ra double, dec double", **roles):
    return Catalogue(spark.createDataFrame(rows, columns), **{"ra": "ra", "dec": "dec", "id": "id", **roles})


def separations(a, b):
    """All separations in arcseconds, by the haversine formula."""
    ra1, d1, ra2, d2 = (np.radians(x) for x in (a[:, 0][:, None], a[:, 1][:, None], b[:, 0][None], b[:, 1][None]))
    h = np.sin((d2 - d1) / 2) ** 2 + np.cos(d1) * np.cos(d2) * np.sin((ra2 - ra1) / 2) ** 2
    return np.degrees(2 * np.arcsin(np.sqrt(np.minimum(1, h)))) * 3600


@pytest.mark.parametrize("radius", [1.0, 180.0, 1800.0, 18_000.0, 144_000.0, 432_000.0])
def test_all_pairs_are_those_of_brute_force_with_seam_and_poles(spark, radius):
    rng = np.random.default_rng(int(radius))
    n = 250
    a = np.stack([rng.uniform(0, 360, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n)))], 1)
    a[:20] = np.stack([rng.uniform(-0.3, 0.3, 20) % 360, rng.uniform(-0.3, 0.3, 20)], 1)
    a[20:40] = np.stack([rng.uniform(0, 360, 20), rng.choice([-1, 1], 20) * rng.uniform(89.5, 90, 20)], 1)
    b = a + rng.normal(0, radius / 3600 / 2, a.shape)
    b[:, 1] = np.clip(b[:, 1], -90, 90)
    b[:, 0] %= 360
    rows = lambda x: [(i, float(p), float(q)) for i, (p, q) in enumerate(x)]
    found = match(cat(spark, rows(a)), cat(spark, rows(b)), MatchSpec(radius_arcsec=radius, find="all")).select("id", "id_2").collect()
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(separations(a, b) <= radius))}
    assert len(found) == len({tuple(r) for r in found})
    assert {tuple(r) for r in found} == want


def test_best_is_nearest_for_each_left_row_and_ties_go_to_the_smaller_id(spark):
    l = cat(spark, [(1, 10.0, 0.0), (2, 10.0, 0.0), (3, 50.0, 0.0)])
    r = cat(spark, [(7, 10.0, ARC), (5, 10.0, -ARC), (9, 50.0, 0.5 * ARC), (8, 50.0, 0.2 * ARC)])
    out = {x.id: x.id_2 for x in match(l, r, MatchSpec(radius_arcsec=2.0)).collect()}
    assert out == {1: 5, 2: 5, 3: 8}


@pytest.mark.parametrize("kind, rows", [("1and2", 1), ("all1", 2), ("all2", 3), ("1or2", 4), ("all", 4), ("1not2", 1), ("2not1", 2)])
def test_join_types(spark, kind, rows):
    l = cat(spark, [(1, 10.0, 0.0), (2, 20.0, 0.0)])
    r = cat(spark, [(1, 10.0, 0.1 * ARC), (2, 30.0, 0.0), (3, 40.0, 0.0)])
    out = match(l, r, MatchSpec(radius_arcsec=1.0, join_type=kind))
    assert out.count() == rows
    assert out.columns == (["id", "ra", "dec"] if kind == "1not2" else ["id_2", "ra_2", "dec_2"] if kind == "2not1" else ["id", "ra", "dec", "id_2", "ra_2", "dec_2", "sep_arcsec"])


def test_rows_without_ids_are_told_apart(spark):
    rows = [(10.0, 0.0), (10.0, 0.0), (20.0, 0.0)]
    c = Catalogue(spark.createDataFrame(rows, "RAJ2000 double, DEJ2000 double"))
    out = match(c, c, MatchSpec(radius_arcsec=1.0, find="all", join_type="1or2"))
    assert out.count() == 5
    assert "RAJ2000_2" in out.columns


def test_filter_does_not_replace_a_rejected_best(spark):
    l = cat(spark, [(1, 10.0, 0.0, 5.0)], "id long, ra double, dec double, mag double")
    r = cat(spark, [(1, 10.0, 0.1 * ARC, 9.0), (2, 10.0, 0.2 * ARC, 5.0)], "id long, ra double, dec double, mag double")
    out = match(l, r, MatchSpec(radius_arcsec=1.0, filter_expr="abs(mag - mag_2) < 1", join_type="all1")).collect()
    assert [x.id_2 for x in out] == [None]
    with pytest.raises(MatchError):
        match(l, r, MatchSpec(radius_arcsec=1.0, filter_expr="nonsense > 1"))


def test_error_criteria(spark):
    schema = "id long, ra double, dec double, e double, f double"
    roles = {"ra_err": "e", "dec_err": "f"}
    l = cat(spark, [(1, 10.0, 0.0, 0.1, 0.1)], schema, **roles)
    near = cat(spark, [(1, 10.0, 0.5 * ARC, 0.1, 0.1)], schema, **roles)
    assert match(l, near, MatchSpec(matcher="skyerr", max_error=2.0)).count() == 1
    assert match(l, near, MatchSpec(matcher="skyerr", max_error=1.0)).count() == 0
    assert match(l, near, MatchSpec(matcher="skyellipse", max_error=3.6)).count() == 1
    assert match(l, near, MatchSpec(matcher="skyellipse", max_error=3.5)).count() == 0
    zero = cat(spark, [(1, 10.0, 0.0, 0.0, 0.0)], schema, **roles)
    assert match(zero, zero, MatchSpec(matcher="skyerr")).count() == 0
    bad = cat(spark, [(1, 10.0, 0.0, math.nan, 0.1)], schema, **roles)
    with pytest.raises(MatchError):
        match(l, bad, MatchSpec(matcher="skyerr"))
    with pytest.raises(MatchError):
        match(l, cat(spark, [(1, 10.0, 0.0)]), MatchSpec(matcher="skyerr", fallback_policy="error"))


def test_bad_coordinates_and_frames(spark):
    good = cat(spark, [(1, 10.0, 0.0)])
    for row in ((1, math.nan, 0.0), (1, 0.0, 91.0), (1, math.inf, 0.0)):
        with pytest.raises(MatchError):
            match(good, cat(spark, [row]), MatchSpec())
    with pytest.raises(MatchError):
        match(good, cat(spark, [(1, 10.0, 0.0)], frame="fk5"), MatchSpec())
    for wrong in ({"radius_arcsec": 0}, {"radius_arcsec": 700_000}, {"matcher": "x"}, {"find": "x"}, {"join_type": "x"}, {"lr_q": 2.0}, {"batch_size": 0}):
        with pytest.raises(ValueError):
            MatchSpec(**wrong)


def test_empty_sides_keep_their_columns(spark):
    l, r = cat(spark, [(1, 10.0, 0.0)]), cat(spark, [])
    assert match(l, r, MatchSpec()).count() == 0
    assert match(l, r, MatchSpec(join_type="1or2")).count() == 1
    assert match(r, l, MatchSpec(join_type="1or2")).count() == 1


def test_proper_motion(spark):
    schema = "id long, ra double, dec double, pa double, pd double"
    l = cat(spark, [(1, 10.0, 60.0, 1000.0, 500.0)], schema, pm_ra="pa", pm_dec="pd", epoch=2000.0)
    moved_ra, moved_dec = 10.0 + 10 * ARC / math.cos(math.radians(60)), 60.0 + 5 * ARC
    r = cat(spark, [(1, moved_ra, moved_dec)], epoch=2010.0)
    assert match(l, r, MatchSpec(radius_arcsec=0.01, target_epoch=2010.0)).count() == 1
    assert match(l, r, MatchSpec(radius_arcsec=5.0)).count() == 0


def test_id_joins(spark):
    l = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "oid long, g double")
    r = spark.createDataFrame([(2, 1.0), (3, 2.0), (4, 3.0)], "oid long, r double")
    rows = {k: id_join(l, r, "oid", "oid", k).count() for k in ("1and2", "all1", "all2", "1or2", "1not2", "2not1")}
    assert rows == {"1and2": 2, "all1": 3, "all2": 3, "1or2": 4, "1not2": 1, "2not1": 1}


def test_star_union_against_enumeration(spark):
    rng = np.random.default_rng(42)
    sky = [np.round(np.stack([10 + rng.uniform(0, 0.02, n), rng.uniform(0, 0.02, n)], 1), 6) for n in (25, 18, 20)]
    cats = [cat(spark, [(i, float(p), float(q)) for i, (p, q) in enumerate(x)]) for x in sky]
    radius = 15.0
    near = {(i, j): separations(sky[i], sky[j]) <= radius for i in range(3) for j in range(3) if i != j}
    want = set()
    for i in range(3):
        for row in range(len(sky[i])):
            if any(near[i, k][row].any() for k in range(i)):
                continue
            mates = [[None, *np.flatnonzero(near[i, j][row]).tolist()] for j in range(i + 1, 3)]
            combos = [()]
            for m in mates:
                combos = [(*c, x) for c in combos for x in m]
            if any(len(m) > 1 for m in mates):
                combos = [c for c in combos if any(x is not None for x in c)]
            want |= {(*(None,) * i, row, *c) for c in combos}
    out = multi.star_union(cats, MatchSpec(radius_arcsec=radius))
    assert {(r.id, r.id_2, r.id_3) for r in out.collect()} == want
    assert out.where("_src_cats IN ('1', '2', '3')").where(~F.isnan("sep_arcsec")).count() == 0


def test_friends_of_friends_chain(spark):
    a, b, c = cat(spark, [(0, 10.0, 0.0), (1, 50.0, 0.0)]), cat(spark, [(0, 10.0, 0.8 * ARC)]), cat(spark, [(0, 10.0, 1.6 * ARC), (1, 70.0, 0.0)])
    out = {r.id: (r.bundle_id, r.n_cats, r["_src_cats"]) for r in multi.friends_of_friends([a, b, c], MatchSpec(radius_arcsec=1.0)).collect()}
    assert out == {0: (0, 3, "1+2+3"), 1: (1, 1, "1")}


def test_detection_and_extent(spark):
    assert g.detect_coordinates(["id", "RAJ2000", "DEJ2000"]) == ("RAJ2000", "DEJ2000")
    assert g.detect_coordinates(["ra_icrs", "de_icrs"]) == ("ra_icrs", "de_icrs")
    df = spark.createDataFrame([(359.0, 0.0), (1.0, 0.0)], "ra double, dec double")
    e = g.sky_extent(df, "ra", "dec")
    assert min(e["ra_deg"], 360 - e["ra_deg"]) < 1e-9 and abs(e["radius_deg"] - 1) < 1e-9


@pytest.mark.parametrize("matcher", ["skyerr", "skyellipse"])
def test_rows_of_great_errors_search_far_and_others_do_not(spark, matcher):
    rng = np.random.default_rng(5)
    n = 400
    a = [(i, float(rng.uniform(0, 2)), float(rng.uniform(-1, 1)), float(s), float(s)) for i, s in enumerate(rng.choice([0.5, 2.0, 30.0, 900.0, 4000.0], n, p=[0.6, 0.3, 0.06, 0.03, 0.01]))]
    b = [(i, float(rng.uniform(0, 2)), float(rng.uniform(-1, 1)), float(s), float(s)) for i, s in enumerate(rng.choice([0.1, 1.0, 60.0, 1500.0], n, p=[0.5, 0.4, 0.07, 0.03]))]
    schema = "id long, ra double, dec double, e double, f double"
    l, r = (Catalogue(spark.createDataFrame(x, schema), id="id", ra_err="e", dec_err="f") for x in (a, b))
    got = {(x.id, x.id_2) for x in match(l, r, MatchSpec(matcher=matcher, max_error=1.5, find="all")).collect()}
    A, B = np.asarray(a), np.asarray(b)
    u = lambda m: np.stack([np.cos(np.radians(m[:, 2])) * np.cos(np.radians(m[:, 1])), np.cos(np.radians(m[:, 2])) * np.sin(np.radians(m[:, 1])), np.sin(np.radians(m[:, 2]))], 1)
    if matcher == "skyerr":
        sep = np.degrees(2 * np.arcsin(np.linalg.norm(u(A)[:, None] - u(B)[None], axis=2) / 2)) * 3600
        good = sep <= 1.5 * np.sqrt(2) * (A[:, None, 3] + B[None, :, 3])
    else:
        d_dec = (A[:, None, 2] - B[None, :, 2]) * 3600
        d_ra = (A[:, None, 1] - B[None, :, 1]) * 3600 * np.cos(np.radians((A[:, None, 2] + B[None, :, 2]) / 2))
        good = (d_ra**2 + d_dec**2) / (A[:, None, 3] ** 2 + B[None, :, 3] ** 2) <= 1.5**2
    assert got == set(zip(*(x.tolist() for x in np.nonzero(good)))) and len(got) > 1000


def test_capped_tuples_are_the_first_of_all():
    rng = np.random.default_rng(4)
    for _ in range(200):
        mates = [[(int(r), float(rng.integers(1, 6))) for r in rng.permutation(30)[: rng.integers(0, 5)]] for _ in range(rng.integers(1, 4))]
        every = [()]
        for own in mates:
            every = [(*t, m) for t in every for m in [*own, None]]
        whole = [(min(s for m in t if m for s in m[1:]), tuple(m[0] if m else None for m in t)) for t in every if any(t)]
        order = sorted(whole, key=lambda x: (x[0], tuple(math.inf if r is None else r for r in x[1])))
        for most in (1, 3, 10, 10**6):
            assert [(s, t) for t, s in multi.nearest_tuples(mates, most)] == order[:most]


def test_capped_tuples_of_large_pools_are_not_all_made():
    mates = [[(i, 1.0 + i) for i in range(100_000)] for _ in range(3)]
    assert len(list(multi.nearest_tuples(mates, 100))) == 100


@pytest.mark.parametrize("cap", [0, 1, 3])
def test_nway_keeps_the_first_tuples_of_four_catalogues(spark, cap):
    rng = np.random.default_rng(9)
    columns = "id long, ra double, dec double, e double, f double"
    rows = [[(k, float(rng.integers(0, 3)), float(rng.normal(0, 0.3)) * ARC, 0.3, 0.3) for k in range(12)] for _ in range(4)]
    cats = [cat(spark, r, columns, ra_err="e", dec_err="f") for r in rows]
    near = lambda a, b: a[1] == b[1] and abs(a[2] - b[2]) <= 0.5 * ARC
    want = []
    for a in rows[0]:
        own = [(b[0], c[0], d[0]) for b in rows[1] if near(a, b) for c in rows[2] if near(a, c) for d in rows[3] if near(a, d)]
        want += [(a[0], *t) for t in (sorted(own)[:cap] if cap else own)]
    got = [(r.id, r.id_2, r.id_3, r.id_4) for r in multi.nway(cats, 0.5, cap=cap).collect()]
    assert sorted(got) == sorted(want) and want


@pytest.mark.parametrize("matcher, column", [("ml", "ml_score"), ("xgb", "xgb_score")])
def test_learnt_scores_work_in_a_session_that_has_observed_rows(spark, matcher, column):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 3
    schema = "id long, ra double, dec double, mag double"
    l = cat(spark, [(i, float(i), 0.0, 10.0) for i in range(20)], schema, default_error=0.5)
    r = cat(spark, [(i, float(i), 0.2 * ARC, 10.1) for i in range(20)] + [(100 + i, float(i), -0.9 * ARC, 12.0) for i in range(20)], schema, default_error=0.5)
    out = match(l, r, MatchSpec(radius_arcsec=2.0, matcher=matcher, ml_color_columns=("mag",))).collect()
    assert {x.id: x.id_2 for x in out} == {i: i for i in range(20)}
    assert all(0 <= x[column] <= 1 for x in out)
