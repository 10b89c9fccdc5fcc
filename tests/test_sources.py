import numpy as np
import pytest
from pyspark.sql import functions as F

from skyzone import cli
from skyzone.errors import ConfigError, InputError, MatchError, ServiceError
from skyzone.functions import healpix
from skyzone.functions.identity import canonical, content_id, digest, json_text, source_id
from skyzone.operators import associations, candidates, observations, releases
from skyzone.catalogue import Catalogue
from skyzone.sources import config, files, tap, tiles


def test_pixels_nest_and_hold_their_centres():
    for order in (0, 1, 3, 6):
        pix = np.arange(12 * 4**order) if order < 5 else np.random.default_rng(1).integers(0, 12 * 4**order, 3000)
        a, d = healpix.centre(order, pix)
        assert (healpix.pixel(order, a, d) == pix).all()
    rng = np.random.default_rng(0)
    a, d = rng.uniform(0, 360, 5000), np.degrees(np.arcsin(rng.uniform(-1, 1, 5000)))
    fine = healpix.pixel(8, a, d)
    for order in range(8):
        assert (healpix.pixel(order, a, d) == fine >> (2 * (8 - order))).all()
    share = np.bincount(healpix.pixel(1, a, d), minlength=48) / 5000
    assert abs(share - 1 / 48).max() < 0.01
    assert healpix.pixel(3, np.asarray([0.0, 90.0]), np.asarray([90.0, -90.0])).min() >= 0


def test_tiles_round_trip(spark, tmp_path):
    df = spark.range(3000).withColumn("ra", (F.col("id") * 137.5) % 360).withColumn("dec", F.degrees(F.asin((F.col("id") / 1500.0) - 1)))
    path = str(tmp_path / "c.hats")
    tiles.write(df, path, "ra", "dec", threshold=200)
    found = tiles.partitions(path)
    tiles.check_overlap(found)
    assert tiles.properties(path)["hats_nrows"] == "3000" and len(found) > 12
    assert sorted(r.id for r in tiles.read(spark, path).select("id").collect()) == list(range(3000))
    near = {r.id for r in tiles.read_cone(spark, path, (1.0, 85.0), 12.0).collect()}
    from skyzone.functions.geometry import cone

    assert near == {r.id for r in cone(df, "ra", "dec", (1.0, 85.0), 12.0).collect()} and near
    with pytest.raises(FileExistsError):
        tiles.write(df, path, "ra", "dec")
    with pytest.raises(InputError):
        tiles.check_overlap([(0, 1, ""), (1, 5, "")])


def test_files_round_trip(spark, tmp_path):
    rows = [(1, 2.5, "a", True), (2, None, None, None), (2**60, -1.0, "ünï", False)]
    df = spark.createDataFrame(rows, "id long, x double, name string, ok boolean")
    for suffix in (".parquet", ".csv", ".tsv", ".fits"):
        path = str(tmp_path / f"t{suffix}")
        files.write(df, path, single=True)
        back = {r.id: (None if r.x is None or r.x != r.x else r.x, r.name or None, r.ok) for r in files.read(spark, path).collect()}
        assert back == {i: (x, n, o) for i, x, n, o in rows}
    for bad in ("t.xyz", "t"):
        with pytest.raises(InputError):
            files.read(spark, str(tmp_path / bad))
        with pytest.raises(InputError):
            files.write(df, str(tmp_path / bad))


def test_service_queries():
    assert tap.quoted("a.b-c") == 'a."b-c"'
    assert "CIRCLE('ICRS', 10.0, 20.0, 0.5)" in tap.cone_query("t", ["mag"], "ra", "dec", (10.0, 20.0), 0.5)
    assert tap.cone_query("t", ["mag"], "ra", "dec", (10.0, 20.0), 0.5, id_column="id").startswith("SELECT mag, ra, dec, id FROM t")
    assert " OR " in tap.box_predicate("ra", "dec", (0.1, 0.0), 1.0) and "ra" not in tap.box_predicate("ra", "dec", (0.1, 89.5), 1.0)
    assert tap.coordinates_by_ucd([("x", "pos.eq.ra"), ("y", "pos.eq.dec;meta.main"), ("z", "pos.eq.ra;meta.main")]) == ("z", "y")
    assert "a.id AS a_id" in tap.self_join_query(("t", "u"), (["id"], ["id"]), (("ra", "dec"), ("ra", "dec")), 1.0)

    class Fake:
        phases = ["QUEUED", "EXECUTING", "COMPLETED"]

        def submit(self, query):
            return "1"

        def phase(self, job):
            return self.phases.pop(0)

        def fetch(self, job):
            return "/tmp/result.csv"

    assert tap.Service(Fake(), sleep=lambda s: None).run("q") == "/tmp/result.csv"
    Fake.phases = ["ERROR"] * 9
    with pytest.raises(ServiceError):
        tap.retried(lambda: tap.Service(Fake(), sleep=lambda s: None).run("q"), sleep=lambda s: None)
    now = [0.0]
    limiter = tap.RateLimiter(2.0, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(5):
        limiter.take()
    assert now[0] == pytest.approx(2.0)


def test_config_and_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("id,ra,dec\n1,10,0\n2,20,0\n")
    (tmp_path / "b.csv").write_text("id,ra,dec\n7,10,0.0001\n8,30,0\n")
    own = tmp_path / "skyzone.yaml"
    own.write_text(f"catalogues:\n  first:\n    path: {tmp_path}/a.csv\n    id: id\naliases:\n  f: first\n")
    registry = config.load(own)
    assert config.resolve(spark, "F", registry).id == "id"
    with pytest.raises(ConfigError, match="did you mean first"):
        config.resolve(spark, "frist", registry)
    args = ["match", "first", f"{tmp_path}/b.csv", "--config", str(own), "--ids", "id,id"]
    assert cli.run([*args, "--join", "1or2"], spark) == 0
    lines = capsys.readouterr().out.strip().splitlines()
    assert lines[0].strip() == "id,ra,dec,id_2,ra_2,dec_2,sep_arcsec" and len(lines) == 4
    assert cli.run([*args, "-o", f"{tmp_path}/out.parquet"], spark) == 0
    assert spark.read.parquet(f"{tmp_path}/out.parquet").count() == 1
    assert cli.run(["match", "first", "--config", str(own)], spark) == 2
    assert cli.run(["list", "--config", str(own)], spark) == 0
    assert cli.run([*args, "--set", "columns_1=id", "--set", "ra_2=ra", "--region", "10,0,1"], spark) == 0
    assert "\n".join(capsys.readouterr().out.strip().splitlines()[-2:]).startswith("id,ra,dec,id_2")
    with pytest.raises(MatchError):
        cli.run([*args, "--set", "colour_1=x"], spark)
    bundled = tmp_path / "bundled.yaml"
    bundled.write_text(f"catalogues:\n  first:\n    path: {tmp_path}/a.csv\n    id: key\n  second:\n    path: {tmp_path}/b.csv\n    description: other stars\n")
    assert cli.run(["drift", "--config", str(own), "--bundled", str(bundled)], spark) == 1
    assert cli.run(["adopt", "first", "second", "--config", str(own), "--bundled", str(bundled)], spark) == 0
    assert cli.run(["drift", "--config", str(own), "--bundled", str(bundled), "--strict"], spark) == 0
    assert cli.run(["doctor", "--config", str(own)], spark) == 0
    capsys.readouterr()
    assert cli.run(["search", "STARS", "--config", str(own)], spark) == 0 and capsys.readouterr().out == "second\tother stars\n"
    (tmp_path / "tables.csv").write_text("table_name,description\nsky.a,bright stars\nsky.b,galaxies\n")
    (tmp_path / "columns.csv").write_text("table_name,column_name,ucd\nsky.a,ra,pos.eq.ra\nsky.a,dec,pos.eq.dec\nsky.b,z,\n")
    assert cli.run(["discover", f"{tmp_path}/tables.csv", f"{tmp_path}/columns.csv", "--service", "https://h.org/tap/sync", "--words", "stars"], spark) == 0
    assert capsys.readouterr().out == "sky.a\tdec=dec\tpath=https://h.org/tap#sky.a\tra=ra\n"
    assert cli.run(["completion", "bash"], spark) == 0 and "complete -o default" in capsys.readouterr().out
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "properties").write_text("a=1")
    assert cli.run(["sync", f"{tmp_path}/tree", f"{tmp_path}/copy"], spark) == 0 and (tmp_path / "copy" / "properties").read_text() == "a=1"
    (tmp_path / "bad.yaml").write_text("catalogues:\n  x: {}\n")
    with pytest.raises(ConfigError):
        config.load(tmp_path / "bad.yaml")


def test_identities(spark):
    texts = ["plain", 'quo"te\\', "tab\t\n\r\b\f\x01", "é😀", "", "\x7f"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(json_text(F.col("t")).alias("j"), source_id("ns", F.col("t"), "str").alias("s"))
    assert [r.j for r in df.collect()] == [canonical(t).decode() for t in texts]
    assert [r.s for r in df.collect()] == [content_id("skyzone.source.v1", ["ns", "str", t]) for t in texts]
    big = spark.createDataFrame([(2**60,)], "i long").select(source_id("ns", F.col("i"), "int").alias("s")).first().s
    assert big == content_id("skyzone.source.v1", ["ns", "int", 2**60])


def test_photometry_states(spark):
    df = spark.createDataFrame([(1, 10.0, 0.1, "ok"), (2, None, 0.1, "ok"), (3, float("nan"), 0.1, "ok"), (4, -5.0, 0.1, "lim"), (5, 5.0, -1.0, "lim"), (6, 5.0, 0.1, "?")], "id long, f double, e double, q string")
    cat = Catalogue(df, ra=None, dec=None, id="id", release_namespace="n")
    base = {"passband": "r", "value_column": "f", "error_column": "e", "unit": "mJy"}
    out = {k: r for k, r in enumerate(observations.normalize_photometry(cat, [base | {"status_column": "q", "status_values": {"ok": "measured", "lim": "upper_limit"}}]).collect(), 1)}
    assert [out[k].status for k in range(1, 7)] == ["measured", "invalid", "invalid", "invalid", "upper_limit", "invalid"]
    assert out[1].flux_jy == pytest.approx(0.01) and out[5].upper_limit_jy == pytest.approx(0.005)
    assert out[4].flags == ["invalid_upper_limit"] and out[5].flags == ["invalid_uncertainty"]
    for wrong in ({"unit": ""}, {"zeropoint_jy": -1}, {"colour": 1}, {"observation_time": 5.0}):
        with pytest.raises(ValueError):
            observations.normalize_photometry(cat, [base | wrong])
    with pytest.raises(ValueError):
        observations.normalize_photometry(cat, [base, base])


def test_hypotheses_are_checked(spark):
    s = spark.createDataFrame([("a",), ("b",)], "source_id string")
    ok = spark.createDataFrame([("a", "x", 0.0), ("a", "y", 1.0)], "source_id string, candidate_id string, log_weight double")
    out = candidates.hypotheses(s, ok, "target")
    total = {r.source_id: r.t for r in out.groupBy("source_id").agg(F.sum("probability").alias("t")).collect()}
    assert total == {"a": pytest.approx(1), "b": pytest.approx(1)} and out.count() == 4
    for rows in ([("c", "x", 0.0)], [("a", "x", float("nan"))], [("a", "x", 0.0)] * 2):
        with pytest.raises(ValueError):
            candidates.hypotheses(s, spark.createDataFrame(rows, ok.schema), "target")


def test_component_deltas(spark):
    schema = "component_id string, input_release_id string, member_id string"
    was = spark.createDataFrame([("p1", "r", "a"), ("p2", "r", "b"), ("p3", "r", "c"), ("p3", "r", "d"), ("p4", "r", "e"), ("p5", "r", "f")], schema)
    now = spark.createDataFrame([("c1", "r", "a"), ("c1", "r", "b"), ("c2", "r", "c"), ("c3", "r", "d"), ("c4", "r", "e"), ("c5", "r", "z")], schema)
    out = {(r.kind, tuple(r.parent_component_ids), tuple(r.current_component_ids)) for r in associations.deltas(now, was).collect()}
    assert out == {("merged", ("p1", "p2"), ("c1",)), ("split", ("p3",), ("c2", "c3")), ("continued", ("p4",), ("c4",)), ("retired", ("p5",), ()), ("created", (), ("c5",))}


def test_releases_fail_closed(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("a", 2)], "id string, n int")
    target = tmp_path / "r"
    made = releases.write_lines(df, target, "schema.v1", "id", {"provenance": {}})
    assert releases.verify_lines(target, "schema.v1", "id") == made and [r["id"] for r in releases.iter_lines(target)] == ["a", "b"]
    with pytest.raises(FileExistsError):
        releases.write_lines(df, target, "schema.v1", "id", {})
    part = next(p for p in sorted((target / "records").glob("part-*")) if b"2" in p.read_bytes())
    part.write_bytes(part.read_bytes().replace(b"2", b"3"))
    with pytest.raises(ValueError):
        releases.verify_lines(target, "schema.v1", "id")
    with pytest.raises(ValueError):
        releases.write_lines(df.unionAll(df), tmp_path / "s", "schema.v1", "id", {})
    made = releases.write_tables({"t": df}, tmp_path / "t", "tables.v1", {})
    assert releases.verify_tables(spark, tmp_path / "t", "tables.v1") == made
    assert digest([1]) != digest([2])
