"""What must not grow faster than the input: passes over it, rounds, broadcasts, files and what one task holds."""

import pytest
from pyspark.sql import functions as F

from skyzone import shared
from skyzone.catalogue import Catalogue
from skyzone.operators import associations, candidates, components, releases
from skyzone.operators.match import match
from skyzone.operators.zonejoin import Zones
from skyzone.sources import files, mirror, tiles
from skyzone.sources.storage import Storage
from skyzone.specs import MatchSpec

RECORD = "component_id string, input_release_id string, member_id string"


def counted(spark, df, by):
    """The rows, and how often one has been made."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def pass_on(x):
        made.add(1)
        return x

    return df.withColumn(by, pass_on.asNondeterministic()(F.col(by))), made


def test_stars_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "_star", None)
    edges = spark.createDataFrame([(1, 2), (3, 1), (4, 5), (9, 9)], "a long, b long")
    assert {tuple(r) for r in components.connected_components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}


def test_rounds_go_on_with_what_is_no_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (100, 102), (201, 200), (202, 201)]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100), **dict.fromkeys((200, 201, 202), 200)}


def test_components_are_made_once_for_their_deltas(spark):
    was = spark.createDataFrame([("p1", "r", "a"), ("p2", "r", "b"), ("p3", "r", "c")], RECORD)
    now, made = counted(spark, spark.createDataFrame([("c1", "r", "a"), ("c1", "r", "b"), ("c4", "r", "z")], RECORD), "member_id")
    assert {(r.kind) for r in associations.deltas(now, was).collect()} == {"merged", "retired", "created"}
    assert made.value == 3


def test_only_measured_sides_are_broadcast(spark):
    df = spark.createDataFrame([(1, 10.0, 0.0), (2, 20.0, 0.0)], "id long, ra double, dec double")
    cats = [Catalogue(df, ra="ra", dec="dec", id="id", release_namespace=n) for n in "ab"]
    counts = candidates.candidate_counts(cats, candidates.candidate_pairs(cats, 1.0))
    assert "Broadcast" not in counts._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.candidate_count for r in counts.collect()) == [1, 1, 1, 1]


def test_what_is_read_again_is_made_once(spark):
    rows = spark.range(4)
    assert shared.settled(rows.withColumn("x", F.col("id") + 1).where("x > 0"))._jdf.queryExecution().optimizedPlan().toString().startswith(("Project", "Filter", "Range"))
    assert "Relation" in shared.settled(rows.groupBy("id").count())._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_a_release_are_made_once(spark, tmp_path):
    rows, made = counted(spark, spark.createDataFrame([("b", 1), ("a", 2), ("c", 3)], "id string, n int"), "id")
    releases.write_lines(rows, tmp_path / "r", "lines.v1", "id", {})
    assert made.value == 3 and releases.order_of(tmp_path / "r", "id") == (3, 0)
    rows, made = counted(spark, spark.createDataFrame([("a1", "p", "c", 0.5)], "evidence_id string, source_id string, candidate_id string, separation_arcsec double"), "source_id")
    own = {"method": F.lit("m"), "method_version": F.lit("1"), "evaluation_epoch_jyear": F.lit(2016.0), "decision": F.lit("selected"), "score_name": F.lit("s"), "score_value": F.lit(0.5), "score_semantics": F.lit("ranking_score"), "calibration_id": F.lit(None).cast("string"), "flags": F.array().cast("array<string>")}
    releases.write_associations(rows.withColumns(own), tmp_path / "a", {"input_release_ids": ["a", "b"]})
    assert made.value == 1 and releases.verify_associations(tmp_path / "a")["record_count"] == 1
    with pytest.raises(ValueError):
        releases.write_associations(rows.withColumns(own | {"decision": F.lit("maybe")}), tmp_path / "b", {"input_release_ids": ["a", "b"]})
    for bad in ([("a", 1), ("a", 2)], [(None, 1), ("a", 2)]):
        with pytest.raises(ValueError):
            releases.write_lines(spark.createDataFrame(bad, "id string, n int"), tmp_path / "c", "lines.v1", "id", {})
        assert not (tmp_path / "c").exists()


def test_parts_that_a_task_reads_whole_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(releases, "PART_ROWS", 10)
    monkeypatch.setattr(releases, "PART_LINES", 10)
    made = releases.write_tables({"t": spark.range(95).coalesce(1)}, tmp_path / "t", "t.v1", {})
    assert len(made["files"]["t"]["sha256"]) == 10 and releases.verify_tables(spark, tmp_path / "t", "t.v1") == made
    made = releases.write_lines(spark.range(200), tmp_path / "l", "l.v1", "id", {})
    assert max(p["records"] for p in made["parts"].values()) < 40 and made["record_count"] == 200


def test_rows_without_partners_do_not_share_a_task(spark):
    rows = spark.range(2000)
    cats = [Catalogue(rows.select("id", (F.col("id") % 360).cast("double").alias("ra"), (F.lit(z) + (F.col("id") / 360).cast("int")).cast("double").alias("dec")), ra="ra", dec="dec", id="id") for z in (-50, 10)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled",)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = match(*cats, MatchSpec(radius_arcsec=1.0, join_type="1or2"))
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 4000 and max(sizes) < 1500


def test_crowded_poles_have_many_cells(spark):
    ring = spark.range(640).select((F.col("id") * 0.5625).alias("ra"), F.lit(89.9).alias("dec"))
    zones = Zones(0.0343)
    assert zones.one(ring, "ra", "dec").groupBy("_zone", "_cell").count().agg(F.max("count")).first()[0] == 10
    assert zones.reached(ring, "ra", "dec").groupBy("ra").count().agg(F.max("count")).first()[0] < 12


def test_many_files_are_copied_by_tasks(spark, tmp_path, monkeypatch):
    source, target = tmp_path / "s", tmp_path / "t"
    (source / "dataset").mkdir(parents=True)
    for k in range(60):
        (source / "dataset" / f"{k}.bin").write_bytes(bytes([k]) * k)
    (source / "properties").write_text("a=1")
    by_hand = []
    monkeypatch.setattr(Storage, "copy", lambda self, a, b, copy=Storage.copy: by_hand.append(a) or copy(self, a, b))
    made = mirror.sync(spark, str(source), str(target))
    assert len(by_hand) == 1 and len(made.copied) == 61 and not made.failed
    assert all((target / "dataset" / f"{k}.bin").read_bytes() == bytes([k]) * k for k in range(60))
    assert not mirror.sync(spark, str(source), str(target)).copied


def test_whole_folders_of_tiles_are_read_as_folders(spark, tmp_path, monkeypatch):
    df = spark.range(3000).select("id", (F.col("id") * 0.12).alias("ra"), F.lit(5.0).alias("dec"))
    tiles.write(df, str(tmp_path / "c.hats"), "ra", "dec", threshold=100)
    monkeypatch.setattr(tiles, "_paths", None)
    assert tiles.read(spark, str(tmp_path / "c.hats")).agg(F.sum("id")).first()[0] == 3000 * 2999 // 2


def test_fits_rows_do_not_go_through_the_driver(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, 0.5, "ä", True, 3), (2, None, None, None, None)], "a long, b double, c string, d boolean, e tinyint").repartition(2)
    monkeypatch.setattr(type(df), "toLocalIterator", None)
    files.write(df, str(tmp_path / "x.fits"))
    monkeypatch.undo()
    assert sorted((r.a, r.c, r.d, r.e) for r in files.read(spark, str(tmp_path / "x.fits")).collect()) == [(1, "ä", True, 3), (2, "", None, None)]
