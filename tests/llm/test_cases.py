"""Defined cases of every operator and stage: nulls, null ids, repeated rows, ties, very long texts, clashing columns, empty tables."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from skyzone.llm import graph_ann, media, mixing, near_dup, packing, quality, secrets, toxicity, url_filter, voting, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ("score", "label", "p", "digest", "held_out", "letters", "tokens", "band", "s", "key", "v", "spans", "base", "all", "by", "kept", "piece", "offset", "_slot0", "_copy", "domain", "rate", "own", "recipe")


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    rows = [(i, " ".join(word() if rng.random() > (i % 5 == 0) * 0.2 else "moron" for _ in range(40)), ["en", "fr"][i % 2], "s", 0) for i in range(200)]
    long = " ".join(word() for _ in range(60_000))
    rows += [(1000, long, "en", "s", 0), (1001, "x" * 400_000, None, None, None), (1002, None, "en", "s", 0), (1003, "", "en", "s", 0)]
    rows += [rows[7], rows[7], (None, "a row without an id", "en", "s", 0), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(200)] + [(None, 1, 1), (5, None, None), (7, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    for c in NAMES:
        docs, labels = docs.withColumn(c, F.lit("clash")), labels.withColumn(c, F.lit("clash"))
    return docs, labels.withColumn("text", F.lit("clash")), len(rows)


RUNS = {
    "toxicity": lambda d, l: toxicity.score(d, toxicity.train(d, l)),
    "media": lambda d, l: media.read_back(*media.store(d)),
    "near_dup": lambda d, l: near_dup.near_duplicates(d, 5),
    "secrets": lambda d, l: secrets.scan(d, secrets.train(secrets.labelled_sample(d))),
    "mixing": lambda d, l: mixing.mix(d, mixing.labelled_by_language(d)),
    "quality": lambda d, l: quality.score(d, quality.train(d, l)),
}


@pytest.mark.parametrize("name", RUNS)
def test_every_row_has_one_result_and_equal_rows_equal_ones(tables, name):
    docs, labels, n = tables
    rows = RUNS[name](docs, labels).collect()
    assert len(rows) == n and sum(r.doc_id is None for r in rows) == 2
    same = [tuple(map(str, r)) for r in rows if r.doc_id == 7]
    assert len(same) == 3 and len(set(same)) == 1
    assert {1000, 1001, 1002, 1003} <= {r.doc_id for r in rows}


@pytest.mark.parametrize("name", RUNS)
def test_no_rows_give_no_rows(tables, name):
    docs, labels, _ = tables
    none = docs.where("false")
    assert RUNS[name](none, labels).count() == 0 and RUNS[name](none, labels.where("false")).count() == 0


def test_packing_of_odd_rows(tables):
    docs, _, n = tables
    rows = packing.pack_documents(docs).collect()
    assert sum(r.piece == 0 for r in rows) == n and sum(r.length == 1 and r.start == 0 for r in rows) == 3
    places = [(r.sequence_id, r.offset) for r in rows]
    assert len(set(places)) == len(places)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_keep_columns_and_take_odd_and_no_rows(spark, tables, tmp_path, name, stage):
    docs, labels, n = tables
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = stage(spark, docs, str(tmp_path))
    rows = out.count()
    if name != "packing":
        assert out.dtypes == docs.dtypes
        assert rows >= n - 45 and {r.doc_id for r in out.where("doc_id >= 1000").select("doc_id").collect()} == {1000, 1001, 1002, 1003}
    assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    lone = docs.where("doc_id = 1002")
    assert stage(spark, lone, str(tmp_path)).count() == 1


def test_ties_of_examples_go_to_smaller_ids(spark):
    rows = [(i, "moron scum words here") for i in range(40)] + [(i, "plain words here now") for i in range(40, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 40), int(i < 40)) for i, _ in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    bad = {tuple(r.evidence) for r in toxicity.score(docs, model).where("doc_id < 40").collect()}
    own = sorted(i for i in range(40) if not toxicity.held_out(i))
    assert bad == {tuple(own[:3])}
    assert len({r.score for r in quality.score(docs, quality.train(docs, labels)).where("doc_id < 40").collect()}) == 1


def test_sample_leaves_out_held_rows_and_null_ids(tables):
    docs, labels, _ = tables
    sample, weight = voting.labelled_sample(docs, labels, "toxic", 1, 3)
    ids = [r.doc_id for r in sample.collect()]
    assert len(ids) == len(set(ids)) and None not in ids and not any(toxicity.held_out(i) for i in ids) and set(weight) == {0, 1}


def test_pages_with_clashing_columns_repeats_and_null_ids(spark):
    rows = [(1, "http://a.org/x", "<p>"), (1, "http://a.org/x", "<p>"), (None, "http://a.com/fr/", None), (2, None, "y" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("won", "host", "path", "rule", "verdict", "sha", "first", "file", "offset", "length", "refers_to"):
        pages = pages.withColumn(c, F.lit("clash"))
    known = url_filter.ruled(pages)
    assert sorted(str(r.page_id) for r in url_filter.verdicts(known, url_filter.train(url_filter.labelled(known))).collect()) == ["1", "1", "2", "None"]
    back = warc.read_records(warc.write_archives(pages)).collect()
    assert sorted((str(r.page_id), r.record_type) for r in back) == [("1", "response"), ("1", "response"), ("2", "response"), ("None", "response")]


def test_vectors_with_clashing_columns_and_repeats(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (None, [1.0, 0.0]), (2, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in ("key", "size", "v", "cell", "part", "block", "ids", "rank", "score", "query_id"):
        df = df.withColumn(c, F.lit("clash"))
    assert [(r.query_id, r["rank"], r.vec_id) for r in graph_ann.nearest(df).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
