"""The pipeline's stages, each on its own input, and the whole run."""

import random

import corpus_pipeline
import pytest

from skyzone.llm import near_dup


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    d = tmp_path_factory.mktemp("tables")
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    rows, labels = [], []
    for i in range(240):
        w = [word() for _ in range(rng.randrange(30, 120))]
        toxic = i % 6 == 0
        if toxic:
            for k in rng.sample(range(len(w)), len(w) // 6):
                w[k] = rng.choice(("idiot", "moron", "scum"))
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    rows.append((500, rows[1][1], "en", "s", 0))
    rows.append((501, 'a token = "0123456789abcdef0123456789abcdef" here', "en", "s", 0))
    rows += [(502, None, None, None, None), (503, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, folder)
    ids = {r.doc_id for r in clean.collect()}
    assert {i for i in range(240) if i % 6} <= ids and len(ids & set(range(0, 240, 6))) <= 2 and {501, 502, 503} <= ids
    one = stages["near_dedup"](spark, docs, folder)
    assert {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in one.select("doc_id").collect()} == {500}
    safe = {r.doc_id: r.text for r in stages["secrets"](spark, docs, folder).collect()}
    assert safe[501] == "a [SECRET] here".replace("[SECRET] here", '[SECRET]" here') and safe[1] == {r.doc_id: r.text for r in docs.collect()}[1] and safe[502] is None
    mixed = stages["mixing"](spark, docs, folder)
    assert {r.doc_id for r in mixed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    for name in ("toxicity", "near_dedup", "secrets", "mixing"):
        assert stages[name](spark, docs, folder).dtypes == docs.dtypes
    assert stages["packing"](spark, docs, folder).select("doc_id").distinct().count() == docs.count()


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    ids = {r.doc_id for r in out.collect()}
    assert 1 in ids and 500 not in ids and {502, 503} & ids
    assert near_dup.near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"), 5).where("doc_id = 500").first().component_id == 1
