"""The corpus pipeline: toxicity, near-duplicates, secrets, mixing, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame
that is written as Parquet and read again as the next one's ``docs``.  ``run`` applies them to the
table ``documents``.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyzone.llm import mixing, near_dup, packing, secrets, toxicity
from skyzone.llm.common import table
from skyzone.shared import fresh

# Neither vote nor packing can be written in SQL; tests hold them against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked on five-word shingles at 0.8, the document of the smallest id stays."""
    return near_dup.keep_one(docs, n=5, threshold=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced by a mark; no document goes."""
    return secrets.redact_documents(docs, secrets.train(secrets.labelled_sample(docs)))


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of languages below their target share are repeated; none goes."""
    fitted, _ = mixing.fit(docs, mixing.labelled_by_language(docs), least=1.0)
    return mixing.resampled(docs, fitted)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences."""
    return packing.pack_documents(docs).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_languages),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = fresh(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
