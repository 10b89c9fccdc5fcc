"""What the two neighbour-voting classifiers share: a bounded labelled sample and calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, only, stored

#: Most labelled rows of each class that a model learns from, those whose ids hash lowest.
PER_CLASS = 1500


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held: int, mod: int, per_class: int = PER_CLASS) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, label, text) of at most ``per_class`` rows of each class, and each class's weight.

    Rows whose crc32(doc_id as text) mod ``mod`` is ``held`` are left out.  A weight is the share of
    the class among all labelled rows that may be learnt from over its share of the sample, so votes
    keep the labelled table's proportions.  Repeated labels of a document count once, the larger.
    """
    known = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (crc_mod(F.col("doc_id"), mod) != held))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    totals = {r.label: r["count"] for r in known.groupBy("label").count().collect()}  # two rows at most
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * per_class rows of 12 bytes, so this side is small however many labels there are
    text = only(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")
    text = text.groupBy("doc_id", "label").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    taken = {v: max(1, min(per_class, totals.get(v, 0))) for v in (0, 1)}
    return stored(text, "labelled"), {v: totals.get(v, 0) / taken[v] for v in (0, 1)}


def isotonic(raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the monotone map from raw votes to shares of label 1 (pool adjacent violators)."""
    if not len(raw):
        return np.asarray([0.0, 1.0]), np.asarray([0.0, 1.0])
    order = np.lexsort((label, raw))
    pools: list[list[float]] = []
    for x, y, w in zip(raw[order], label[order], weight[order]):
        if pools and pools[-1][3] == x:
            pools[-1][0] += y * w
            pools[-1][1] += w
        else:
            pools.append([y * w, w, x, x])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a = pools.pop()
            pools[-1] = [pools[-1][0] + a[0], pools[-1][1] + a[1], pools[-1][2], a[3]]
    xs, ys = [0.0], [pools[0][0] / pools[0][1]]
    for s, w, lo, hi in pools:
        for x in (lo, hi):
            if x > xs[-1]:
                xs.append(x)
                ys.append(s / w)
            else:
                ys[-1] = s / w
    if xs[-1] < 1.0:
        xs.append(1.0)
        ys.append(ys[-1])
    return np.asarray(xs), np.asarray(ys)


#: Share of the raw vote in a calibrated score, which keeps the order within a pool.
BLEND = 0.05


def calibrated(raw: np.ndarray, points: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.clip((1 - BLEND) * np.interp(raw, *points) + BLEND * raw, 0.0, 1.0)
