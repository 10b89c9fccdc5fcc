"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are the shapes of its tokens (runs of lower-case letters, capitals and digits as
``a``, ``A`` and ``0``, other characters as they are, runs cut to three), pairs of neighbouring
shapes, and one term for a token that repeats the one before it.  A token of more than ``PIECE``
characters, or whose shape has more than ``SYMBOLS``, is cut into consecutive pieces, each of which
has a shape of its own, so all of it counts.  Terms get sublinear TF times IDF
(document frequencies over all documents); a truncated singular value decomposition of the labelled
sample's matrix (at most ``PER_CLASS`` rows of each class) gives ``DIMENSIONS`` latent dimensions.

The labelled vectors, whose size has that bound, go to every task; each block of documents is
multiplied with all of them at once, so cosines are exact.  The K nearest vote with weight
cosine ** ``POWER``; isotonic regression on leave-one-out votes turns votes into scores.

Defined cases: null text is empty; texts without a known term, the empty one among them, get a vote
of 0; equal texts get equal scores; ties between examples go to the smaller doc_id; without labels
every score is 0; very long texts are counted whole; null ids stay null and are never learnt from;
repeated rows are each scored; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, lean, only, table
from .voting import PER_CLASS, calibrated, isotonic, labelled_sample

HELD, MOD = 0, 5
K = 25
POWER = 8
DIMENSIONS = 48
TERMS = 1500
SHAPES = 600
THRESHOLD = 0.3
ROWS = 512
MEMO = 300_000
PIECE = 64
SYMBOLS = 12

_runs = re.compile(r"([^\W\d_A-Z])+|([A-Z])+|(\d)+|((.)\5{0,2})\5*", re.S)


def shape(piece: str) -> str:
    """``Ab12!!!!`` gives ``Aa0!!!``."""
    out = []
    for m in _runs.finditer(piece):
        if m[1] or m[2]:
            run = "A" if m[0].isupper() else "a"
            if not out or out[-1] != run:
                out.append(run if len(m[0]) > 1 or run == "a" else "A")
        else:
            out.append("0" if m[3] else m[4])
    return "".join(out)


def token_shapes(token: str) -> Iterator[str]:
    """Shapes of the consecutive pieces of a whole token."""
    for at in range(0, len(token), PIECE):
        whole = shape(token[at : at + PIECE])
        for k in range(0, len(whole), SYMBOLS):
            yield whole[k : k + SYMBOLS]


class Shapes(dict):
    """Numbers of the shapes of tokens' pieces; 0 for shapes that aren't known."""

    def __init__(self, known: list[str]):
        self.place = {s: k + 1 for k, s in enumerate(known)}

    def __missing__(self, token: str) -> tuple[int, ...]:
        out = tuple(self.place.get(s, 0) for s in token_shapes(token))
        if len(token) <= PIECE:  # longer ones rarely come again
            if len(self) >= MEMO:
                self.clear()
            self[token] = out
        return out

    def count(self, text: str | None) -> dict[int, int]:
        """How often each term stands in a text: a shape s as s, a pair as s * (n + 1) + t, a repeat as -1."""
        tokens = (text or "").split()
        if not tokens:
            return {}
        base = len(self.place) + 1
        s = np.fromiter(chain.from_iterable(map(self.__getitem__, tokens)), dtype=np.int64)
        one = np.bincount(s, minlength=base)
        out = {int(k): int(one[k]) for k in one.nonzero()[0]}
        pair, n = np.unique(s[:-1] * base + s[1:], return_counts=True)
        out.update(zip((pair + base).tolist(), n.tolist()))
        if repeats := sum(map(eq, tokens, tokens[1:])):
            out[-1] = repeats
        return out


@dataclass
class Model:
    known: list[str]
    terms: list[int]
    idf: np.ndarray
    axes: np.ndarray
    examples: np.ndarray = field(default_factory=lambda: np.empty((0, 1)))
    labels: np.ndarray = field(default_factory=lambda: np.empty(0))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    ids: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    points: tuple = ()

    def matrix(self, counted: list[dict[int, int]]) -> np.ndarray:
        place = {t: k for k, t in enumerate(self.terms)}
        out = np.zeros((len(counted), len(self.terms)))
        for i, own in enumerate(counted):
            at = [(place[t], n) for t, n in own.items() if t in place]
            if at:
                k, n = zip(*at)
                out[i, list(k)] = 1 + np.log(n)
        out *= self.idf
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def latent(self, counted: list[dict[int, int]]) -> np.ndarray:
        out = self.matrix(counted) @ self.axes
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def vote(self, vectors: np.ndarray, skip: bool = False) -> np.ndarray:
        """Votes of a block; ``skip``: the block is the examples, none of which votes on itself."""
        if not len(self.labels) or not len(vectors):
            return np.zeros(len(vectors))
        cosine = np.round(vectors @ self.examples.T, 10)
        if skip:
            np.fill_diagonal(cosine, -2)
        k = min(K, cosine.shape[1])
        # ties go to the smaller id, and examples are in the order of ids
        key = cosine - np.arange(cosine.shape[1]) * 1e-14
        near = np.argpartition(-key, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** POWER * self.weights[near]
        total = w.sum(1)
        return np.where(total > 0, (w * self.labels[near]).sum(1) / np.maximum(total, 1e-300), 0.0)


def _batches(docs: DataFrame, known: list[str], emit, schema: str, *columns: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes(known)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                yield emit(part, [shapes.count(text.as_py()) for text in part.column("text")])

    return only(docs, *columns, "text").mapInArrow(lean(run), schema)


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", held: int = HELD, mod: int = MOD, per_class: int = PER_CLASS) -> Model:
    sample, weight = labelled_sample(docs, labels, label, held, mod, per_class)

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                own = sorted({s for t in set((text.as_py() or "").split()) for s in token_shapes(t)})
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string())], ["shape"])

    common = only(sample, "text").mapInArrow(lean(shapes), "shape string").groupBy("shape").count().orderBy(F.desc("count"), "shape").limit(SHAPES)
    known = sorted(r.shape for r in common.collect())

    def counts(part: pa.RecordBatch, counted: list[dict[int, int]]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        own = [part.column("doc_id"), part.column("label"), [list(c) for c in counted], [list(c.values()) for c in counted]]
        return pa.RecordBatch.from_arrays([x.cast(t) if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(own, kinds)], ["doc_id", "label", "terms", "counts"])

    # 2 * per_class rows of at most (SHAPES + 2) ** 2 pairs, in truth a few hundred each
    rows = sorted(_batches(sample, known, counts, "doc_id long, label int, terms array<long>, counts array<long>", "doc_id", "label").collect(), key=lambda r: r.doc_id)
    counted = [dict(zip(r.terms, r.counts)) for r in rows]
    held_by: dict[int, int] = {}
    for own in counted:
        for t in own:
            held_by[t] = held_by.get(t, 0) + 1
    terms = sorted(sorted(held_by, key=lambda t: (-held_by[t], t))[:TERMS])
    n_docs, frequency = document_frequencies(docs, known, terms)
    idf = np.log((n_docs + 1) / (frequency + 1)) + 1
    model = Model(known, terms, idf, np.empty((len(terms), 0)))
    if rows:
        m = model.matrix(counted)
        values, vectors = np.linalg.eigh(m.T @ m)
        model.axes = vectors[:, ::-1][:, : min(DIMENSIONS, len(terms))]
        model.examples = model.latent(counted)
        model.labels = np.asarray([r.label for r in rows], dtype=float)
        model.weights = np.asarray([weight[r.label] for r in rows])
        model.ids = np.asarray([r.doc_id for r in rows])
        model.points = isotonic(model.vote(model.examples, True), model.labels, model.weights)
    else:
        model.points = (np.asarray([0.0, 1.0]), np.asarray([0.0, 0.0]))
    return model


def document_frequencies(docs: DataFrame, known: list[str], terms: list[int]) -> tuple[int, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, place = Shapes(known), {t: k for k, t in enumerate(terms)}
        total = np.zeros(len(terms) + 1, dtype=np.int64)
        for batch in batches:
            total[-1] += batch.num_rows
            for text in batch.column("text"):
                total[[place[t] for t in shapes.count(text.as_py()) if t in place]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "n"])

    rows = only(docs, "text").mapInArrow(lean(run), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(len(terms) + 1)
    for r in rows:
        total[r.place] = r.n
    return int(total[-1]), total[:-1]


def score(docs: DataFrame, model: Model) -> DataFrame:
    def emit(part: pa.RecordBatch, counted: list[dict[int, int]]) -> pa.RecordBatch:
        raw = model.vote(model.latent(counted)) if len(model.labels) else np.zeros(len(counted))
        return pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(calibrated(raw, model.points))], ["doc_id", "score"])

    return _batches(docs, model.known, emit, "doc_id long, score double", "doc_id")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), MOD) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
