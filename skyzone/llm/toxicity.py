"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are words and their leading 4 to 8 letters.  The vocabulary is selected, not capped: it holds
every term that at least ``LEAST_DOCS`` toxic examples of a bounded labelled sample (``PER_CLASS`` of
each class) have and that a two-sample test finds more often in them (z of ``LEAST_Z`` or more).
Document frequencies for the IDF come from all documents.  All other words together are one more
dimension, ``BULK`` times the number of words, so that a cosine compares rates and not mere presence.

Examples lie in an inverted index in blocks of ``BLOCK``; each term keeps its largest weight in each
block.  A query sums these maxima into bounds, scores blocks exactly in falling order of bound, and
stops when no bound reaches its K-th best cosine: the neighbours are exact.  They vote with weight
1 / (distance + ``SOFT``); isotonic regression on leave-one-out votes turns votes into scores.

Defined cases: null and empty texts get the score of a vote of 0; texts without any term of the
vocabulary are equal queries; equal texts get equal scores; ties between examples go to the smaller
doc_id; without labels every score is 0; very long texts are counted whole; null ids stay null and are
never learnt from; repeated rows are each scored; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, only, table
from .voting import PER_CLASS, calibrated, isotonic, labelled_sample

HELD, MOD = 1, 3
K = 25
BLOCK = 64
BULK = 0.05
SOFT = 0.02
THRESHOLD = 0.7
LEAST_Z = 5.0
LEAST_DOCS = 4
MEMO = 150_000
PREFIXES = range(4, 9)

_words = re.compile(r"[^\W\d_]+").findall


def terms_of(word: str) -> list[str]:
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) >= n)]


class Vocabulary(dict):
    """Places of a word's terms in the vocabulary, remembered by word."""

    def __init__(self, terms: list[str]):
        self.place = {t: k for k, t in enumerate(terms)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= MEMO:
            self.clear()
        out = self[word] = tuple(p for t in terms_of(word) if (p := self.place.get(t)) is not None)
        return out

    def count(self, text: str | None) -> tuple[int, Counter]:
        """Number of words, and how often each term stands in the text."""
        words = _words((text or "").lower())
        return len(words), Counter(p for hit in filter(None, map(self.__getitem__, words)) for p in hit)


class BlockMaxIndex:
    """Exact cosine search over sparse unit vectors; dimensions are numbered from 0."""

    def __init__(self, vectors: list[dict[int, float]], block: int = BLOCK):
        self.n, self.block = len(vectors), block
        self.blocks = -(-self.n // block)
        by_term: dict[int, list[tuple[int, float]]] = {}
        for example, vector in enumerate(vectors):
            for t, w in vector.items():
                by_term.setdefault(t, []).append((example, w))
        self.postings = {}
        for t, own in by_term.items():
            ids, weights = np.asarray([x for x, _ in own]), np.asarray([w for _, w in own])
            most = np.zeros(self.blocks)
            np.maximum.at(most, ids // block, weights)
            self.postings[t] = (ids, weights, ids // block, most)

    def _scores(self, own: list, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Examples of the chosen blocks and their exact cosines."""
        acc = np.zeros(self.blocks * self.block)
        for w, ids, weights, blocks, _ in own:
            there = chosen[blocks]
            acc[ids[there]] += w * weights[there]
        here = np.flatnonzero(np.repeat(chosen, self.block)[: self.n])
        return here, acc[here]

    def search(self, query: dict[int, float], k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k best examples but ``skip``, best first, ties to the smaller."""
        own = [(w, *self.postings[t]) for t, w in query.items() if t in self.postings]
        bound = np.zeros(self.blocks)
        for w, _, _, _, most in own:
            bound += w * most
        order = np.argsort(-bound, kind="stable")
        ids, scores, least, at, step = np.empty(0, dtype=np.int64), np.empty(0), -np.inf, 0, -(-(k + 1) // self.block)
        while at < len(order) and bound[order[at]] >= least - 1e-12:
            # the blocks of largest bounds first, then all others that can still hold a neighbour
            end = at + step if len(ids) < k else int(np.searchsorted(-bound[order], -(least - 1e-12), side="right"))
            chosen = np.zeros(self.blocks, dtype=bool)
            chosen[order[at:end]] = True
            here, found = self._scores(own, chosen)
            ids, scores, at = np.concatenate([ids, here[here != skip]]), np.concatenate([scores, found[here != skip]]), end
            best = np.lexsort((ids, -np.round(scores, 12)))[:k]
            ids, scores = ids[best], scores[best]
            if len(ids) == k:
                least = scores[-1]
        return ids, scores


@dataclass
class Model:
    terms: list[str]
    idf: list[float]
    examples: list[int]
    labels: list[int]
    weights: list[float]
    vectors: list[dict[int, float]]
    points: tuple = ()
    k: int = K
    _index: BlockMaxIndex | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_index": None}

    def unit(self, n: int, counts: dict[int, int]) -> dict[int, float]:
        out = {t: c * self.idf[t] for t, c in sorted(counts.items())}
        if n:
            out[len(self.terms)] = BULK * n
        norm = math.sqrt(sum(w * w for w in out.values()))
        return {t: w / norm for t, w in out.items()} if norm else {}

    def vote(self, vector: dict[int, float], skip: int = -1) -> tuple[float, list[int]]:
        if self._index is None:
            self._index = BlockMaxIndex(self.vectors)
        if not vector or not self.vectors:
            return 0.0, []
        ids, cosines = self._index.search(vector, self.k, skip)
        near = 1.0 / (np.sqrt(np.maximum(2 - 2 * np.round(cosines, 12), 0)) + SOFT) * np.asarray(self.weights)[ids]
        total = near.sum()
        return (float(near @ np.asarray(self.labels)[ids] / total) if total else 0.0), ids[:3].tolist()

    def calibrate(self) -> None:
        raw = np.asarray([self.vote(v, i)[0] for i, v in enumerate(self.vectors)])
        self.points = isotonic(raw, np.asarray(self.labels, dtype=float), np.asarray(self.weights))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", held: int = HELD, mod: int = MOD, per_class: int = PER_CLASS) -> Model:
    sample, weight = labelled_sample(docs, labels, label, held, mod, per_class)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                lists = [sorted({t for w in set(_words((text or "").lower())) for t in terms_of(w)}) for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("label").cast(pa.int32()), pa.array(lists, pa.list_(pa.string()))], ["label", "terms"])

    seen = sample.mapInArrow(lean(terms), "label int, terms array<string>").select("label", F.explode("terms").alias("term"))
    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    chosen: list[str] = []
    if bad and good:
        counts = seen.groupBy("term").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
        pooled = (F.col("a") + F.col("b")) / (bad + good)
        z = (F.col("a") / bad - F.col("b") / good) / F.sqrt(pooled * (1 - pooled) * (1 / bad + 1 / good) + 1e-12)
        # terms of at least LEAST_DOCS of per_class toxic examples, so their number is bounded by the sample's
        chosen = sorted(r.term for r in counts.where((F.col("a") >= LEAST_DOCS) & (z >= LEAST_Z)).select("term").collect())
    n_docs, frequency = document_frequencies(docs, chosen)
    idf = [math.log((n_docs + 1) / (frequency.get(k, 0) + 1)) + 1 for k in range(len(chosen))]
    model = Model(chosen, idf, [], [], [], [])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(chosen)
        for batch in batches:
            made = [vocabulary.count(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("label").cast(pa.int32()), pa.array([n for n, _ in made], pa.int64()), pa.array([sorted(c) for _, c in made], pa.list_(pa.int32())), pa.array([[c[t] for t in sorted(c)] for _, c in made], pa.list_(pa.int32()))],
                ["doc_id", "label", "n", "terms", "counts"],
            )

    # 2 * per_class rows of at most as many pairs as there are chosen terms
    rows = sorted(sample.mapInArrow(lean(vectors), "doc_id long, label int, n long, terms array<int>, counts array<int>").collect(), key=lambda r: r.doc_id)
    for r in rows:
        model.examples.append(r.doc_id)
        model.labels.append(r.label)
        model.weights.append(weight[r.label])
        model.vectors.append(model.unit(r.n, dict(zip(r.terms, r.counts))))
    model.calibrate()
    return model


def document_frequencies(docs: DataFrame, terms: list[str]) -> tuple[int, dict[int, int]]:
    """Number of documents, and of those that hold each term, over the whole table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, total = Vocabulary(terms), np.zeros(len(terms) + 1, dtype=np.int64)
        for batch in batches:
            total[-1] += batch.num_rows
            for text in batch.column(0):
                total[list(vocabulary.count(text.as_py())[1])] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["place", "n"])

    rows = only(docs, "text").mapInArrow(lean(count), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    found = {r.place: r.n for r in rows}
    return found.pop(len(terms), 0), found


def _scorer(model: Model):
    vocabulary, memo = Vocabulary(model.terms), {}

    def score(text: str | None) -> tuple[float, list[int]]:
        n, counts = vocabulary.count(text)
        key = (n if counts else bool(n), tuple(sorted(counts.items())))
        found = memo.get(key)
        if found is None:
            if len(memo) > 50_000:
                memo.clear()
            raw, ids = model.vote(model.unit(key[0], counts))
            memo[key] = found = (float(calibrated(np.asarray(raw), model.points)), [model.examples[i] for i in ids])
        return found

    return score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and evidence (the ids of the three nearest examples)."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scorer(model)
        for batch in batches:
            made = [of(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([s for s, _ in made], pa.float64()), pa.array([e for _, e in made], pa.list_(pa.int64()))], ["doc_id", "score", "evidence"])

    return only(docs, "doc_id", "text").mapInArrow(lean(scored), "doc_id long, score double, evidence array<long>")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scorer(model)
        at = None
        for batch in batches:
            at = batch.schema.get_field_index("text") if at is None else at
            yield batch.filter(pa.array([of(text.as_py())[0] < threshold for text in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(lean(kept), docs.schema)


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % MOD == HELD


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    from .common import crc_mod

    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), MOD) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
