"""URL filters: rules first, then gradient-boosted trees on lexical features.

A rule has a verdict, a host and a path.  It fits a URL whose host is the rule's or a subdomain of it
and whose path starts with the rule's; of the fitting rules the longest wins (of equally long ones a
block, then the alphabetically first).  URLs that no rule fits get the trees' verdict.

The trees read lengths, depth, digit ratio, entropy, parameter counts and statistics of the host's
last one and two labels.  They are trained from labelled URLs, by default those that the rules
decide, at most ``PER_CLASS`` of each verdict (those whose URLs hash lowest): Newton boosting of
logistic loss over quantile bins on the driver, whose size has that bound.  Suffix statistics are
smoothed shares of blocked labels, in training those of the other folds.

Defined cases: null URLs and URLs without ``://`` have empty host and path and fit no rule; equal
URLs get equal verdicts; with labels of one class or none the verdict is that class, or allow; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lowest, only

# The rules (verdict, host, path) of the registered query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
PER_CLASS = 5000
TREES = 40
DEPTH = 3
LEARN = 0.2
BINS = 32
PENALTY = 1.0
SMOOTH = 5.0
FOLDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.substring_index(_after(url), "/", 1)
    return F.translate(F.substring_index(F.substring_index(rest, "?", 1), "#", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(name, verdict) of the winning rule, or null."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for verdict, h, p in reversed(order):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)) & (host != "")
        out = F.when(fits, F.struct(F.lit(h + p).alias("name"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def ruled(pages: DataFrame, rules=RULES, id_col: str = "page_id") -> DataFrame:
    """id, url, host, path and the winning rule of every row."""
    own = only(pages, id_col, "url").withColumn("url", F.coalesce("url", F.lit("")))
    own = own.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    return own.withColumn("won", rule_of(F.col("host"), F.col("path"), rules))


def suffixes(host: str) -> tuple[str, str]:
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:])


def lexical(url: str, host: str, path: str) -> list[float]:
    n = len(url)
    counts = Counter(url)
    query = url.partition("?")[2].partition("#")[0]
    parts = [p for p in path.split("/") if p]
    return [
        n,
        len(host),
        len(path),
        len(parts),
        host.count("."),
        sum(c.isdigit() for c in url) / n if n else 0.0,
        sum(c.isdigit() for c in host) / len(host) if host else 0.0,
        -sum(k / n * math.log2(k / n) for k in counts.values()) if n else 0.0,
        sum(1 for x in query.split("&") if x),
        url.count("="),
        host.count("-"),
        url.count("%"),
        float("#" in url),
        float(url.startswith("https://")),
        max(map(len, parts), default=0),
        max(map(len, host.split("."))),
        float(path.endswith("/")),
    ]


@dataclass
class Boosted:
    """Trees over the lexical features and two suffix statistics."""

    prior: float = 0.0
    suffix: dict[str, tuple[float, int]] = field(default_factory=dict)
    trees: list[list[tuple[int, float, float]]] = field(default_factory=list)
    base: float = -math.inf

    def share(self, name: str, less: dict[str, tuple[float, int]] | None = None) -> float:
        bad, n = self.suffix.get(name, (0.0, 0))
        if less is not None:
            own = less.get(name, (0.0, 0))
            bad, n = bad - own[0], n - own[1]
        return (bad + SMOOTH * self.prior) / (n + SMOOTH)

    def features(self, url: str, host: str, path: str, less: dict[str, tuple[float, int]] | None = None) -> list[float]:
        return [*lexical(url, host, path), *(self.share(s, less) for s in suffixes(host))]

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of block; a tree is a heap of (feature, threshold, value), feature -1 at leaves."""
        out = np.full(len(x), self.base)
        for tree in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            f, t, v = (np.asarray(c) for c in zip(*tree))
            for _ in range(DEPTH):
                inner = f[at] >= 0
                right = x[np.arange(len(x)), np.maximum(f[at], 0)] > t[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            out += v[at]
        return out


def _tree(binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> list[tuple[int, float, float]]:
    """One tree by best gain over bins; ``binned`` holds each value's bin."""
    size = 2 ** (DEPTH + 1) - 1
    out = [(-1, 0.0, 0.0)] * size
    rows = {0: np.arange(len(g))}
    for node in range(size):
        own = rows.pop(node, None)
        if own is None:
            continue
        gs, hs = g[own].sum(), h[own].sum()
        out[node] = (-1, 0.0, float(-LEARN * gs / (hs + PENALTY)))
        if 2 * node + 2 >= size:
            continue
        best = (1e-6, -1, -1)
        for f in range(binned.shape[1]):
            gl = np.cumsum(np.bincount(binned[own, f], g[own], BINS + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[own, f], h[own], BINS + 1))[:-1]
            gain = gl**2 / (hl + PENALTY) + (gs - gl) ** 2 / (hs - hl + PENALTY) - gs**2 / (hs + PENALTY)
            gain[(hl < 1e-3) | (hs - hl < 1e-3)] = -1
            k = int(gain[: len(edges[f])].argmax()) if len(edges[f]) else 0
            if len(edges[f]) and gain[k] > best[0]:
                best = (float(gain[k]), f, k)
        if best[1] >= 0:
            _, f, k = best
            out[node] = (f, float(edges[f][k]), 0.0)
            right = binned[own, f] > k
            rows[2 * node + 1], rows[2 * node + 2] = own[~right], own[right]
    return out


def boost(rows: list[tuple[str, str, str, int]]) -> Boosted:
    """Train from (url, host, path, blocked)."""
    y = np.asarray([r[3] for r in rows], dtype=float)
    if not len(y):
        return Boosted()
    model = Boosted(prior=float(y.mean()))
    folds: list[dict[str, tuple[float, int]]] = [{} for _ in range(FOLDS)]
    for url, host, _, label in rows:
        for counts in (model.suffix, folds[zlib.crc32(url.encode()) % FOLDS]):
            for s in suffixes(host):
                bad, n = counts.get(s, (0.0, 0))
                counts[s] = (bad + label, n + 1)
    if y.min() == y.max():
        model.base = math.inf if y[0] else -math.inf
        return model
    x = np.asarray([model.features(u, h, p, folds[zlib.crc32(u.encode()) % FOLDS]) for u, h, p, _ in rows])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    model.base = math.log(model.prior / (1 - model.prior))
    raw = np.full(len(y), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        tree = _tree(binned, edges, p - y, p * (1 - p))
        model.trees.append(tree)
        raw += Boosted(base=0.0, trees=[tree]).raw(x)
    return model


def labelled(known: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(url, host, path, blocked) of at most ``per_class`` different URLs of each verdict."""
    own = known.where("won IS NOT NULL").select("url", "host", "path", (F.col("won.verdict") == "block").cast("int").alias("blocked")).distinct()
    totals = {r.blocked: r["count"] for r in own.groupBy("blocked").count().collect()}
    out = None
    for value in (0, 1):
        part = lowest(own.where(F.col("blocked") == value), "url", per_class, totals.get(value, 0))
        out = part if out is None else out.unionByName(part)
    return out


def train(samples: DataFrame) -> Boosted:
    """``samples``: (url, host, path, blocked), of bounded size."""
    rows = sorted((r.url, r.host, r.path, int(r.blocked)) for r in samples.select("url", "host", "path", "blocked").collect())
    return boost(rows)


def verdicts(known: DataFrame, model: Boosted, id_col: str = "page_id") -> DataFrame:
    """id, host, path, rule, verdict and the log-odds of block where no rule fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            free = [k for k, r in enumerate(rows) if r["won"] is None]
            odds: list[float | None] = [None] * len(rows)
            if free:
                x = np.asarray([model.features(rows[k]["url"], rows[k]["host"], rows[k]["path"]) for k in free])
                for k, v in zip(free, model.raw(x).tolist()):
                    odds[k] = v
            verdict = [r["won"]["verdict"] if r["won"] else "block" if o > 0 else "allow" for r, o in zip(rows, odds)]
            rule = [r["won"]["name"] if r["won"] else None for r in rows]
            columns = [batch.column(0).cast(pa.int64()), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(odds, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "host", "path", "rule", "verdict", "odds"])

    return known.select(id_col, "url", "host", "path", "won").mapInArrow(run, f"{id_col} long, host string, path string, rule string, verdict string, odds double")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    from .common import table

    known = ruled(table(spark, sf_dir, "pages"))
    return verdicts(known, train(labelled(known)))
