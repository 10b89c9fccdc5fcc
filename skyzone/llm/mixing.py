"""Soft-membership mixing of documents to target weights, with DataFrame functions only.

A labelled table (doc_id, domain) trains a multinomial classifier on counts of characters.  Which
``FEATURES`` characters it reads is learnt too: those that tell most about the domain in a bounded
sample of ``SAMPLE_DOCS`` labelled documents; its tables come from all labelled documents.  It gives
every document a posterior over domains, labelled or not.  Document i with t_i tokens and posterior
p_i gets a rate r_i >= ``least``, by default 0; the expected tokens of domain k are
E_k = sum r_i t_i p_ik.  Projected gradient descent with momentum (started anew where errors grow) on

    1/2 sum_k (E_k / T - s_k) ** 2

from r = 1 finds rates whose expected domain totals are the target shares s_k of the total T.  In the
metric of tokens, scaled by the domains' own shares h_k, the gradient is g . p_i with
g_k = (E_k / T - s_k) / h_k, the same few numbers for all documents, so each step is one aggregation
of twice as many sums as there are domains, and r is a function of the posterior and of the list of
gradients so far.  Nothing else leaves the executors; rates are written every ``WRITE`` steps, which
keeps steps alike in cost.

Steps end when all shares are met to ``GOOD``, when the projected gradient proves that no rates come
nearer (``STILL``), or after ``STEPS``.  ``Mix.error`` is the worst share's error then and
``Mix.stationarity`` the mean size of the projected gradient, so a caller sees targets that were
missed and whether they can't be met.

Letter posteriors are tempered (``LETTERS`` letters at most count) so that they stay soft.

Defined cases: null and empty texts have posteriors equal to the domains' shares and 0 tokens, which
bind no target; equal texts get equal rates; very long texts are counted whole; unlabelled documents
take part, as do rows of null ids; domains that are null are no labels, and of several labels of a
document the least counts; ties between features go to the smaller character; a table without labels
gets rates of 1 and one domain, the empty string; extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, lowest, only, stored

FEATURES = 16
SAMPLE_DOCS = 1000
LETTERS = 30.0
STEPS = 60
WRITE = 16
PART_ROWS = 50_000
GOOD, STILL = 1e-4, 1e-6
FLATTEN = 0.7
LEAST = 0.0


def _letters(text: Column, chosen: str) -> Column:
    """Counts of the chosen characters, and of all."""

    def counted(lowered: Column) -> Column:
        return F.array(*[(F.length(lowered) - F.length(F.replace(lowered, F.lit(c)))).cast("double") for c in chosen], F.length(lowered).cast("double"))

    return let(F.lower(text), counted)


def telling(labelled: DataFrame, n: int = FEATURES) -> str:
    """The ``n`` characters that tell most about the domain of (domain, text): those of most mutual information."""
    letters = labelled.select("domain", F.explode(F.filter(F.split(F.lower("text"), ""), lambda c: c != "")).alias("c"))
    counts = letters.groupBy("domain", "c").count()
    by_domain = Window.partitionBy("domain")
    counts = counts.withColumn("share", F.col("count") / F.sum("count").over(by_domain))  # a domain has as many rows as characters
    told = counts.groupBy("c").agg(F.sum(F.col("count") * F.log("share")).alias("own"), F.sum("count").alias("n"))
    total = told.agg(F.sum("n")).first()[0] or 1
    score = F.col("own") - F.col("n") * F.log(F.col("n") / total)
    return "".join(sorted(r.c for r in told.orderBy(F.round(score, 6).desc(), "c").limit(n).collect()))


def _features(text: Column, chosen: str) -> tuple[Column, Column]:
    """Tokens (one more than there are white-space characters) and letter counts of a text."""
    blanks = F.length(text) - F.length(F.translate(text, " \n\t\r", ""))
    tokens = F.when(F.length(text) > 0, blanks + 1).otherwise(0).cast("double")
    return tokens, _letters(text, chosen)


@dataclass
class Mix:
    """A fitted mixture: the classifier's tables and the gradients that lead to the rates."""

    domains: list[str]
    prior: list[float]
    table: list[list[float]]
    least: float
    letters: str = ""
    gradients: list[list[float]] = field(default_factory=list)
    momenta: list[float] = field(default_factory=list)
    error: float = 0.0
    stationarity: float = 0.0

    def posterior(self, letters: Column) -> Column:
        if len(self.domains) == 1:
            return F.array(F.lit(1.0))
        rows = F.array(*[F.array(*[F.lit(x) for x in row]) for row in self.table])
        total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)

        def scored(counts: Column) -> Column:
            # the last count is of all characters; those of no feature share one cell
            seen = F.get(counts, F.lit(len(self.letters)))
            own = F.concat(F.slice(counts, 1, len(self.letters)), F.array(seen * 2 - total(counts)))
            scale = F.when(seen > LETTERS, LETTERS / seen).otherwise(1.0)
            # a score is exp(-12 * LETTERS) or more, which a double holds
            of = lambda own: F.zip_with(F.transform(rows, lambda row: scale * total(F.zip_with(own, row, lambda a, b: a * b))), F.array(*[F.lit(x) for x in self.prior]), lambda a, b: F.exp(a + b))
            return let(own, of)

        return let(let(letters, scored), lambda e: F.transform(e, lambda x: x / total(e)))

    def places(self, p: Column, since: int = 0, start: Column | None = None) -> Column:
        """struct(r, q): the rate that the gradients from ``since`` on lead to, and the one before it."""
        start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("q")) if start is None else start
        if len(self.gradients) == since:
            return start
        past = F.array(*[F.struct(F.array(*[F.lit(x) for x in g]).alias("g"), F.lit(b).alias("b")) for g, b in zip(self.gradients[since:], self.momenta[since:])])

        def step(at: Column, x: Column) -> Column:
            ahead = at["r"] + x["b"] * (at["r"] - at["q"])
            return F.struct(F.greatest(F.lit(self.least), ahead - _dot(p, x["g"])).alias("r"), at["r"].alias("q"))

        return F.aggregate(past, start, step)

    def rate(self, p: Column) -> Column:
        """The rate that the gradients lead to, for a posterior."""
        return let(p, lambda p: self.places(p)["r"])

    def copies(self, rate: Column) -> Column:
        """The rate rounded up or down by a hash of the document's id, true to it on average."""
        lot = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("mixing")), F.lit(1_000_003)) / 1_000_003
        return F.floor(rate + lot).cast("int")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def flattened(shares: list[float], power: float = FLATTEN) -> list[float]:
    raised = [x**power if x > 0 else 0.0 for x in shares]
    return [x / sum(raised) for x in raised] if sum(raised) else shares


def fit(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, *, least: float = LEAST, steps: int = STEPS) -> tuple[Mix, DataFrame]:
    """The mixture, and (doc_id, tokens, p) of every document.

    ``targets``: share of each domain; where none are given, the tokens' own shares raised to the power
    ``FLATTEN``.  The total of tokens is the least that leaves no domain's mean rate below 1.
    """
    text = F.coalesce("text", F.lit(""))
    known = labelled.select("doc_id", F.col("domain").cast("string").alias("domain")).where("doc_id IS NOT NULL AND domain IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    some = lowest(known, "doc_id", SAMPLE_DOCS, known.count())  # SAMPLE_DOCS rows of an id and a name
    chosen = telling(only(docs, "doc_id", "text").join(F.broadcast(some), "doc_id").select("domain", text.alias("text")))
    tokens, letters = _features(text, chosen)
    features = stored(only(docs, "doc_id", "text").select("doc_id", tokens.alias("tokens"), letters.alias("letters")), "letters")
    width = len(chosen) + 1
    sums = [F.sum(F.get("letters", F.lit(k))).alias(f"f{k}") for k in range(width)]
    # one row per domain
    rows = features.join(known, "doc_id").groupBy("domain").agg(F.count("*").alias("n"), *sums).orderBy("domain").collect()
    out = Mix([r.domain for r in rows] or [""], [], [], least, chosen)
    for r in rows:
        own = [r[f"f{k}"] for k in range(width)]
        own[-1] = 2 * own[-1] - sum(own)
        out.prior.append(math.log(r.n / sum(x.n for x in rows)))
        out.table.append([math.log((x + 1) / (sum(own) + width)) for x in own])
    soft = stored(features.select("doc_id", "tokens", out.posterior(F.col("letters")).alias("p")), "posteriors")
    k = len(out.domains)
    # what the steps read is small, so it lies in as few parts as PART_ROWS asks for, however many the documents have
    start = soft.select("tokens", "p", F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("q")).alias("at"))
    held, since = stored(start.coalesce(-(-soft.count() // PART_ROWS) or 1), "rates"), 0

    def expected(momentum: float) -> tuple[list[float], list[float]]:
        """Tokens of each domain at the rates, and at the point that momentum leads to."""
        own = held.select("tokens", "p", let(F.col("p"), lambda p: out.places(p, since, F.col("at"))).alias("at"))
        r, ahead = F.col("at.r"), F.col("at.r") + momentum * (F.col("at.r") - F.col("at.q"))
        row = own.agg(*[F.sum(w * F.col("tokens") * F.get("p", F.lit(i))) for w in (r, ahead) for i in range(k)]).first()
        return [x or 0.0 for x in row[:k]], [x or 0.0 for x in row[k:]]

    now, _ = expected(0.0)
    total = sum(now)
    if not total or k == 1:
        return out, soft
    share = [x / total for x in now]
    goal = flattened(share) if targets is None else [targets.get(d, 0.0) / (sum(targets.values()) or 1.0) for d in out.domains]
    grown = max([s / g for s, g in zip(share, goal) if g > 0] + [1.0])
    slope = lambda e: [round(x / total - grown * s, 12) / h if h else 0.0 for x, s, h in zip(e, goal, share)]

    def still(g: list[float]) -> float:
        """Mean over tokens of the projected gradient's size at the rates."""
        own = held.select("tokens", "p", let(F.col("p"), lambda p: out.places(p, since, F.col("at"))["r"]).alias("r"))
        moved = F.abs(F.col("r") - F.greatest(F.lit(least), F.col("r") - _dot(F.col("p"), F.array(*[F.lit(x) for x in g]))))
        return own.agg(F.sum(moved * F.col("tokens"))).first()[0] / total

    age, last, ahead = 0, math.inf, now
    for step in range(steps + 1):
        out.error = max(abs(x / (total * grown) - s) for x, s in zip(now, goal))
        if out.error < GOOD or step == steps or (step % WRITE == WRITE - 1 and still(slope(now)) < STILL):
            break
        if step % WRITE == WRITE - 1:
            held, since = stored(held.select("tokens", "p", let(F.col("p"), lambda p: out.places(p, since, F.col("at"))).alias("at")), "rates"), len(out.gradients)
        if out.error > last:  # too far: from here without momentum
            age, ahead = 0, now
        out.momenta.append(age / (age + 3) if age else 0.0)
        out.gradients.append(slope(ahead))
        age, last = age + 1, out.error
        now, ahead = expected(age / (age + 3))
    out.stationarity = still(slope(now))
    return out, soft


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, *, least: float = LEAST, steps: int = STEPS) -> DataFrame:
    """doc_id, tokens, domain (likeliest), posterior, rate and copies of every document, and the targets' worst error."""
    fitted, soft = fit(docs, labelled, targets, least=least, steps=steps)
    best = F.array_position("p", F.array_max("p")).cast("int")
    rate = fitted.rate(F.col("p"))
    return soft.select(
        "doc_id",
        F.col("tokens").cast("long").alias("tokens"),
        F.element_at(F.array(*[F.lit(d) for d in fitted.domains]), best).alias("domain"),
        F.col("p").alias("posterior"),
        rate.alias("rate"),
        fitted.copies(rate).alias("copies"),
        F.lit(fitted.error).alias("target_error"),
    )


def resampled(docs: DataFrame, fitted: Mix) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as its copies; rates come from the texts again, so no join is needed."""
    rate = fitted.rate(fitted.posterior(_features(F.coalesce("text", F.lit("")), fitted.letters)[1]))
    # one use of the copies, since Spark would compute them anew for each
    name = "_copy"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, F.explode(F.array_repeat(F.lit(0), fitted.copies(rate)))).drop(name)


def labelled_by_language(docs: DataFrame) -> DataFrame:
    return only(docs, "doc_id", "lang").withColumnRenamed("lang", "domain")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    return mix(docs, labelled_by_language(docs))
