"""Secret scans with DataFrame functions only: fixed rules, then Markov models of characters.

Rules find assignments, access ids and hexadecimal strings.  The method adds spans: every other
run of 20 or more token characters is scored by two first-order Markov models over
characters, one of random strings and one of ordinary identifiers, both trained from labelled
samples (token, is_random) with add-one counts.  A run whose log-likelihood ratio per character is
over ``THRESHOLD`` and that lies outside all rule spans becomes a span of kind ``markov``.

Positions are code points, ends exclusive.  Gaps between matches come from ``split`` and matches
from ``regexp_extract_all`` of the same pattern, so their running lengths are the positions.

Defined cases: null text is empty text and has no spans; equal rows give equal results; null ids stay
null; very long texts are scanned whole, in time that grows with their matches; extra columns are
ignored; an empty table gives no rows; without any training tokens of one class the
add-one counts alone are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, lowest, only

# The rules' patterns and least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "markov")

#: Runs that the models score; a run starts and ends where these characters do.
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Nats a pair: of held-out random strings of 20 characters, at most 1.1 % score 0.5 or less in any alphabet with words of
#: sf0.1 (0.9 % with those of sf0.01), and none of 6000 identifiers joined of words of sf0.1 (the sample's among them) scores over 0.2.  Identifiers of a language that the sample lacks can score more.
THRESHOLD = 0.5
#: Matches of one text that are walked at once.
RUN_LENGTH = 256
SAMPLE_DOCS = 2000
SAMPLE_RANDOM = 4000
#: Classes of characters: each letter in either case, each digit, and + / _ = - by themselves.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET)


def _spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Array of (start, stop, kind) of all matches that ``keep`` lets stand.

    Matches are walked in runs of ``RUN_LENGTH``, each from the place where the one before it ends, so
    that the work grows with a text's matches and not with their square.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,stop:int,kind:string>>")

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["hit"])
        span = F.array(F.struct(start.alias("start"), stop.alias("stop"), F.lit(kind).alias("kind")))
        good = F.lit(True) if keep is None else keep(x["hit"])
        return F.struct(stop.alias("at"), F.when(good, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def walked(pairs: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / RUN_LENGTH).cast("int")), lambda k: F.slice(pairs, k * RUN_LENGTH + 1, F.lit(RUN_LENGTH)))
        return let(runs, placed)

    def placed(runs: Column) -> Column:
        sizes = F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["hit"])))
        starts = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        own = F.zip_with(runs, starts, lambda run, at: F.when(run.isNotNull(), F.aggregate(run, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])).otherwise(none))
        return F.flatten(own)

    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("hit"))
    return F.when(F.size(found) > 0, let(pairs, walked)).otherwise(none)


def base_spans(text: Column) -> dict[str, Column]:
    lowered = F.lower(text)
    named = F.lit(False)
    for word in ASSIGN_WORDS:
        named = named | F.contains(lowered, F.lit(word))
    none = F.array().cast("array<struct<start:int,stop:int,kind:string>>")
    long_value = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= LEAST_VALUE
    return {
        "assign": F.when(named, _spans(text, ASSIGN, "assign", long_value)).otherwise(none),
        "access": F.when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, "access")).otherwise(none),
        "hex": _spans(text, HEX, "hex"),
    }


def labelled_sample(docs: DataFrame) -> DataFrame:
    """Tokens labelled random or ordinary, both bounded.

    Random: base-64, hexadecimal and upper-case base-36 forms of SHA-256 digests of counters.
    Ordinary: words of the ``SAMPLE_DOCS`` documents whose ids hash lowest, alone, joined by
    underscores and hyphens, and in camel case, as identifiers and paths are made.
    """
    spark: SparkSession = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("random "), F.col("id").cast("string")), 256)
    random = spark.range(SAMPLE_RANDOM).select(
        F.explode(F.array(F.regexp_replace(F.base64(F.unhex(digest)), "=+$", ""), F.substring(digest, 1, 40), F.upper(F.conv(F.substring(digest, 1, 15), 16, 36)))).alias("token")
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    head = lowest(only(docs, "doc_id", "text"), "doc_id", SAMPLE_DOCS, docs.count())
    words = head.select(F.regexp_extract_all(text, F.lit("[A-Za-z]{3,19}"), F.lit(0)).alias("w")).where(F.size("w") > 0)
    four = F.slice("w", 1, 4)
    ordinary = words.select(
        F.explode(
            F.concat(
                F.col("w"),
                F.transform("w", lambda x: F.lower(x)),
                F.array(F.array_join(four, "_"), F.array_join(four, "-"), F.array_join(four, "/"), F.upper(F.array_join(four, "_")), F.array_join(F.transform(four, lambda x: F.initcap(x)), ""), F.concat_ws("_", F.lower(F.array_join(four, "_")), F.lit("2024"))),
            )
        ).alias("token")
    )
    return random.withColumn("is_random", F.lit(True)).unionByName(ordinary.withColumn("is_random", F.lit(False)))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of the character pairs, ``SIZE`` x ``SIZE`` row by row."""
    pairs = (
        samples.where(F.length("token") > 1)
        .select("is_random", "token", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("i"))
        .select("is_random", F.expr("substring(token, i, 2)").alias("pair"))
        .groupBy("is_random", "pair")
        .count()
    )
    place = {c: k for k, c in enumerate(ALPHABET)}
    counts = {True: [[1.0] * SIZE for _ in range(SIZE)], False: [[1.0] * SIZE for _ in range(SIZE)]}
    known = pairs.where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$"))  # at most two per pair of the alphabet
    for row in known.collect():
        counts[row.is_random][place[row.pair[0]]][place[row.pair[1]]] += row["count"]
    out: list[float] = []
    for own, other in zip(counts[True], counts[False]):
        a, b = sum(own), sum(other)
        out += [math.log(x / a) - math.log(y / b) for x, y in zip(own, other)]
    return out


def ratio(token: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio a character pair of ``token`` has."""
    known = F.array(*[F.lit(round(x, 6)) for x in table])
    places = F.array(*[F.lit(ALPHABET.find(chr(k))) for k in range(128)])
    own = F.transform(F.split(token, ""), lambda c: F.get(places, F.ascii(c)))
    n = F.length(token) - 1
    each = F.zip_with(F.slice(own, 1, n), F.slice(own, 2, n), lambda a, b: F.get(known, a * SIZE + b))
    return F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x) / n


def _before(a: Column, b: Column) -> Column:
    order = lambda x: F.when(x["kind"] == "assign", 0).when(x["kind"] == "access", 1).when(x["kind"] == "hex", 2).otherwise(3)
    by_kind = F.signum(order(a) - order(b)).cast("int")
    return F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise(by_kind)


def _added(text: Column, base: Column, table: list[float], threshold: float) -> Column:
    """Spans of runs that look random and lie outside the rules' spans."""
    runs = _spans(text, RUN, "markov", lambda hit: ratio(hit, table) > threshold)
    return F.filter(runs, lambda x: ~F.exists(base, lambda y: (x["start"] < y["stop"]) & (y["start"] < x["stop"])))


def all_spans(text: Column, table: list[float], threshold: float = THRESHOLD) -> Column:
    return let(F.concat(*base_spans(text).values()), lambda base: F.array_sort(F.concat(base, _added(text, base, table, threshold)), _before))


def scan(docs: DataFrame, table: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, by (the rules' spans by kind), base (those in order) and all (with the method's)."""
    found = only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    found = found.withColumn("by", F.struct(*[c.alias(k) for k, c in base_spans(F.col("text")).items()]))
    found = found.withColumn("base", F.array_sort(F.concat("by.assign", "by.access", "by.hex"), _before))
    return found.withColumn("all", F.array_sort(F.concat("base", _added(F.col("text"), F.col("base"), table, threshold)), _before))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by a mark; overlapping spans make one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        fresh = x["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit("[SECRET]"))).otherwise(acc["out"]).alias("out"))

    def whole(spans: Column) -> Column:
        out = let(F.aggregate(spans, start, step), lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))
        return F.when(F.size(spans) > 0, out).otherwise(text)

    return let(spans, whole)


def redact_documents(docs: DataFrame, table: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, with every span in ``text`` replaced; null texts stay null."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = all_spans(text, table, threshold)
    out = docs.withColumn("text", F.when(F.col("text").isNull(), F.col("text")).otherwise(redacted(text, spans)))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op5_secret_scans(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    found = scan(docs, train(labelled_sample(docs)))
    count = lambda kind: F.size(F.col("by")[kind]).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("all").alias("spans"),
    )
