"""Matching of many catalogues: chains, unions, stars and friends of friends."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import replace
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalogue import Catalogue, check_frames
from ..errors import MatchError
from ..specs import MatchSpec
from . import scores
from .components import connected_components, numbered
from .match import SEP, Side, _limit, candidates, checkpointed, match, names_right, prepare

SOURCES = "_src_cats"


def chain(catalogues: list[Catalogue], spec: MatchSpec, union: bool = False, position: bool = False) -> DataFrame:
    """Match one catalogue after another to what has been found so far.

    From the third on, positions are those of the first catalogue that a row has.  Right columns get
    the suffix ``_k``.  With ``union`` every row of every catalogue stays, and ``_src_cats`` says which it has.
    ``position`` adds ``_union_ra`` and ``_union_dec``, those of the first catalogue that a row has.
    """
    if len(catalogues) < 2:
        raise MatchError("at least two catalogues are needed")
    check_frames(catalogues, spec.target_epoch)
    cats = [c.resolved() for c in catalogues]
    spec = replace(spec, join_type="1or2") if union else spec
    now = cats[0]
    place = [(now.ra, now.dec)]
    for k, cat in enumerate(cats[1:], 2):
        before = now.df.columns
        out = match(now, cat, spec, suffix=f"_{k}")
        new = names_right(before, cat.df.columns, f"_{k}")
        ra, dec = new.get(cat.ra, cat.ra), new.get(cat.dec, cat.dec)
        if ra not in out.columns:  # an anti join has one side's columns only
            return out
        if union:
            here, there = F.col(f"`{ra}`").isNotNull(), F.col(SOURCES).isNotNull() if k > 2 else F.col(f"`{cats[0].ra}`").isNotNull()
            so_far = F.col(SOURCES) if k > 2 else F.lit("1")
            label = F.when(here & there, F.concat(so_far, F.lit(f"+{k}"))).when(here, F.lit(str(k))).otherwise(so_far)
            out = out.withColumn(SOURCES, label)
        place.append((ra, dec))
        if k == len(cats):
            out = out.drop("_accum_ra", "_accum_dec")
            if position:
                out = out.withColumns({n: F.coalesce(*[F.col(f"`{p[i]}`") for p in place]) for i, n in enumerate(("_union_ra", "_union_dec"))})
            return out
        out = out.drop("_accum_ra", "_accum_dec")
        out = out.withColumn("_accum_ra", F.coalesce(*[F.col(f"`{r}`") for r, _ in place])).withColumn("_accum_dec", F.coalesce(*[F.col(f"`{d}`") for _, d in place]))
        now = replace(cats[0], df=out, ra="_accum_ra", dec="_accum_dec", id=None)
    return now.df


def _prepared(catalogues: list[Catalogue], spec: MatchSpec, extra: tuple[str, ...] = ()) -> list[tuple[Side, Side]]:
    """Each catalogue as a left side and as a right side, with the same rows."""
    out = []
    for c in catalogues:
        side = prepare(c, "l", spec, tuple(x for x in extra if x in c.df.columns))
        right = replace_side(side)
        out.append((side, right))
    return out


def replace_side(side: Side) -> Side:
    """A left side as a right one."""
    return Side(side.cat, side.rows, side.slim.select(*[F.col(c).alias("r" + c[1:]) for c in side.slim.columns]), side.has_sigma, side.has_cov, side.stats)


def _output(base: DataFrame, sides: list[Side], rows: list[str], names: list[list[str]], extra: list[str]) -> DataFrame:
    """All catalogues' columns joined to ``base`` by their row columns, in order, then ``extra``."""
    out = base
    for side, row, own in zip(sides, rows, names):
        columns = [c for c in side.rows.columns if c != "_row"]
        out = out.join(side.rows.select(F.col("_row").alias(row), *[F.col(f"`{c}`").alias(n) for c, n in zip(columns, own)]), row, "left")
    return out.select(*[f"`{n}`" for own in names for n in own], *extra)


def _names(sides: list[Side]) -> list[list[str]]:
    """Output names of all catalogues: those that are taken get ``_k``, repeated until they are free."""
    taken: set[str] = set()
    out = []
    for k, side in enumerate(sides, 1):
        own = []
        for c in [c for c in side.rows.columns if c != "_row"]:
            while c in taken:
                c += f"_{k}"
            taken.add(c)
            own.append(c)
        out.append(own)
    return out


def _first(tuples: DataFrame, cap: int, lo: int, hi: int) -> DataFrame:
    """Of each primary row the first ``cap`` tuples by rows ``lo`` to ``hi`` (0: all)."""
    if not cap:
        return tuples
    order = Window.partitionBy("row_1").orderBy(*[f"row_{k}" for k in range(lo, hi + 1)])
    return tuples.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")


def nway(catalogues: list[Catalogue], radius_arcsec: float, *, cap: int = 0, prior_columns: tuple[str, ...] = (), default_sigma: float | None = None) -> DataFrame:
    """Tuples of the first catalogue's rows with a mate in every other one within the radius, with ``p_match``.

    ``cap`` keeps the first tuples of each primary row in the order of ids (0: all).  The reports' other
    columns are all catalogues' columns.
    """
    spec = MatchSpec(radius_arcsec=radius_arcsec, find="all", prior_columns=prior_columns)
    cats = [replace(c, default_error=c.default_error if c.default_error is not None else default_sigma) for c in catalogues]
    check_frames(cats)
    both = _prepared(cats, spec, prior_columns)
    lefts = [a for a, _ in both]
    for side in lefts:
        if not side.has_sigma:
            raise MatchError(f"N-way matching needs position errors for catalogue {side.cat.name!r}")
    keep = ("ux", "uy", "uz", "sigma", *[f"x_{c}" for c in prior_columns])
    n = len(cats)
    mates = []
    for k, (_, right) in enumerate(both[1:], 2):
        pairs = candidates(lefts[0], right, spec, radius_arcsec)
        mates.append(pairs.select(F.col("l_row").alias("row_1"), F.col("r_row").alias(f"row_{k}"), *([F.col(f"l_{x}").alias(f"{x}_1") for x in keep] if k == 2 else []), *[F.col(f"r_{x}").alias(f"{x}_{k}") for x in keep]))
    if cap and n > 2:
        # only rows with mates everywhere, so that every tuple begun can be ended and the first ones begun end first
        mates = [checkpointed(m) for m in mates]
        whole = mates[0].select("row_1")
        for m in mates[1:]:
            whole = whole.join(m.select("row_1"), "row_1", "left_semi")
        mates[0] = mates[0].join(whole.distinct(), "row_1", "left_semi")
    out = None
    for k, own in enumerate(mates, 2):
        out = own if out is None else out.join(_first(own, cap, k, k), "row_1")
        out = _first(out, cap, 2, k)
    us = [tuple(F.col(f"u{x}_{k}") for x in "xyz") for k in range(1, n + 1)]
    odds = scores.bayes_factor(us, [F.col(f"sigma_{k}") / math.sqrt(2.0) for k in range(1, n + 1)]) * math.log(10.0)
    for c in prior_columns:
        union = None
        for k, side in enumerate(lefts):
            part = scores.keyed(side.slim, "l", c, f"{k} ")
            union = part if union is None else union.unionByName(part)
        points = scores.kde_points(union)
        values = [F.col(f"x_{c}_{k}") for k in range(1, n + 1)]
        odds = odds + scores.kde_log(points, sum(values[1:], values[0]) / n)
        for v in values:
            odds = odds - scores.kde_log(points, v)
    out = out.withColumn("p_match", 1.0 / (1.0 + F.exp(-odds)))
    return _output(out, lefts, [f"row_{k}" for k in range(1, n + 1)], _names(lefts), ["p_match"])


def nearest_tuples(mates: list[list[tuple]], most: int) -> Iterator[tuple[tuple, float]]:
    """The first ``most`` tuples of at most one (row, separation) of each list but the empty one, with their least separation.

    They come by least separation, then by rows, missing ones last.  Tuples are made one by one in that
    order: those of the nearest mate before all without it, and no branch is entered that holds none.
    """
    found = 0
    for sep in sorted({s for own in mates for _, s in own}):
        open_ = [[*sorted((r, s) for r, s in own if s >= sep), (None, math.inf)] for own in mates]
        last = max(k for k, own in enumerate(open_) if any(s == sep for _, s in own))

        def walk(k: int, chosen: tuple, hit: bool) -> Iterator[tuple]:
            if k == len(open_):  # noqa: B023
                yield chosen
                return
            for row, s in open_[k]:  # noqa: B023
                if hit or s == sep or k < last:  # noqa: B023
                    yield from walk(k + 1, (*chosen, row), hit or s == sep)  # noqa: B023

        for rows in walk(0, (), False):
            yield rows, sep
            found += 1
            if found == most:
                return


def _capped(centres: DataFrame, me: str, links: list[DataFrame], names: list[str], most: int) -> DataFrame:
    """The first ``most`` tuples of crowded centres: a group holds a centre's mates, never their product."""
    own = None
    for k, link in enumerate(links):
        part = link.select(F.col("l_row").alias(me), F.lit(k).alias("k"), F.col("r_row").cast("string").alias("row"), F.col(SEP).alias("s"))
        own = part if own is None else own.unionByName(part)
    kinds = [link.schema["r_row"].dataType.simpleString() for link in links]
    whole = [k != "string" for k in kinds]
    schema = ", ".join([f"{me} {centres.schema[me].dataType.simpleString()}", *[f"{c} string" for c in names], f"{SEP} double"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = None, None
        made: list[tuple] = []

        def flush() -> pa.RecordBatch:
            out = pd.DataFrame(made, columns=[me, *names, SEP])
            made.clear()
            return pa.RecordBatch.from_pandas(out, preserve_index=False, schema=shape)

        for batch in batches:
            shape = pa.schema([batch.schema.field(me), *[pa.field(c, pa.string()) for c in names], pa.field(SEP, pa.float64())])
            for centre, k, row, s in zip(*(batch.column(c).to_pylist() for c in (me, "k", "row", "s"))):
                if held is None or centre != now:
                    if held is not None:
                        made += [(now, *(None if r is None else str(r) for r in chosen), sep) for chosen, sep in nearest_tuples(held, most)]
                        if len(made) > 10_000:
                            yield flush()
                    held, now = [[] for _ in names], centre
                held[k].append((int(row) if whole[k] else row, s))
        if held is not None:
            made += [(now, *(None if r is None else str(r) for r in chosen), sep) for chosen, sep in nearest_tuples(held, most)]
            yield flush()

    rows = own.join(centres, me, "left_semi").repartition(me).sortWithinPartitions(me).mapInArrow(kernel, schema)
    return rows.select(me, *[F.col(c).cast(k) for c, k in zip(names, kinds)], SEP)


def star_union(catalogues: list[Catalogue], spec: MatchSpec, max_tuples: int = 100_000) -> DataFrame:
    """Every combination of a centre row with mates in later catalogues, and rows without mates.

    A row is a centre unless it has a mate in an earlier catalogue.  A centre with mates gives every
    combination of at most one of them from each later catalogue but the empty one.  A centre with more than
    ``max_tuples`` combinations gives the first of them by separation, and no others are made.  Singletons have a NaN separation.
    """
    spec = replace(spec, find="all", join_type="1or2")
    check_frames(catalogues, spec.target_epoch)
    both = _prepared(catalogues, spec)
    n = len(both)
    links: dict[tuple[int, int], DataFrame] = {}
    for i in range(n):
        for j in range(i + 1, n):
            used, halo = _limit(spec, both[i][0], both[j][1])
            links[i, j] = checkpointed(candidates(both[i][0], both[j][1], used, halo).select("l_row", "r_row", SEP))
    parts = []
    for i in range(n):
        centre = both[i][0].rows.select(F.col("_row").alias(f"row_{i + 1}"))
        for k in range(i):
            centre = centre.join(links[k, i].select(F.col("r_row").alias(f"row_{i + 1}")), f"row_{i + 1}", "left_anti")
        me = f"row_{i + 1}"
        any_mate, product = F.lit(False), F.lit(1.0)
        for j in range(i + 1, n):
            sizes = links[i, j].groupBy(F.col("l_row").alias(me)).agg(F.count("*").alias(f"_n{j}"))
            centre = centre.join(sizes, me, "left").withColumn(f"_n{j}", F.coalesce(f"_n{j}", F.lit(0)))
            any_mate, product = any_mate | (F.col(f"_n{j}") > 0), product * (F.col(f"_n{j}") + 1)
        centre = centre.withColumn("_any", any_mate).withColumn("_product", product).drop(*[f"_n{j}" for j in range(i + 1, n)])
        later = range(i + 1, n)
        names = [f"row_{j + 1}" for j in later]
        types = [links[i, j].schema["r_row"].dataType for j in later]
        few = centre.where(F.col("_product") <= max_tuples) if names else centre
        alone = few.select(me)
        for j, name, kind in zip(later, names, types):
            # each centre with each of its mates in catalogue j, and with none
            mates = links[i, j].select(F.col("l_row").alias(me), F.col("r_row").alias(name), F.col(SEP).alias(f"_s{j}"))
            none = alone.withColumn(name, F.lit(None).cast(kind)).withColumn(f"_s{j}", F.lit(None).cast("double"))
            few = few.join(mates.unionByName(none), me)
        some = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in names], F.lit(False))
        least = F.least(*[F.col(f"_s{j}") for j in later]) if n - i > 2 else (F.col(f"_s{i + 1}") if names else F.lit(None).cast("double"))
        few = few.where(some | ~F.col("_any")).select(me, *names, F.coalesce(least, F.lit(float("nan"))).alias(SEP))
        if names:
            few = few.unionByName(_capped(centre.where(F.col("_product") > max_tuples).select(me), me, [links[i, j] for j in later], names, max_tuples))
        centre, later = few, [F.col(c).isNotNull() for c in names]
        label = F.concat_ws("+", F.lit(str(i + 1)), *[F.when(x, F.lit(str(j + 1))) for j, x in zip(range(i + 1, n), later)])
        rows = [f"row_{k + 1}" if k >= i else F.lit(None).cast(both[k][0].rows.schema["_row"].dataType).alias(f"row_{k + 1}") for k in range(n)]
        parts.append(centre.select(*rows, F.col(SEP), label.alias(SOURCES)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    sides = [a for a, _ in both]
    names = _names(sides)
    places = [[own[[c for c in s.rows.columns if c != "_row"].index(getattr(s.cat, role))] for s, own in zip(sides, names)] for role in ("ra", "dec")]
    out = _output(out, sides, [f"row_{k + 1}" for k in range(n)], names, [SEP, SOURCES])
    first: list[Column] = [F.coalesce(*[F.col(f"`{c}`") for c in own]) for own in places]
    return out.withColumn("_union_ra", first[0]).withColumn("_union_dec", first[1])


def friends_of_friends(catalogues: list[Catalogue], spec: MatchSpec) -> DataFrame:
    """Bundles of rows linked across catalogues, directly or through others, that hold a primary row.

    Links join rows of different catalogues.  A bundle has its first primary row's columns, the mean of
    each numeric column of the members of every other catalogue and the first value of each other
    column, the number of catalogues, and their labels.  ``bundle_id`` counts bundles in the order of their
    first primary rows.
    """
    spec = replace(spec, find="all")
    check_frames(catalogues, spec.target_epoch)
    both = _prepared(catalogues, spec)
    n = len(both)
    edges = None
    numeric = all(dict(s.rows.dtypes)["_row"] in ("bigint", "int", "smallint", "tinyint") for s, _ in both)
    if numeric:
        node = lambda k, row: F.struct(F.lit(k).alias("cat"), F.col(row).cast("bigint").alias("row"))
    else:
        node = lambda k, row: F.struct(F.lit(k).alias("cat"), F.col(row).cast("string").alias("row"))
    for i in range(n):
        for j in range(i + 1, n):
            used, halo = _limit(spec, both[i][0], both[j][1])
            own = candidates(both[i][0], both[j][1], used, halo).select(node(i, "l_row").alias("a"), node(j, "r_row").alias("b"))
            edges = own if edges is None else edges.unionByName(own)
    parts = connected_components(edges)
    nodes = None
    for k, (side, _) in enumerate(both):
        own = side.rows.select(node(k, "_row").alias("node"))
        nodes = own if nodes is None else nodes.unionByName(own)
    member = nodes.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component")).where("component.cat = 0")
    member = checkpointed(member.select(F.col("component.row").alias("_bundle"), F.col("node.cat").alias("_cat"), F.col("node.row").alias("_node")))
    bundles = numbered(member.where("_cat = 0").select("_bundle").distinct(), "_bundle", "bundle_id")
    names = _names([a for a, _ in both])
    kind = "bigint" if numeric else "string"
    first = both[0][0].rows.withColumn("_bundle", F.col("_row").cast(kind))
    out = bundles.join(first.drop("_row"), "_bundle")
    # the smallest node of a bundle is its first primary row
    labels: list[Column] = [F.lit("1")]
    for k in range(1, n):
        side = both[k][0]
        rows = side.rows.withColumn("_node", F.col("_row").cast(kind)).join(member.where(F.col("_cat") == k), "_node")
        columns = [c for c in side.rows.columns if c != "_row"]
        types = dict(side.rows.dtypes)
        value = lambda c: F.avg(F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))) if types[c] in ("double", "float", "bigint", "int", "smallint", "tinyint") else F.min_by(F.col(f"`{c}`"), F.col("_node"))  # noqa: B023,E731
        own = rows.groupBy("_bundle").agg(F.lit(True).alias(f"_has{k}"), *[value(c).alias(m) for c, m in zip(columns, names[k])])
        out = out.join(own, "_bundle", "left")
        labels.append(F.when(F.col(f"_has{k}"), F.lit(str(k + 1))))
    count = sum((F.coalesce(F.col(f"_has{k}").cast("int"), F.lit(0)) for k in range(1, n)), F.lit(1))
    return out.select("bundle_id", count.cast("int").alias("n_cats"), F.concat_ws("+", *labels).alias(SOURCES), *[f"`{c}`" for own in names for c in own])
