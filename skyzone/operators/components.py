"""Connected components by alternating large-star and small-star steps.

Every step is a pre-aggregated minimum and a join, so a node with very many neighbours is split
among tasks; edges are written to the checkpoint folder after each round, which cuts the lineage.
Nodes may be of any type that can be ordered and hashed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .match import by_measure, checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """(u, v) with u > v, after one star step on edges (u, v)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    side = both if large else both.where("v < u")
    least = side.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    if large:  # greater neighbours of u go to its least neighbour
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # u and its smaller neighbours go to the least of them
        moved = side.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


#: Most nodes that go to all tasks in a broadcast.
FEW = 50_000


def _split(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Edges (u, v) of components that are stars around their least node already, and those of all others.

    A star's leaves have one edge, and its centre is no leaf.  A node with several smaller neighbours, or
    with a smaller and a greater one, keeps what it touches from being one; usually there are few.
    """
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    odd = checkpointed(ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").select("n"))
    n = odd.count()
    if not n:
        return edges, None
    few = F.broadcast if n <= FEW else lambda df: df
    bad = checkpointed(odd.unionByName(edges.join(few(odd.withColumnRenamed("n", "u")), "u", "left_semi").select(F.col("v").alias("n"))).distinct()).withColumnRenamed("n", "v")
    few = F.broadcast if bad.count() <= FEW else lambda df: df
    return edges.join(few(bad), "v", "left_anti").select("u", "v"), edges.join(few(bad), "v", "left_semi").select("u", "v")


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) of every node of edges (a, b): the smallest node it is joined to.

    What has become stars rests; the rounds go on with the others.
    """
    by_measure(edges.sparkSession)
    stars, now = _split(checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()))
    for _ in range(most):
        if now is None:
            break
        done, now = _split(checkpointed(_star(_star(checkpointed(now), True), False)))
        stars = stars.unionByName(done)
    else:
        raise RuntimeError("components did not settle")
    out = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """Rows numbered from 0 in the order of a unique column, without one task for all.

    Rows are dealt by ranges; a row's number is its place in its range plus the sizes of the ranges
    before, of which there are as many as shuffle partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, by).sortWithinPartitions(by).withColumn("_at", F.monotonically_increasing_id())
    dealt = checkpointed(dealt)
    part = F.shiftright("_at", 33).cast("int")
    sizes = {r.p: r["count"] for r in dealt.groupBy(part.alias("p")).count().collect()}
    before, starts = 0, {}
    for p in sorted(sizes):
        starts[p], before = before, before + sizes[p]
    if not starts:
        return dealt.withColumn(name, F.col("_at")).drop("_at")
    offsets = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])
    return dealt.withColumn(name, (F.element_at(offsets, part) + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_at")
