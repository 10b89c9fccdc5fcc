"""Sky catalogues made from the driver tables, as SQL that Spark and the oracle both read.

Numbers are in E notation, so that both engines take them as doubles.  ``lineitem`` repeats (order,
line), so detections are grouped by it.  Two thirds of ``cat_c`` lie a degree from their orders, so that
they have no counterparts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..catalogue import Catalogue


def position(k: str) -> tuple[str, str]:
    return f"(CAST({k} AS DOUBLE)*1.3750776405e2)%3.6e2", f"(CAST({k} AS DOUBLE)*6.180339887e1)%1.78e2-8.9e1"


_A, _B = position("o_orderkey"), position("l_orderkey")
_D = position("c_custkey")

#: name -> (table, SQL over that table)
SQL: dict[str, str] = {
    "cat_a": f"""SELECT CAST(o_orderkey AS BIGINT) AS id, {_A[0]} AS ra, {_A[1]} AS dec, 1.4e1 + (o_totalprice%1e3)/1e2 AS mag,
        2e-1 + CAST(o_orderkey%5 AS DOUBLE)*1e-1 AS ra_err, 3e-1 + CAST(o_orderkey%3 AS DOUBLE)*1e-1 AS dec_err,
        (CAST(o_orderkey%7 AS DOUBLE)-3e0)*2e-1 AS rho, CAST(o_orderkey%11 AS DOUBLE)*1e1 AS pm_ra,
        CAST(o_orderkey%13 AS DOUBLE)*1e1-6e1 AS pm_dec, 2e3 AS epoch FROM orders""",
    "cat_b": f"""SELECT CAST(l_orderkey*10+l_linenumber AS BIGINT) AS id, CAST(l_orderkey AS BIGINT) AS order_id, {_B[0]} AS ra,
        {_B[1]}+CAST(l_linenumber AS DOUBLE)*1e-4 AS dec, 1.4e1 + (min(l_extendedprice)%1e3)/1e2 AS mag,
        1e-1 + CAST(l_linenumber AS DOUBLE)*5e-2 AS ra_err, 2e-1 AS dec_err, 1e-1 AS rho
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "cat_c": f"""SELECT CAST(o_orderkey AS BIGINT) AS id, {_A[0]} AS ra, {_A[1]}+CASE WHEN o_orderkey%3=0 THEN 2.3e-4 ELSE 1e0 END AS dec, 1.5e1 + (o_totalprice%7e2)/1e2 AS mag,
        2.5e-1 AS ra_err, 2.5e-1 AS dec_err FROM orders""",
    "cat_d": f"""SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN c_custkey%4=0 THEN (3.6e2-1e-4*CAST(c_custkey%3 AS DOUBLE))%3.6e2 ELSE {_D[0]} END AS ra,
        CASE WHEN c_custkey%4=1 THEN 8.99e1 WHEN c_custkey%4=2 THEN -8.99e1 ELSE {_D[1]} END AS dec FROM customer""",
}
TABLES = {"cat_a": "orders", "cat_b": "lineitem", "cat_c": "orders", "cat_d": "customer"}
ROLES = {
    "cat_a": {"ra_err": "ra_err", "dec_err": "dec_err", "corr": "rho"},
    "cat_b": {"ra_err": "ra_err", "dec_err": "dec_err", "corr": "rho"},
    "cat_c": {"ra_err": "ra_err", "dec_err": "dec_err"},
    "cat_d": {},
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{TABLES[name]}.parquet")
    return spark.sql(SQL[name].replace(f"FROM {TABLES[name]}", "FROM {table}"), table=table)


def catalogue(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None, **roles) -> Catalogue:
    df = frame(spark, sf_dir, name)
    df = df.select(*columns) if columns else df
    own = {k: v for k, v in ROLES[name].items() if v in df.columns}
    return Catalogue(df, name=name, ra="ra", dec="dec", **{"id": "id", **own, **roles})


def cte(*names: str) -> str:
    return ", ".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in names)


SEP = "degrees(2e0*asin(least(1e0, sqrt({x}*{x}+{y}*{y}+{z}*{z})/2e0)))*3.6e3"


def sep(l: str, r: str, ra: str = "ra", dec: str = "dec") -> str:
    """Arcseconds between rows of two relations."""
    x, y, z = (
        f"(cos(radians({l}.{dec}))*cos(radians({l}.{ra}))-cos(radians({r}.{dec}))*cos(radians({r}.{ra})))",
        f"(cos(radians({l}.{dec}))*sin(radians({l}.{ra}))-cos(radians({r}.{dec}))*sin(radians({r}.{ra})))",
        f"(sin(radians({l}.{dec}))-sin(radians({r}.{dec})))",
    )
    return SEP.format(x=x, y=y, z=z)


def banded(l: str, r: str, where: str, name: str = "pairs", columns: str = "l.id AS l_id, r.id AS r_id", band: str = "1e-2") -> str:
    """A CTE of pairs by bands of declination, with their separation; ``where`` may use ``sep``."""
    return f"""{name} AS MATERIALIZED (SELECT * FROM (SELECT {columns}, {sep('l', 'r')} AS sep FROM {l} l
        JOIN (SELECT {r}.*, CAST(floor((dec+9e1)/{band}) AS BIGINT)+k.k AS band FROM {r}, (SELECT unnest([-1, 0, 1]) AS k) k) r
        ON CAST(floor((l.dec+9e1)/{band}) AS BIGINT) = r.band) WHERE {where})"""
