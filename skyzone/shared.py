"""The folder that driver and executors share, where plans are cut."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .errors import ConfigError

SETTING = "spark.checkpoint.dir"
_written: dict[str, list[str]] = {}


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where it is unset, a session of one machine gets a temporary one; on a cluster that is an error,
    since executors would not see the driver's folder.
    """
    found = spark.conf.get(SETTING, None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ConfigError(f"set {SETTING} to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skyzone-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; ``clean`` deletes it."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, name: str = "rows") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it again."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Nodes of a plan that are cheap enough to run again for each reader.
_CHEAP = r"Project|Filter|Relation|LocalRelation|LogicalRDD|Range|SubqueryAlias|Union|View|OneRowRelation"


def settled(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df``, stored if its plan has more than projections and filters of files, as it is read several times."""
    nodes = re.findall(r"^[\s:+-]*(\w+)", df._jdf.queryExecution().optimizedPlan().toString(), re.M)
    return df if all(re.fullmatch(_CHEAP, n) for n in nodes) else stored(df, name)


def by_measure(spark: SparkSession) -> None:
    """Broadcast a side of a join for its measured size, never for a guess.

    Guesses go by the files' sizes, and rows may be many times that: identities are long, computed and
    can't be compressed.  Where plans adapt, their bound moves to what shuffles have measured.
    """
    guess, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    most = spark.conf.get(guess, "10MB")
    if spark.conf.get("spark.sql.adaptive.enabled", "true") == "true" and most != "-1":
        if spark.conf.get(measured, None) is None:
            spark.conf.set(measured, most)
        spark.conf.set(guess, "-1")


#: Most rows and bytes of an Arrow batch that goes to a Python worker.  Texts are long, and the JVM and the
#: worker each hold a batch or two of every task at a time.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS and BATCH_BYTES, where they are larger, unset or have no bound."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(key, None) or "")
        if now is None or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def resumed(spark: SparkSession, request: Any, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives for a request, written under the request's fingerprint; read from there if it was finished before.

    Results of runs that were broken off have no mark of success and are made anew.
    """
    path = f"{folder(spark)}/resumed-{hashlib.sha256(json.dumps(request, sort_keys=True, default=str).encode()).hexdigest()}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def mark() -> int:
    """How many paths have been handed out, for ``clean``."""
    return sum(map(len, _written.values()))


def clean(spark: SparkSession, since: int = 0) -> int:
    """Delete what was written after ``mark`` gave ``since``, once its results are no longer read."""
    own = _written.get(spark.sparkContext.applicationId, [])
    gone, own[since:] = own[since:], []
    for path in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(gone)
