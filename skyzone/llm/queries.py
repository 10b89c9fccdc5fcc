"""Queries of the training-data operators, by name, and the SQL for those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .graph_ann import op6_graph_ann
from .media import op2_media
from .mixing import op7_mixing
from .near_dup import ORACLE as NEAR_DUP_SQL
from .near_dup import op4_near_dup
from .packing import op8_packing
from .quality import op10_quality
from .secrets import op5_secret_scans
from .toxicity import op1_toxicity
from .url_filter import op3_url_filter
from .warc import ORACLE as WARC_SQL
from .warc import op9_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_media": op2_media,
    "op3_url_filter": op3_url_filter,
    "op4_near_dup": op4_near_dup,
    "op5_secret_scans": op5_secret_scans,
    "op6_graph_ann": op6_graph_ann,
    "op7_mixing": op7_mixing,
    "op8_packing": op8_packing,
    "op9_warc": op9_warc,
    "op10_quality": op10_quality,
}

ORACLES: dict[str, str] = {"op4_near_dup": NEAR_DUP_SQL, "op9_warc": WARC_SQL}
