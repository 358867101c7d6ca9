"""Bounded samples that depend on values alone, not on partitions or order."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAIN = 1 << 30


def hashed_sample(df: DataFrame, n: int, *by: str, rows: int | None = None) -> DataFrame:
    """At most ``n`` rows, those with the least hashes of the columns ``by``.

    A cut on the hash leaves about 1.5 n rows before the sort, so that the
    partitions together, not each of them, send about that many.
    """
    rows = df.count() if rows is None else rows
    kept = df.withColumn("_h", F.pmod(F.xxhash64(*by), F.lit(GRAIN)))
    if rows > 2 * n:
        kept = kept.filter(F.col("_h") < F.lit(math.ceil(GRAIN * (1.5 * n + 1000) / rows)))
    return kept.orderBy("_h", *by).limit(n).drop("_h")
