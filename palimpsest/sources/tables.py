"""Readers of the store's tables.

A table is one parquet file or a folder of them; rows delivered twice count
once.  ``episodes`` and ``facts`` are told apart by ``id`` alone, as the data
contract says that rows of one id are equal in all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key; the shuffle carries only the columns the caller kept."""
    return df.dropDuplicates(list(keys))


def episodes(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    df = table(spark, sf_dir, "episodes")
    return once(df.select("id", *[c for c in cols if c != "id"]) if cols else df, "id")


def facts(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    df = table(spark, sf_dir, "facts")
    return once(df.select("id", *[c for c in cols if c != "id"]) if cols else df, "id")


def spelling(c: Column) -> Column:
    """Lower case, trimmed, each run of white space made one space."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def iso_utc(us: Column) -> Column:
    """Microseconds since the epoch as ``yyyy-MM-ddTHH:mm:ssZ`` in any session zone."""
    sec = F.floor(us / F.lit(1_000_000)).cast("long")
    day = F.floor(sec / F.lit(86_400)).cast("int")
    rest = sec - day.cast("long") * F.lit(86_400)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(
        F.date_from_unix_date(day).cast("string"), F.lit("T"),
        two(F.floor(rest / 3600).cast("int")), F.lit(":"),
        two((F.floor(rest / 60) % 60).cast("int")), F.lit(":"),
        two((rest % 60).cast("int")), F.lit("Z"),
    )


def iso_micros(c: Column) -> Column:
    """ISO text to microseconds; no zone means UTC, no time means midnight, unreadable means null."""
    t = F.trim(c)
    zoned = t.rlike(r"(?i)\d\d:\d\d.*(z|[+-]\d\d(:?\d\d)?)$")
    dated = t.rlike(r"^\d{4}-\d\d-\d\d$")
    full = F.when(zoned, t).when(dated, F.concat(t, F.lit("T00:00:00Z"))).when(t.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d"), F.concat(t, F.lit("Z")))
    return F.unix_micros(full.try_cast("timestamp"))
