"""Structured Streaming: session ingest, replay protection, late history, rollups.

Each function takes a streaming DataFrame and gives one; the runners write to
parquet under the shared folder and stop when the input is used up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.bitemporal import supersession
from palimpsest.session import shared_path


def stream_table(spark: SparkSession, path: str, columns: list[str], files_per_trigger: int | None = None) -> DataFrame:
    """A parquet table, a file or a folder, as a stream."""
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(files_per_trigger))
    folder, _, name = path.rstrip("/").rpartition("/")
    return r.parquet(f"{folder}/{{{name}}}").select(columns)  # a glob for exactly this name, as the source takes no single file


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all input there is, and read what it wrote."""
    spark = stream.sparkSession
    out, state = shared_path(spark, name), shared_path(spark, name + "-state")
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], name: str) -> None:
    """Run a stream through a function of each micro-batch."""
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", shared_path(stream.sparkSession, name)).trigger(availableNow=True).start()
    q.awaitTermination()


def once_each(stream: DataFrame, key: str, at: str, lateness: str) -> DataFrame:
    """Rows whose key came before within the lateness are dropped, by state that the watermark clears."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, at: str, width: str, lateness: str, *groups: str) -> DataFrame:
    """Counts and sums of ``value`` per window and group, given out when the watermark has passed."""
    g = stream.withWatermark(at, lateness).groupBy(F.window(at, width).alias("w"), *groups)
    return g.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), *groups, "n", "total")


def sessions(stream: DataFrame, at: str, gap: str, lateness: str, key: str) -> DataFrame:
    """Sessions of a key: runs without a pause of ``gap``."""
    g = stream.withWatermark(at, lateness).groupBy(F.session_window(at, gap).alias("w"), key)
    return g.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def late_history(spark: SparkSession, facts_stream: DataFrame, name: str = "history") -> DataFrame:
    """Facts told in any order: each micro-batch is appended, and the keys it touches get their whole chain again.

    What is stored is the log of told facts, which only grows; the chain is a
    view of it, so a fact that is learned late changes its neighbours' periods
    and nothing else, whatever the order of arrival.
    """
    log = shared_path(spark, name)

    def append(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").parquet(log)

    drain_batches(facts_stream, append, name + "-state")
    told = spark.read.schema(facts_stream.schema).parquet(log)
    return supersession(told.dropDuplicates(["id"]))


def ingest_sessions(spark: SparkSession, messages: DataFrame, ledger: DataFrame, name: str = "episodes") -> DataFrame:
    """Append each micro-batch's messages whose digest neither the ledger nor an earlier batch has."""
    out = shared_path(spark, name)

    def write(batch: DataFrame, _: int) -> None:
        h = batch.withColumn("hash", F.sha2(F.concat_ws("\u0001", F.coalesce("session_id", F.lit("")), F.coalesce("role", F.lit("")), F.coalesce("content", F.lit("")), F.coalesce("ts", F.lit(""))), 256))
        fresh = h.dropDuplicates(["hash"]).join(ledger.select("hash"), "hash", "left_anti")
        try:
            fresh = fresh.join(spark.read.schema(h.schema).parquet(out).select("hash"), "hash", "left_anti")
        except Exception as e:  # noqa: BLE001  the first batch finds no folder
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("append").parquet(out)

    drain_batches(messages, write, name + "-state")
    return spark.read.parquet(out)
