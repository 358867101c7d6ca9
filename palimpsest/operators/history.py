"""Histories of changing attributes.

``change_log`` turns told facts into one event per key and start.
``intervals`` gives each event its period.  ``versions`` splits a key's line at
all its boundary dates and coalesces neighbours of equal value.  ``timeline``
combines the attributes of an entity: its line is split at the union of the
boundary dates of all attributes, and elementary periods with equal values
throughout are coalesced.

Nulls: a fact without start (neither ``valid_from`` nor ``ingested_at``) takes no
part; null subject, scope and object read as empty text. Repeated rows of one id
count once. An empty table gives an empty result. Extra columns are ignored.

Scale: keys are cut into time buckets (see ``neighbours``), so no task holds all
rows of a hot key; duplicates at one start are folded map-side first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.neighbours import with_neighbours
from palimpsest.session import materialise
from palimpsest.sources.tables import iso_micros, spelling

# The predicates that hold one value at a time.
SINGLE_VALUED = ("lives_in", "works_at", "job_title", "drives", "uses_phone", "preferred_theme", "primary_programming_language", "favorite_tea", "studies_at")
KEY = ["subject", "predicate", "scope"]
DAY_US = 86_400_000_000
BUCKET_US = 30 * DAY_US


def change_log(facts: DataFrame, predicates: tuple[str, ...] = SINGLE_VALUED) -> DataFrame:
    """One event per (subject spelling, predicate, scope, start): the last ingested, then the largest id.

    Columns: KEY, start_us, id, object (as spelling), ended_us (the end a fact
    carries by itself), ingested_us.
    """
    f = facts.filter(F.col("predicate").isin(*predicates)).select(
        "id", F.coalesce(spelling(F.col("subject")), F.lit("")).alias("subject"), "predicate", F.coalesce(F.trim("scope"), F.lit("")).alias("scope"),
        F.coalesce(spelling(F.col("object")), F.lit("")).alias("object"), iso_micros(F.col("ingested_at")).alias("ingested_us"),
        iso_micros(F.col("valid_from")).alias("_from"), F.when(F.col("superseded_by").isNull(), iso_micros(F.col("invalid_at"))).alias("ended_us"))
    f = f.withColumn("start_us", F.coalesce("_from", "ingested_us")).filter("start_us is not null")
    last = F.struct(F.coalesce("ingested_us", F.lit(-(2**62))), "id")
    one = f.groupBy(*KEY, "start_us").agg(F.max_by(F.struct("id", "object", "ended_us", "ingested_us"), last).alias("r"))
    return one.select(*KEY, "start_us", "r.*")


def intervals(log: DataFrame, bucket_us: int = BUCKET_US) -> DataFrame:
    """The period of each event: up to the next start of its key, or its own end if that is earlier."""
    n = with_neighbours(log, KEY, "start_us", ["start_us", "id", "object", "ended_us"], bucket_us)
    return n.withColumn("end_us", F.least("nxt.start_us", "ended_us"))


def versions(periods: DataFrame, bucket_us: int = BUCKET_US) -> DataFrame:
    """Coalesce events that follow each other without gap and with equal objects.

    A version bears the id of its first event. Columns: KEY, id, object, start_us,
    end_us (null: open).
    """
    joins_next = F.col("nxt").isNotNull() & F.col("end_us").eqNullSafe(F.col("nxt.start_us")) & (F.col("object") == F.col("nxt.object"))
    joins_prev = F.col("prev").isNotNull() & (F.coalesce(F.col("prev.ended_us"), F.col("start_us")) >= F.col("start_us")) & (F.col("object") == F.col("prev.object"))
    edges = periods.select(*KEY, "id", "object", "start_us", "end_us", (~joins_prev).alias("first"), (~joins_next).alias("last")).filter("first or last")
    ends = with_neighbours(edges, KEY, "start_us", ["end_us"], bucket_us, prev=None)
    return ends.filter("first").select(*KEY, "id", "object", "start_us", F.when(F.col("last"), F.col("end_us")).otherwise(F.col("nxt.end_us")).alias("end_us"))


def timeline(vers: DataFrame, bucket_us: int = BUCKET_US, predicates: tuple[str, ...] = SINGLE_VALUED) -> DataFrame:
    """All attributes of an entity side by side: ``subject, scope, start_us, end_us`` and one column per predicate.

    Periods before the first known value and periods in which no attribute holds
    are left out.
    """
    who = ["subject", "scope"]
    held = F.struct(F.col("object").alias("object"))
    gone = F.struct(F.lit(None).cast("string").alias("object"))
    starts = vers.select(*who, "predicate", F.col("start_us").alias("at"), held.alias("v"), F.lit(1).alias("kind"))
    stops = vers.filter("end_us is not null").select(*who, "predicate", F.col("end_us").alias("at"), gone.alias("v"), F.lit(0).alias("kind"))
    # where one version ends and the next begins, the beginning counts
    marks = starts.unionByName(stops).groupBy(*who, "at").agg(*[
        F.max_by(F.when(F.col("predicate") == p, F.col("v")), F.when(F.col("predicate") == p, F.col("kind"))).alias(p) for p in predicates])
    b = marks.withColumn("_b", F.floor(F.col("at") / F.lit(bucket_us)).cast("long"))
    tails = b.groupBy(*who, "_b").agg(*[F.max_by(p, F.when(F.col(p).isNotNull(), F.col("at"))).alias(p) for p in predicates])
    before = Window.partitionBy(*who).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(*who, "_b", *[F.last(p, ignorenulls=True).over(before).alias(f"_{p}") for p in predicates])
    within = Window.partitionBy(*who, "_b").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    filled = b.join(carry, [*who, "_b"]).select(*who, "at", F.struct(*[
        F.coalesce(F.last(p, ignorenulls=True).over(within), F.col(f"_{p}")).getField("object").alias(p) for p in predicates]).alias("v"))
    # thin marks cross the borders, a row's number and a digest of its values; the values come back to the rows that are left
    filled = materialise(filled.withColumn("digest", F.sha2(F.to_json("v"), 256)))
    n = with_neighbours(filled.select(*who, "at", "digest"), who, "at", ["at", "digest"], bucket_us)
    same_prev = F.col("prev.digest").eqNullSafe(F.col("digest"))
    same_next = F.col("nxt.digest").eqNullSafe(F.col("digest"))
    edges = n.select(*who, "at", F.col("nxt.at").alias("until"), (~same_prev).alias("first"), (~same_next).alias("last")).filter("first or last")
    e = with_neighbours(edges, who, "at", ["until"], bucket_us, prev=None).filter("first")
    e = e.select(*who, "at", F.when(F.col("last"), F.col("until")).otherwise(F.col("nxt.until")).alias("end_us"))
    e = e.join(filled.select(*who, "at", "v"), [*who, "at"]).select(*who, F.col("at").alias("start_us"), "end_us", "v.*")
    return e.filter(F.coalesce(*[F.col(p) for p in predicates]).isNotNull())
