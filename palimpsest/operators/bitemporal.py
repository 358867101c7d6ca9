"""Facts on two axes: when they hold in the world, and when they are known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.neighbours import with_next

BUCKET_US = 30 * 86_400_000_000


def write_form(facts: DataFrame) -> DataFrame:
    """Facts as the store keeps them: normalised key, trimmed scope, a start for each."""
    return facts.select(
        "id", "statement", F.lower(F.trim(F.coalesce("subject", F.lit("")))).alias("subject"), F.lower(F.trim(F.coalesce("predicate", F.lit("")))).alias("predicate"), "object", "kind",
        "event_date", "ingested_at", F.coalesce("valid_from", "event_date", "ingested_at").alias("valid_from"), "invalid_at", "superseded_by", "episode_id", "session_id",
        F.coalesce(F.trim("scope"), F.lit("")).alias("scope"))


def time_key(c: Column) -> list[Column]:
    """Sort key of ISO text: readable times by instant, the others after them as text."""
    at = F.unix_micros(F.when(c.rlike(r"(Z|[+-]\d\d:?\d\d)$"), c).when(c.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(c, F.lit("T00:00:00Z"))).otherwise(F.concat(c, F.lit("Z"))).try_cast("timestamp"))
    return [at.isNull(), at, c]


def supersession(facts: DataFrame, bucket_us: int = BUCKET_US) -> DataFrame:
    """Each fact's end and successor: the next of its key by time, then id; the last stays open.

    A key of any size is cut into pieces of time, unreadable times by their first letters.
    """
    unread, at, text = time_key(F.col("valid_from"))
    piece = F.struct(unread.alias("a"), F.coalesce(F.floor(at / F.lit(bucket_us)), F.lit(0)).alias("b"), F.when(unread, F.coalesce(F.substring(text, 1, 3), F.lit(""))).otherwise(F.lit("")).alias("c"))
    n = with_next(facts, ["subject", "predicate", "scope"], piece, [unread, at, text, F.col("id")], ["valid_from", "id"])
    return n.withColumn("chain_invalid_at", F.col("nxt.valid_from")).withColumn("chain_superseded_by", F.col("nxt.id")).drop("nxt")


# Predicates of which one value holds at a time, beside all that begin with "favorite".
ONE_AT_A_TIME = ("lives_in", "works_at", "employed_by", "married_to", "named", "aged", "weighs", "earns", "studies_at", "drives", "located_in", "job_title", "favorite", "favourite",
                 "uses_phone", "current_city", "current_job", "primary_programming_language", "preferred_theme")


def consolidated(facts: DataFrame) -> DataFrame:
    """The chain of single-valued facts with a subject: what is told again with one start counts once, the earliest id stays."""
    p = F.col("predicate")
    one = facts.filter((F.col("subject") != "") & (p.isin(*ONE_AT_A_TIME) | p.startswith("favorite")))
    told = one.withColumn("_said", F.lower(F.trim(F.coalesce("statement", F.lit(""))))).groupBy("subject", "predicate", "scope", "_said", "valid_from").agg(F.min("id").alias("id"))
    return supersession(told.drop("_said"))


def revisions(facts: DataFrame) -> DataFrame:
    """``fact_id, revision, known_at, valid_from, invalid_at``: open when ingested, closed when its successor is known."""
    base = facts.filter("ingested_at is not null")
    told = base.select(F.col("id").alias("fact_id"), F.lit(1).alias("revision"), F.col("ingested_at").alias("known_at"), "valid_from", F.lit(None).cast("string").alias("invalid_at"))
    nxt = base.select(F.col("id").alias("superseded_by"), F.col("ingested_at").alias("at"))
    closed = base.filter("superseded_by is not null and invalid_at is not null").join(nxt, "superseded_by").select(
        F.col("id").alias("fact_id"), F.lit(2).alias("revision"), F.greatest("ingested_at", "at").alias("known_at"), "valid_from", "invalid_at")
    own = base.filter("superseded_by is null and invalid_at is not null").select(F.col("id").alias("fact_id"), F.lit(2).alias("revision"), F.col("ingested_at").alias("known_at"), "valid_from", "invalid_at")
    return told.unionByName(closed).unionByName(own)


def withdrawn(facts: DataFrame) -> DataFrame:
    """``id, withdrawn_at``: when a fact's end first became known."""
    r = revisions(facts).filter("revision = 2")
    return r.groupBy(F.col("fact_id").alias("id")).agg(F.min("known_at").alias("withdrawn_at"))


def as_of(facts: DataFrame, world: str | None = None, known: str | None = None, subject: str | None = None) -> DataFrame:
    """Facts as of a world time and a knowledge time, compared as text.

    Neither: open facts. World: those whose period holds it. Known: those recorded
    by then and not withdrawn by then. Both: recorded by then, begun by the world
    time, and by the last revision known not ended; that revision's period is given.
    """
    f = facts.filter("kind != 'observation'")
    if subject is not None:
        f = f.filter(F.col("subject") == subject.lower().strip())
    if world is None and known is None:
        return f.filter("invalid_at is null")
    if known is None:
        return f.filter((F.col("valid_from") <= world) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > world)))
    rec = f.filter(F.col("ingested_at") <= known)
    if world is None:
        w = withdrawn(facts)
        return rec.join(w, "id", "left").filter(F.col("withdrawn_at").isNull() | (F.col("withdrawn_at") > known)).drop("withdrawn_at")
    last = F.max_by(F.struct(F.col("valid_from").alias("rf"), F.col("invalid_at").alias("ri")), F.struct("known_at", "revision"))
    rev = revisions(facts).filter(F.col("known_at") <= known).groupBy(F.col("fact_id").alias("id")).agg(last.alias("r"))
    got = rec.filter(F.col("valid_from") <= world).join(rev, "id", "left").filter(F.col("r.ri").isNull() | (F.col("r.ri") > world))
    return got.withColumn("invalid_at", F.col("r.ri")).withColumn("valid_from", F.coalesce("r.rf", "valid_from")).drop("r")


def unlike_before(new: DataFrame, old: DataFrame) -> DataFrame:
    """New facts whose key and statement (case aside) no valid old fact has; of equals among the new the first id."""
    key = ["subject", "predicate", "scope", "said"]
    said = F.lower(F.coalesce("statement", F.lit("")))
    fresh = new.withColumn("said", said).join(old.filter("invalid_at is null").withColumn("said", said).select(key), key, "left_anti")
    first = F.row_number().over(Window.partitionBy(*key).orderBy("id"))
    return fresh.withColumn("n", first).filter("n = 1").drop("n", "said")
