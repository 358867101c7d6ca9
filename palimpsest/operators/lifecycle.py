"""Idempotent ingest, erasure, holds, retention and hash-chained receipts, as whole-table plans."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def session_hash(messages: DataFrame) -> DataFrame:
    """``session_id, hash``: digest of a session's roles and contents in order of id."""
    turn = F.struct("id", F.coalesce("role", F.lit("")).alias("r"), F.coalesce("content", F.lit("")).alias("c"))
    # what a digest covers is bounded per day of a session by hashing the turns first
    leaf = messages.select("session_id", "id", F.sha2(F.concat_ws("\u0001", turn["r"], turn["c"]), 256).alias("h"))
    return leaf.groupBy("session_id").agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("id", "h"))), lambda x: x["h"])), 256).alias("hash"))


def unseen(batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows of a batch whose hash the ledger lacks; of repeats within the batch one."""
    return batch.dropDuplicates(["hash"]).join(ledger.select("hash"), "hash", "left_anti")


def erase_sessions(episodes: DataFrame, facts: DataFrame, links: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the sessions ``gone`` (session_id) and without what only they gave.

    Facts of the sessions go; pointers to them are cleared; observations that touch
    a subject, predicate digest or entity of an erased fact go too.
    """
    e = episodes.join(gone, "session_id", "left_anti")
    dead = facts.join(gone, "session_id", "left_semi").select("id", "subject", "predicate")
    touched = dead.select(F.col("subject").alias("name")).unionByName(dead.select(F.concat(F.lit("digest:"), F.col("predicate")).alias("name")))
    touched = touched.unionByName(links.join(dead.select(F.col("id").alias("fact_id")), "fact_id", "left_semi").select("name")).distinct()
    seen = facts.filter("kind = 'observation'")
    tainted = seen.join(touched.withColumnRenamed("name", "subject"), "subject", "left_semi").select("id").unionByName(
        seen.join(touched.withColumnRenamed("name", "predicate"), "predicate", "left_semi").select("id"))
    lost = dead.select("id").unionByName(tainted).distinct()
    f = facts.join(lost, "id", "left_anti").join(lost.select(F.col("id").alias("superseded_by"), F.lit(True).alias("cut")), "superseded_by", "left")
    f = f.withColumn("superseded_by", F.when(F.col("cut").isNull(), F.col("superseded_by"))).drop("cut")
    return {"episodes": e, "facts": f, "links": links.join(lost.select(F.col("id").alias("fact_id")), "fact_id", "left_anti")}


def erase_entity(facts: DataFrame, links: DataFrame, names: DataFrame) -> dict[str, DataFrame]:
    """Facts without those linked to the ``names`` (name), and links without these names and facts."""
    dead = links.join(names, "name", "left_semi").select("fact_id").distinct()
    return {"facts": facts.join(dead.withColumnRenamed("fact_id", "id"), "id", "left_anti"), "links": links.join(names, "name", "left_anti").join(dead, "fact_id", "left_anti")}


def active_holds(holds: DataFrame, now: str) -> DataFrame:
    return holds.filter(F.col("released_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))


def held_sessions(holds: DataFrame, facts: DataFrame, links: DataFrame, now: str) -> DataFrame:
    """``session_id, holds``: sessions under an active hold, by themselves or by an entity of one of their facts."""
    live = active_holds(holds, now)
    direct = live.filter("scope_kind = 'session'").select(F.col("scope_value").alias("session_id"), F.col("id").alias("hold"))
    by_name = live.filter("scope_kind = 'entity'").select(F.col("scope_value").alias("name"), F.col("id").alias("hold"))
    through = by_name.join(links, "name").join(facts.select(F.col("id").alias("fact_id"), "session_id"), "fact_id").filter("session_id is not null").select("session_id", "hold")
    return direct.unionByName(through).groupBy("session_id").agg(F.countDistinct("hold").alias("holds"))


def sweep(sessions: DataFrame, held: DataFrame, now: str) -> DataFrame:
    """``session_id, outcome``: sessions whose ``retain_until`` has passed, erased or skipped as held."""
    due = sessions.filter(F.col("session_id").isNotNull() & F.col("retain_until").isNotNull() & (F.col("retain_until") <= now)).select("session_id").distinct()
    return due.join(held.select("session_id", F.lit(True).alias("held")), "session_id", "left").select("session_id", F.when(F.col("held"), "skipped_held").otherwise("erased").alias("outcome"))


def seal(rows: DataFrame, chain: str, order: str, body: str) -> DataFrame:
    """Add ``seq, prev_hash, hash``: each hash covers the hash before and the body.

    A hash needs the one before it, so a chain is streamed through one task in
    order, holding one hash; many chains spread over tasks.
    """
    cols = [c for c in rows.columns]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in cols)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, prev, seq = None, "", 0
        for pdf in batches:
            out = []
            for c, b in zip(pdf[chain], pdf[body]):
                if c != at:
                    at, prev, seq = c, "", 0
                seq += 1
                h = hashlib.sha256((prev + (b or "")).encode()).hexdigest()
                out.append((seq, prev, h))
                prev = h
            pdf[["seq", "prev_hash", "hash"]] = out if out else None
            yield pdf

    return rows.repartition(chain).sortWithinPartitions(chain, order).mapInPandas(run, f"{kinds}, seq bigint, prev_hash string, hash string")


def violations(receipts: DataFrame, chain: str, body: str = "body") -> DataFrame:
    """``chain, receipts, violations``: numbers that do not follow, links that do not fit, hashes that do not hold.

    Every check needs only a row and the one before, so it is one window.
    """
    w = Window.partitionBy(chain).orderBy("seq")
    place = F.col("seq") != F.row_number().over(w)
    link = F.col("prev_hash") != F.coalesce(F.lag("hash").over(w), F.lit(""))
    wrong = F.col("hash") != F.sha2(F.concat(F.col("prev_hash"), F.coalesce(F.col(body), F.lit(""))), 256)
    checked = receipts.withColumn("bad", place.cast("int") + link.cast("int") + wrong.cast("int"))
    return checked.groupBy(chain).agg(F.count("*").alias("receipts"), F.sum("bad").cast("bigint").alias("violations"))
