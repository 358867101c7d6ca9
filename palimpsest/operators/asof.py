"""Attributes as they were known at an event's time.

Facts of one entity and attribute enter a persistent (path-copied) search tree
in the order in which they were ingested; each insertion copies the path from the
root and leaves all older roots intact.  An event picks the root that was
current at its own time, which holds all that was known then, facts that begin later
included, and searches it by valid time: the greatest key (start, ingestion,
id) whose start is not after the event.  Nothing learned later can be reached.

Scale: a fact can be an answer from ``max(start, ingestion)`` on, so an entity's line
is cut into slices of time. A slice needs only the facts that begin or are ingested in
it, the other time being no later, and one row carried in per attribute, the best of those before. The slices of all
entities are spread by hash and streamed in order, so a task holds one slice of
one entity at a time, however many rows the entity has.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICE_US = 7 * 86_400_000_000


class PersistentTree:
    """A treap of immutable nodes (key, priority, left, right, value); ``insert`` returns a new root."""

    __slots__ = ("roots", "known")

    def __init__(self) -> None:
        self.roots: list = [None]
        self.known: list[int] = []

    def insert(self, known: int, key: tuple, value: object) -> None:
        """Add a key that became known at ``known`` (not before any added earlier)."""
        self.roots.append(_insert(self.roots[-1], key, hash((key, 0x9E3779B9)) & 0xFFFFFFFF, value))
        self.known.append(known)

    def at(self, known: int):
        """The root that was current at an instant."""
        return self.roots[bisect_right(self.known, known)]

    def before(self, known: int, bound: tuple):
        """(key, value) of the greatest key not above ``bound`` as known then, or None."""
        node, best = self.at(known), None
        while node is not None:
            if node[0] <= bound:
                best, node = node, node[3]
            else:
                node = node[2]
        return None if best is None else (best[0], best[4])


def _insert(node, key, priority, value):
    if node is None:
        return (key, priority, None, None, value)
    k, p, left, right, v = node
    if priority > p:
        lo, hi = _split(node, key)
        return (key, priority, lo, hi, value)
    if key < k:
        return (k, p, _insert(left, key, priority, value), right, v)
    return (k, p, left, _insert(right, key, priority, value), v)


def _split(node, key):
    if node is None:
        return None, None
    k, p, left, right, v = node
    if key < k:
        lo, hi = _split(left, key)
        return lo, (k, p, hi, right, v)
    lo, hi = _split(right, key)
    return (k, p, left, lo, v), hi


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = ["entity", "slice", "attribute", "kind", "at", "id", "start_us", "ingested_us", "ended_us"]
    key, trees = None, {}
    for pdf in batches:
        out = []
        for entity, part, attribute, kind, at, i, start, ingested, ended in zip(*(pdf[c] for c in cols)):
            if (entity, part) != key:
                key, trees = (entity, part), {}
            if kind == 0:
                trees.setdefault(attribute, PersistentTree()).insert(ingested, (start, ingested, i), ended)
                continue
            for a, tree in trees.items():
                hit = tree.before(at, (at, float("inf"), float("inf")))
                if hit and not (hit[1] == hit[1] and hit[1] is not None and hit[1] <= at):
                    out.append((i, a, hit[0][2]))
        if out:
            yield pd.DataFrame(out, columns=["event_id", "attribute", "fact_id"])


def as_known(events: DataFrame, facts: DataFrame, slice_us: int = SLICE_US) -> DataFrame:
    """Join each event with what was known of its entity at its time.

    events: ``event_id, entity, at_us``; facts: ``entity, attribute, id, start_us,
    ingested_us, ended_us``. Rows with a null entity, time, start or ingestion take
    no part. Result: ``event_id, attribute, fact_id``; an attribute whose best fact
    had ended by the event gives no row. Equal starts: latest ingestion, then
    largest id. Rows of one fact id must be equal; give each once.
    """
    cut = lambda c: F.floor(c / F.lit(slice_us)).cast("long")
    e = events.filter("entity is not null and at_us is not null").select("event_id", "entity", "at_us", cut(F.col("at_us")).alias("slice"))
    f = facts.filter("entity is not null and start_us is not null and ingested_us is not null").select(
        "entity", "attribute", "id", "start_us", "ingested_us", "ended_us", F.greatest("start_us", "ingested_us").alias("at"))
    f = f.withColumn("slice", cut(F.col("at")))
    best = F.struct("start_us", "ingested_us", "id", "ended_us")
    tops = f.groupBy("entity", "attribute", "slice").agg(F.max(best).alias("top"))
    wanted = e.select("entity", "slice").distinct()
    attributes = tops.select("entity", "attribute").distinct()
    asks = wanted.join(attributes, "entity").select("entity", "attribute", "slice", F.lit(None).cast(tops.schema["top"].dataType).alias("top"), F.lit(1).alias("ask"))
    past = Window.partitionBy("entity", "attribute").orderBy("slice", "ask").rowsBetween(Window.unboundedPreceding, -1)
    line = tops.withColumn("ask", F.lit(2)).unionByName(asks)  # the ask of a slice comes before the slice's own facts
    carried = line.select("entity", "attribute", "slice", "ask", F.max("top").over(past).alias("top")).filter("ask = 1 and top is not null")
    nothing = F.lit(None).cast("long")
    rows = (
        carried.select("entity", "slice", "attribute", F.lit(0).alias("kind"), F.col("top.ingested_us").alias("at"), F.col("top.id").alias("id"), "top.start_us", "top.ingested_us", "top.ended_us")
        .unionByName(f.join(wanted, ["entity", "slice"], "left_semi").select("entity", "slice", "attribute", F.lit(0).alias("kind"), F.col("ingested_us").alias("at"), "id", "start_us", "ingested_us", "ended_us"))
        .unionByName(e.select("entity", "slice", F.lit(None).cast("string").alias("attribute"), F.lit(1).alias("kind"), F.col("at_us").alias("at"), F.col("event_id").alias("id"), nothing.alias("start_us"), nothing.alias("ingested_us"), nothing.alias("ended_us")))
    )
    return rows.repartition("entity", "slice").sortWithinPartitions("entity", "slice", "kind", "at").mapInPandas(_search, "event_id long, attribute string, fact_id long")
