"""Putting items into containers of fixed capacity.

Best fit, largest item first: bins stand in order of their free room, and a
successor search from the item's size upward takes the tightest bin that is
compatible.  A bin carries one bitmap of the sources and one of the duplicate
clusters in it.  Each source and each cluster owns as many bits as one container
must at least take of it if it is spread evenly (``quota``); an item is
compatible while one of its bits is free.  So copies of one text and texts of
one source are kept apart as far as that costs no room.

Items larger than the capacity are split into full pieces and a rest; no other
item is split. Items of size 0 (null or empty texts) are put in too. Null
sources form one source.

Scale: items are spread by hash over shards of bounded size; each shard is
packed by itself, and the items of containers that stay clearly underfilled are
packed again together, in shards of the same size. A source or cluster that
holds a third of all rows is spread like any other.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import materialise

SHARD_ROWS = 8192
MAX_BUDGETS = 1000
UNDERFILLED = 0.97


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """The bin of each item; every size is at most the capacity."""
    bins_least = max(1, math.ceil(sum(sizes) / capacity))

    def bits(of: list) -> dict:
        count: dict = {}
        for x in of:
            count[x] = count.get(x, 0) + 1
        out, at = {}, 0
        for x, n in count.items():
            if n == 1:
                out[x] = (0, 0)  # no conflict is possible
                continue
            quota = math.ceil(1.25 * n / bins_least)
            out[x] = (((1 << quota) - 1) << at, at)
            at += quota
        return out

    source_bits, cluster_bits = bits(sources), bits(clusters)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, chosen = 0, [0] * len(sizes)
    taken_source: list[int] = []
    taken_cluster: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size, (sm, _), (cm, _) = sizes[i], source_bits[sources[i]], cluster_bits[clusters[i]]
        found, above = -1, open_rooms >> size
        while above:
            room = size + ((above & -above).bit_length() - 1)
            stack = rooms[room]
            for k in range(len(stack) - 1, -1, -1):
                b = stack[k]
                if (not sm or taken_source[b] & sm != sm) and (not cm or taken_cluster[b] & cm != cm):
                    found = b
                    stack[k] = stack[-1]
                    stack.pop()
                    break
            if found >= 0:
                if not stack:
                    open_rooms &= ~(1 << room)
                break
            above &= above - 1
        if found < 0:
            found, room = len(taken_source), capacity
            taken_source.append(0)
            taken_cluster.append(0)
        for mask, taken in ((sm, taken_source), (cm, taken_cluster)):
            free = mask & ~taken[found]
            taken[found] |= free & -free
        room -= size
        rooms[room].append(found)
        open_rooms |= 1 << room
        chosen[i] = found
    return chosen


def _pack(round_no: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = int(pdf["capacity"].iloc[0])
        pdf = pdf.sort_values(["item", "piece"], kind="stable").reset_index(drop=True)
        chosen = best_fit(pdf["length"].tolist(), pdf["source"].fillna("\0").tolist(), pdf["cluster"].tolist(), capacity)
        pdf["container"] = [f"{round_no}-{s}-{b}" for s, b in zip(pdf["shard"], chosen)]
        pdf["filled"] = pdf.groupby("container")["length"].transform("sum")
        return pdf

    return pack


_ROWS = "budget string, capacity bigint, item bigint, source string, cluster bigint, piece int, start bigint, length bigint, shard bigint"


def _round(items: DataFrame, n: int, rows: int, shard_rows: int) -> DataFrame:
    shards = max(1, math.ceil(rows / shard_rows))
    spread = items.withColumn("shard", F.pmod(F.xxhash64("item", "piece", F.lit(n)), F.lit(shards)))
    return spread.groupBy("budget", "shard").applyInPandas(_pack(n), f"{_ROWS}, container string, filled bigint")


def pack(items: DataFrame, budgets: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pack the items into containers of each budget.

    items: ``item, source, cluster, size``; budgets (a few rows): ``budget, capacity``.
    Result: ``budget, capacity, container, item, piece, start, length``; piece
    numbers count from 1 and start and length are positions within the item.
    """
    b = budgets.select("budget", F.greatest(F.col("capacity"), F.lit(1)).alias("capacity"))
    few = b.limit(MAX_BUDGETS + 1).collect()  # a list of budgets is a setting, not data
    if len(few) > MAX_BUDGETS:
        raise ValueError(f"more than {MAX_BUDGETS} budgets")
    each = F.array(*[F.struct(F.lit(r["budget"]).alias("budget"), F.lit(r["capacity"]).cast("bigint").alias("capacity")) for r in few])
    every = items.withColumn("b", F.explode(each if few else F.expr("cast(array() as array<struct<budget:string,capacity:bigint>>)"))).select("*", "b.*")
    size, cap = F.col("size"), F.col("capacity")
    whole = every.withColumn("piece", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(size / cap)).cast("int"))))
    start = (F.col("piece") - 1) * cap
    pieces = whole.select("budget", "capacity", "item", "source", "cluster", "piece", start.cast("bigint").alias("start"), F.least(cap, size - start).cast("bigint").alias("length"))
    pieces = materialise(pieces)
    rows = pieces.groupBy("budget").count().agg(F.max("count")).first()[0] or 0
    first = materialise(_round(pieces, 1, rows, shard_rows))
    under = first.filter(F.col("filled") < F.lit(UNDERFILLED) * F.col("capacity"))
    n_under = under.groupBy("budget").count().agg(F.max("count")).first()[0] or 0
    again = _round(under.drop("container", "filled", "shard"), 2, n_under, shard_rows)
    done = first.filter(F.col("filled") >= F.lit(UNDERFILLED) * F.col("capacity"))
    cols = ["budget", "capacity", "container", "item", "piece", "start", "length"]
    return done.select(cols).unionByName(again.select(cols))
