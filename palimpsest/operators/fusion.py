"""Fusing ranked channels and shaping the result of a batch of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Channel weights of rank fusion, and its rank constant.
WEIGHTS = {"vec": 1.0, "bm25": 0.9, "entity": 0.6, "hop2": 0.4, "temporal": 0.6, "key": 0.7}
RRF_K = 60
ASSISTANT, IN_WINDOW, DATEISH, OTHER_SPEAKER, SESSION = 0.2, 0.25, 0.15, 0.75, 0.25


def by_rank(qid: str = "qid", score: str = "score", key: str = "id") -> Column:
    return F.row_number().over(Window.partitionBy(qid).orderBy(F.desc(score), key))


def reciprocal_ranks(channels: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """``qid, kind, id, score, channels`` of channels of ``qid, kind, id, rank`` (rank from 1): sum of weight / (60 + rank)."""
    w = weights or WEIGHTS
    rows = [c.select("qid", "kind", "id", F.lit(name).alias("channel"), (F.lit(w[name]) / (RRF_K + F.col("rank"))).alias("part")) for name, c in channels.items()]
    fused = reduce(DataFrame.unionByName, rows).groupBy("qid", "kind", "id").agg(F.round(F.sum("part"), 9).alias("score"), F.concat_ws(",", F.array_sort(F.collect_list("channel"))).alias("channels"))
    return fused


def ratio_to_max(score: str, qid: str = "qid") -> Column:
    top = F.max(score).over(Window.partitionBy(qid))
    return F.when(top > 0, F.col(score) / top).otherwise(F.lit(1.0))


def min_max(score: str, least_spread: float = 0.25, qid: str = "qid") -> Column:
    w = Window.partitionBy(qid)
    hi = F.max(score).over(w)
    lo = F.least(F.min(score).over(w), hi - least_spread)
    return F.when(hi <= lo, F.lit(1.0)).otherwise((F.col(score) - lo) / (hi - lo))


def convex(lexical: DataFrame, semantic: DataFrame, lexical_share: float = 0.5) -> DataFrame:
    """``qid, id, score``: weighted sum of both channels' normalised scores; a missing channel counts 0."""
    a = lexical.select("qid", "id", (ratio_to_max("score") * lexical_share).alias("part"))
    b = semantic.select("qid", "id", (min_max("score") * (1 - lexical_share)).alias("part"))
    return a.unionByName(b).groupBy("qid", "id").agg(F.round(F.sum("part"), 6).alias("score"))


def session_roll_up(scored: DataFrame, share: float = SESSION) -> DataFrame:
    """Add ``share`` of the session's best score (at least 0); a row without session stands alone."""
    group = F.coalesce("session_id", F.concat(F.lit("#"), F.col("id").cast("string")))
    best = F.greatest(F.max("score").over(Window.partitionBy("qid", group)), F.lit(0.0))
    return scored.withColumn("score", F.round(F.col("score") + share * best, 8))


def session_diverse(ranked: DataFrame, k: int) -> DataFrame:
    """Replace repeated sessions in the top k by the best rows of sessions not in it.

    ranked: ``qid, id, session_id, rank`` from 1, at least as deep as replacements
    are wanted. Result: the k rows a query keeps, ``place`` by original rank.
    """
    s = F.coalesce("session_id", F.concat(F.lit("#"), F.col("id").cast("string")))
    r = ranked.withColumn("s", s).withColumn("seen", F.row_number().over(Window.partitionBy("qid", "s").orderBy("rank")))
    r = r.withColumn("top", F.col("rank") <= k)
    w = Window.partitionBy("qid")
    dup = F.col("top") & (F.col("seen") > 1)
    fresh = ~F.col("top") & (F.col("seen") == 1)
    r = r.withColumn("dup_no", F.when(dup, F.row_number().over(Window.partitionBy("qid", dup).orderBy("rank")))).withColumn("fresh_no", F.when(fresh, F.row_number().over(Window.partitionBy("qid", fresh).orderBy("rank"))))
    r = r.withColumn("m", F.least(F.sum(dup.cast("int")).over(w), F.sum(fresh.cast("int")).over(w)))
    kept = r.filter((F.col("top") & (F.col("dup_no").isNull() | (F.col("dup_no") > F.col("m")))) | (F.col("fresh_no") <= F.col("m")))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("rank")).cast("bigint")).drop("s", "seen", "top", "dup_no", "fresh_no", "m")


def evidence_priors(scored: DataFrame) -> DataFrame:
    """The evidence engine's priors in their fixed order on ``score``.

    Columns read: ``side`` (user or reply), ``addressed`` (the question addresses
    the assistant), ``in_window``, ``asks_when``, ``dateish``, ``other_speaker``.
    """
    s = F.col("score")
    s = F.when((F.col("side") == "reply") & ~F.col("addressed"), s * ASSISTANT).otherwise(s)
    s = F.when(F.col("in_window"), s + IN_WINDOW).otherwise(s)
    s = F.when(F.col("asks_when") & F.col("dateish"), s + DATEISH).otherwise(s)
    s = F.when(F.col("other_speaker"), s * OTHER_SPEAKER).otherwise(s)
    return scored.withColumn("score", F.round(s, 8))


def first_of_prefix(rows: DataFrame, n: int = 80) -> DataFrame:
    """Of rows with one session and one beginning of content keep the first by rank."""
    w = Window.partitionBy("qid", F.coalesce("session_id", F.lit("")), F.substring("content", 1, n)).orderBy("rank")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def slots(rows: DataFrame, k: int, extra_k: int, extra: Column) -> DataFrame:
    """The first k ordinary rows and, in addition, the first ``extra_k`` of a class."""
    w = Window.partitionBy("qid", extra).orderBy("rank")
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= F.when(extra, F.lit(extra_k)).otherwise(F.lit(k))).drop("_n")
