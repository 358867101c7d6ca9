"""Retrieval evaluation: recall, reciprocal rank, AUC, percentiles, paired tests, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEPTHS = (1, 3, 5, 10, 20, 50)


def recall(ranked: DataFrame, relevant: DataFrame, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """Per query: share of relevant ids at or above each depth, whether all are there, and the reciprocal rank.

    ranked: ``qid, id, rank``; relevant: ``qid, id``. Every query with a relevant id
    counts, also one for which nothing was found.
    """
    r = relevant.select("qid", "id").distinct().join(ranked.select("qid", "id", "rank"), ["qid", "id"], "left")
    aggs = []
    for k in depths:
        hit = F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))
        aggs += [F.round(F.avg(hit), 6).alias(f"recall_{k}"), F.min(hit).cast("bigint").alias(f"all_{k}")]
    return r.groupBy("qid").agg(*aggs, F.round(F.coalesce(F.lit(1.0) / F.min("rank"), F.lit(0.0)), 6).alias("mrr"))


def report(scored: DataFrame, group: str, *metrics: str) -> DataFrame:
    """Means overall and by group, as grouping sets; the overall row's group is null."""
    aggs = [F.round(F.avg(m), 6).alias(m) for m in metrics]
    return scored.groupingSets([[], [F.col(group)]], F.col(group)).agg(F.grouping(group).cast("bigint").alias("overall"), F.count("*").alias("n"), *aggs)


def auc(scored: DataFrame, group: str, score: str, positive: Column) -> DataFrame:
    """``group, pos, neg, auc``: share of positive-negative pairs in order, ties half, by mean ranks.

    Equal scores are folded before the window, so a group's window holds one row
    per distinct score.
    """
    tied = scored.groupBy(group, score).agg(F.count("*").alias("_c"), F.sum(positive.cast("bigint")).alias("_p"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = tied.withColumn("_rank", before + (F.col("_c") + 1) / 2)
    s = ranks.groupBy(group).agg(F.sum("_p").alias("pos"), F.sum(F.col("_c") - F.col("_p")).alias("neg"), F.sum(F.col("_rank") * F.col("_p")).alias("_ranks"))
    u = F.col("_ranks") - F.col("pos") * (F.col("pos") + 1) / 2
    return s.select(group, "pos", "neg", F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.round(u / (F.col("pos") * F.col("neg")), 6)).alias("auc"))


def mcnemar(pairs: DataFrame, a: Column, b: Column) -> DataFrame:
    """Counts of discordant pairs and the exact two-sided p value of the sign test."""
    got = pairs.agg(F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c"))
    n, k = F.col("b") + F.col("c"), F.least("b", "c")
    # log factorials by a running sum; the tail is at most half of n terms
    lf = lambda x: F.aggregate(F.when(x > 1, F.sequence(F.lit(2).cast("bigint"), x)).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    tail = F.aggregate(F.sequence(F.lit(0).cast("bigint"), k), F.lit(0.0), lambda s, i: s + F.exp(lf(n) - lf(i) - lf(n - i) - n * F.lit(0.6931471805599453)))
    return got.select("b", "c", F.round(F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail)), 6).alias("p"))


def nearest_rank(values: DataFrame, value: str, p: float, group: list[str]) -> DataFrame:
    """The ceil(p n)-th value of each group."""
    return values.groupBy(*group).agg(F.expr(f"percentile_disc({p}) within group (order by {value})").cast("double").alias("value"))


def bootstrap(pairs: DataFrame, a: str, b: str, rounds: int = 2000) -> DataFrame:
    """Interval of the mean difference by resampling: each row's weight of a round is a Poisson(1) draw from its hash.

    Weights come from hashes, so the rounds are one aggregation over rows and
    rounds and any rerun gives the same interval. pairs needs ``qid``.
    """
    diff = (F.col(a) - F.col(b)).cast("double")
    u = (F.pmod(F.xxhash64("qid", "round"), F.lit(1 << 24)) + 0.5) / F.lit(float(1 << 24))
    edges = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)
    weight = sum(((u > e).cast("int") for e in edges), F.lit(0))
    each = pairs.select("qid", diff.alias("d"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).select("round", "d", weight.alias("w"))
    means = each.groupBy("round").agg((F.sum(F.col("d") * F.col("w")) / F.sum("w")).alias("m"))
    return means.agg(F.round(F.expr("percentile(m, 0.025)"), 6).alias("low"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.expr("percentile(m, 0.975)"), 6).alias("high"))


def round_robin(rows: DataFrame, stratum: str, order: str, n: int) -> DataFrame:
    """A stratified sample: the first of each stratum, then the second, and so on, up to n."""
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(order))
    return rows.withColumn("turn", turn.cast("bigint")).filter(F.col("turn") <= n).orderBy("turn", stratum, order).limit(n)
