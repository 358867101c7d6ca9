"""The k best texts of each query of a batch, when all queries meet all texts.

Equal texts have equal scores, so each is scored once, under its least id, and
its ids come back behind the cut.  Tasks hold all queries of a page and a share
of the texts; each keeps its k best per query by score, then id, and only
those become rows.  What a task has found so far bounds what can still enter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import materialise, wide_partitions

SALTS = 16
#: Rounding to six places moves a score by less than this.
SLACK = 1e-6


def distinct_texts(docs: DataFrame, key: str, k: int) -> DataFrame:
    """``gid, text, many, ids``: each text of ``key, text`` once, with its least id, the number of its ids and the k least of them.

    Written, as it is read for statistics, scores and ids.  A text's ids are
    gathered by residue first, so that a frequent text is no single list.
    """
    least = lambda ids: F.slice(F.array_sort(ids), 1, k)
    part = docs.groupBy("text", F.pmod(F.col(key), F.lit(SALTS)).alias("_s")).agg(F.collect_set(key).alias("ids"))
    part = part.select("text", F.size("ids").cast("bigint").alias("many"), least("ids").alias("ids")).repartition(wide_partitions(docs.sparkSession), "text")
    whole = part.groupBy("text").agg(F.sum("many").alias("many"), F.flatten(F.collect_list("ids")).alias("ids"))
    return materialise(whole.select("text", "many", least("ids").alias("ids")).select(F.col("ids")[0].alias("gid"), "text", "many", "ids"))


def shared_out(texts: DataFrame) -> DataFrame:
    """One task per core: each task's list of the best of every query is a row set of its own."""
    return texts.coalesce(max(1, texts.sparkSession.sparkContext.defaultParallelism))


def spread(hits: DataFrame, texts: DataFrame, k: int, key: str) -> DataFrame:
    """``qid, key, score, rank`` of the k best ids from the tasks' ``qid, gid, score``.

    An id among the k best belongs to one of the k best texts by score and least id.
    """
    cut = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "gid"))
    ids = hits.withColumn("_r", cut).filter(F.col("_r") <= k).drop("_r").join(texts.select("gid", "ids"), "gid").select("qid", F.explode("ids").alias(key), "score")
    return ids.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), key)).cast("bigint")).filter(F.col("rank") <= k)


class Best:
    """The k best of each query so far; ``tau`` is the score below which nothing enters."""

    def __init__(self, queries: int, k: int, least: float):
        self.k, self.tau = k, np.full(queries, least)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.kept = self.size = 0

    def add(self, q: np.ndarray, gid: np.ndarray, score: np.ndarray) -> None:
        ok = score >= self.tau[q]
        self.held.append((q[ok], gid[ok], score[ok]))
        self.size += int(ok.sum())
        if self.size > max(2 * self.kept, 1_000_000):
            self.cut()

    def cut(self, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Let go what is behind the k best; unless exact, those as good as the k-th all stay, if they are few."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, gid, score = (np.concatenate(c) for c in zip(*self.held))
        # scores have six places, so query and score fit into one number
        order = np.lexsort((gid, -score, q)) if exact else np.argsort((q.astype(np.int64) << 44) - np.rint(score * 1e6).astype(np.int64))
        q, gid, score = q[order], gid[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, np.arange(len(self.tau)))[q]
        full = place == self.k - 1
        self.tau[q[full]] = np.maximum(self.tau[q[full]], score[full])
        ok = place < self.k if exact else score >= self.tau[q]
        self.held = [(q[ok], gid[ok], score[ok])]
        self.kept = self.size = int(ok.sum())
        return self.held[0] if exact or self.kept < 1.5 * self.k * len(self.tau) else self.cut(True)

    def batches(self, names: pa.Array):
        q, gid, score = self.cut(True)
        for i in range(0, len(q), 100_000):
            at = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(q[at])), pa.array(gid[at]), pa.array(score[at])], names=["qid", "gid", "score"])
