"""Exact similarity search for a batch of query vectors.

Query vectors are taken in blocks of QUERY_BLOCK rows, so that what is sent to
the executors is bounded; each block is compared with every row by one matrix
product per Arrow batch, which keeps the k best of the batch, and the batches'
lists are merged by a window that starts with a partial cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.topk import SLACK, Best, distinct_texts, shared_out, spread

QUERY_BLOCK, TEXT_BLOCK = 20_000, 2048


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / (norm(a) * norm(b))


def sound(v: Column) -> Column:
    """Not null, not zero, all values finite."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & (norm(v) > 0)


def search(rows: DataFrame, queries: DataFrame, k: int = 10, least: float = -1.0, keep_self: bool = False) -> DataFrame:
    """``qid, id, score, rank``: exact k best rows by cosine (rounded to 6 places, then smaller id).

    rows: ``id, v``; queries: ``qid, v``. Vectors that are null, zero or of another
    dimension than the query take no part.
    """
    parts, after = [], None
    while True:
        q = queries.filter(sound(F.col("v"))).select("qid", F.col("v").cast("array<double>").alias("v")).orderBy("qid")
        got = (q if after is None else q.filter(F.col("qid") > F.lit(after))).limit(QUERY_BLOCK).collect()
        if got or not parts:
            parts.append(rows.select("id", F.col("v").cast("array<double>").alias("v")).mapInArrow(_block(got, k, least, keep_self), f"qid {queries.schema['qid'].dataType.simpleString()}, id bigint, score double"))
        if len(got) < QUERY_BLOCK:
            break
        after = got[-1]["qid"]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")).cast("bigint"))
    return ranked.filter(F.col("rank") <= k)


def search_texts(docs: DataFrame, queries: DataFrame, counts: Callable[[list[str]], np.ndarray], k: int, least: float = SLACK) -> DataFrame:
    """``qid, id, score, rank`` as ``search``, of ``id, text`` and ``qid, question`` by counts of their features.

    Features are counted where they are compared, so no vector is a row. Products
    of counts are whole numbers, exact as 32-bit floats below 2^24 and else as 64-bit ones.
    """
    texts = distinct_texts(docs.select("id", "text"), "id", k)
    kind, out, after = queries.schema["qid"].dataType.simpleString(), None, None
    while True:
        q = queries.select("qid", "question").orderBy("qid")
        got = (q if after is None else q.filter(F.col("qid") > F.lit(after))).limit(QUERY_BLOCK).collect()
        if got or out is None:
            part = shared_out(texts.select("gid", "text")).mapInArrow(_counted(got, counts, k, least), f"qid {kind}, gid bigint, score double")
            out = part if out is None else out.unionByName(part)
        if len(got) < QUERY_BLOCK:
            break
        after = got[-1]["qid"]
    return spread(out, texts, k, "id")


def _counted(got: list, counts: Callable[[list[str]], np.ndarray], k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not got:
            return
        m = np.concatenate([counts([r["question"] for r in got[i:i + 1024]]).astype(np.float32) for i in range(0, len(got), 1024)])
        length = np.sqrt(np.concatenate([(m[i:i + 1024].astype(float) ** 2).sum(1) for i in range(0, len(m), 1024)]))
        best = Best(len(got), k, least)

        def meet(gid: np.ndarray, v: np.ndarray, kind: type) -> None:
            """Texts with counts v; a coarse score decides what is computed exactly."""
            n = np.sqrt((v * v).sum(1))
            gid, v, n = gid[n > 0], v[n > 0], n[n > 0]
            if not len(n):
                return
            right, scale = np.ascontiguousarray(v.astype(kind).T), (1 / n).astype(kind)
            for i in range(0, len(m), 1024):
                own = length[i:i + 1024]
                s = m[i:i + 1024].astype(kind, copy=False) @ right
                s *= scale
                bound = ((best.tau[i:i + 1024] - SLACK) * own * (1 - 1e-6)).astype(kind)
                x, y = np.nonzero(s >= np.maximum(bound, np.finfo(kind).tiny)[:, None])
                if len(x) > 4 * k * len(own):  # the k-th of these texts bounds as well
                    kth = np.partition(s, -k, axis=1)[:, -k] * (1 - 1e-6) - 2 * SLACK * own
                    x, y = np.nonzero(s >= np.maximum(np.maximum(bound, kth), np.finfo(kind).tiny)[:, None])
                dot = np.rint(s[x, y] * n[y])  # scaling moved a whole number by less than a half
                best.add(x + i, gid[y], np.round(dot / (own[x] * n[y]), 6))

        for b in batches:
            for at in range(0, len(b), TEXT_BLOCK):
                part = b.slice(at, TEXT_BLOCK)
                v, gid = counts(part.column("text").to_pylist()), np.asarray(part.column("gid"))
                # by Cauchy and Schwarz a product stays below the lengths' product
                small = np.sqrt((v * v).sum(1)) * length.max() < 2 ** 22
                meet(gid[small], v[small], np.float32)
                if not small.all():
                    meet(gid[~small], v[~small], np.float64)
        yield from best.batches(pa.array([r["qid"] for r in got]))

    return run


def feedback(rows: DataFrame, queries: DataFrame, k: int = 10, seeds: int = 3, weight: float = 0.5) -> DataFrame:
    """``search`` with each query moved by ``weight`` times the mean of its nearest ``seeds`` rows; unit vectors are expected."""
    near = search(rows, queries, seeds).select("qid", "id").join(rows, "id")
    mean = near.select("qid", F.posexplode("v").alias("i", "x")).groupBy("qid", "i").agg((F.avg("x") * weight).alias("x"))
    shift = mean.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("m"))
    moved = queries.join(shift, "qid").select("qid", F.zip_with("v", F.transform("m", lambda e: e["x"]), lambda a, b: a + b).alias("v"))
    return search(rows, moved, k)


def _block(got: list, k: int, least: float, keep_self: bool):
    ids = [r["qid"] for r in got]
    dims: dict[int, list[int]] = {}
    for i, r in enumerate(got):
        dims.setdefault(len(r["v"]), []).append(i)
    blocks = {d: (np.array(at), _unit(np.array([got[i]["v"] for i in at]))) for d, at in dims.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.array(ids).type if ids else pa.int64()
        for b in batches:
            col = b.column("v")
            lens = np.asarray(col.value_lengths().fill_null(0))
            for d, (at, m) in blocks.items():
                rows = np.flatnonzero(lens == d)
                if not len(rows):
                    continue
                v = np.asarray(col.take(pa.array(rows)).flatten().fill_null(float("nan"))).reshape(-1, d)
                ok = np.isfinite(v).all(1) & (np.abs(v).max(1) > 0)
                rows, v = rows[ok], v[ok]
                rid = np.asarray(b.column("id"))[rows]
                for s in range(0, len(m), 1024):
                    score = np.round(m[s:s + 1024] @ _unit(v).T, 6)
                    if not keep_self:
                        score[np.array([ids[i] for i in at[s:s + 1024]])[:, None] == rid[None, :]] = -2
                    order = np.lexsort((np.broadcast_to(rid, score.shape), -score), axis=1)[:, :k]
                    best = np.take_along_axis(score, order, 1)
                    x, y = np.nonzero(best >= max(least, -1.0))
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array([ids[at[s + i]] for i in x], kind), pa.array(rid[order[x, y]]), pa.array(best[x, y])], names=["qid", "id", "score"])

    return run


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(n == 0, 1, n)


def gram_buckets(docs: DataFrame, dim: int = 256, sizes: tuple[int, ...] = (3, 4)) -> DataFrame:
    """Hashed character n-grams of ``id, text``: ``id, bucket, weight`` with weights of unit length.

    A gram's bucket is the first four bytes of its MD5 as a number, modulo ``dim``.
    """
    t = F.lower(F.coalesce("text", F.lit("")))

    def of(n: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - (n - 1)))
        return F.when(F.length(t) >= n, F.transform(at, lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    grams = F.concat(*[of(n) for n in sizes])
    each = docs.select("id", F.explode(grams).alias("g"))
    bucket = F.conv(F.substring(F.md5("g"), 1, 8), 16, 10).cast("bigint") % dim
    counts = each.select("id", bucket.alias("bucket")).groupBy("id", "bucket").count()
    length = F.sqrt(F.sum(F.col("count") * F.col("count")).over(Window.partitionBy("id")))
    return counts.select("id", "bucket", F.round(F.col("count") / length, 6).alias("weight"))
