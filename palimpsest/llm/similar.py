"""The most similar vectors of every vector.

A block matrix join.  Every vector goes to the blocks of its ``probes`` most
similar pivots, and of all others whose cosine is within ``MARGIN`` of the best
one's: inside a crowded group many pivots are about as near. Two similar vectors
share a block with high probability, and each block's rows are compared with each
other in tiles:

1. rows are quantised to int8 with one scale a row, and a tile of int8 products
   gives approximate cosines; the products are exact integers;
2. the residuals' norms bound each cosine from above and below (Cauchy-Schwarz),
   so a pair that cannot reach the threshold, or the row's k-th best lower
   bound, is dropped for certain;
3. the surviving pairs are recomputed in float, each row keeps its k best, and
   the lists of a row's blocks are merged to the k best of all.

Accuracy: within a block the result is exact; a pair is lost only if the two
share no pivot. The pivots are a hashed sample of at most MAX_PIVOTS directions,
one for every BLOCK directions; every vector is indexed. README has the recall
against brute force.

Copies: vectors of equal direction are one row of the join. Their pairs come
from the k + 1 smallest ids of the copies, so a direction that a third of all
rows share costs no more than its rows.

Scale: a block that holds more than MAX_BLOCK rows is cut into tile pairs that
go to different tasks. Only pivots and block counts (at most MAX_PIVOTS rows)
reach the driver.

Null, empty, all-zero vectors and vectors with a value that is not finite take
no part. Vectors of different dimension are never compared. Rows of one id must be
equal and count once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.sampling import hashed_sample
from palimpsest.session import materialise

BLOCK = 1024
MAX_PIVOTS = 32_768
MAX_BLOCK = 16_384
PROBES = 3
MARGIN = 0.04  # of cosine; in simulated groups of near vectors at 0.02 0.92 to 0.98 of the pairs are found, at 0.04 all
TILE = 1024
MAX_SENT = 100_000  # rows of a table that may be broadcast
FLOAT_SLACK = 1e-6  # rounding of the float32 inputs


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim) if len(column) else np.zeros((0, dim), np.float32)


def directions(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, dim, copy, vec``: unit vectors as float32 bytes and a hash of the direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            lens = np.asarray(col.value_lengths().fill_null(0))
            ids, dims, vecs = [], [], []
            for dim in np.unique(lens[lens > 0]):
                at = np.flatnonzero(lens == dim)
                part = col.take(pa.array(at)).flatten()
                m = np.asarray(part.fill_null(float("nan")), dtype=np.float64).reshape(-1, dim)
                norm = np.sqrt((m * m).sum(1))
                ok = np.isfinite(norm) & (norm > 0)
                unit = (m[ok] / norm[ok, None]).astype(np.float32)
                ids.append(at[ok])
                dims.append(np.full(int(ok.sum()), dim))
                vecs += [u.tobytes() for u in unit]
            if not vecs:
                continue
            grid = [np.rint(np.frombuffer(v, np.float32) * 1e5).astype(np.int32).tobytes() for v in vecs]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(np.concatenate(ids))), pa.array(np.concatenate(dims), pa.int32()), pa.array(vecs, pa.binary()), pa.array(grid, pa.binary())],
                names=["id", "dim", "vec", "grid"])

    out = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v")).mapInArrow(run, "id bigint, dim int, vec binary, grid binary")
    return out.select("id", "dim", F.xxhash64("dim", "grid").alias("copy"), "vec")


def pivots(unit: DataFrame, rows: int, block: int = BLOCK) -> dict[int, np.ndarray]:
    """A hashed sample of about one in ``block`` vectors, at most MAX_PIVOTS, by dimension."""
    n = min(MAX_PIVOTS, max(1, math.ceil(rows / block)))
    got = hashed_sample(unit.select("dim", "vec", "copy"), n, "copy", rows=rows).select("dim", "vec").collect()
    by: dict[int, list[bytes]] = {}
    for r in got:
        by.setdefault(r["dim"], []).append(bytes(r["vec"]))
    return {d: np.frombuffer(b"".join(v), np.float32).reshape(-1, d) for d, v in by.items()}


def _assign(piv: dict[int, np.ndarray], probes: int, tiles: dict[int, int] | None):
    """Rows ``block, side, id, vec``, the tile pair in the low half of ``block``; without tiles only ``block``."""
    base, at = {}, 0
    for d in sorted(piv):
        base[d], at = at, at + len(piv[d])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.asarray(b.column("dim"))
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                take = pa.array(rows)
                col = b.column("vec").take(take)
                if d not in piv:  # a dimension so rare that the sample has none of it
                    where, block = np.arange(len(rows)), np.full(len(rows), -int(d))
                else:
                    like = _matrix(col, d) @ piv[d].T
                    p = min(probes, like.shape[1])
                    near = like >= like.max(1, keepdims=True) - MARGIN
                    np.put_along_axis(near, np.argpartition(-like, p - 1, axis=1)[:, :p], True, axis=1)
                    where, block = np.nonzero(near)
                    block = base[d] + block
                if tiles is None:
                    yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32())], names=["block"])
                    continue
                ids = np.asarray(b.column("id"))[rows]
                cuts = np.array([tiles.get(int(x), 1) for x in block])
                pair, side = np.zeros(len(block), np.int64), np.zeros(len(block), np.int8)
                if (cuts > 1).any():
                    out = [[], [], [], []]
                    for w, x, c in zip(where.tolist(), block.tolist(), cuts.tolist()):
                        mine = (int(ids[w]) * 0x9E3779B97F4A7C15 >> 7) % c
                        for other in range(c):
                            lo, hi = min(mine, other), max(mine, other)
                            for k, v in enumerate((w, x, lo * c + hi, 0 if lo == hi else 1 + (mine == hi))):
                                out[k].append(v)
                    where, block, pair, side = (np.array(o) for o in out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.astype(np.int64) << 32 | pair, pa.int64()), pa.array(side, pa.int8()), pa.array(ids[where]), col.take(pa.array(where))],
                    names=["block", "side", "id", "vec"])

    return run


def quantise(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and norm of the residual of each row."""
    scale = np.maximum(np.abs(m).max(1), 1e-30) / 127
    codes = np.rint(m / scale[:, None]).astype(np.int8)
    rest = np.sqrt(((m - codes * scale[:, None]) ** 2).sum(1))
    return codes, scale.astype(np.float32), rest.astype(np.float32)


def tile_pairs(a: np.ndarray, b: np.ndarray, k: int, least: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers and cosines of the pairs of two matrices that may be among a row's or column's k best."""
    qa, sa, ra = quantise(a)
    qb, sb, rb = (qa, sa, ra) if same else quantise(b)
    fa, fb = qa.astype(np.float32), qb.astype(np.float32)
    out_i, out_j = [], []
    for i in range(0, len(a), TILE):
        for j in range(i if same else 0, len(b), TILE):
            # products of int8 codes are whole numbers below 2^24 for up to 1,040 dimensions, so float32 holds them exactly
            approx = (fa[i:i + TILE] @ fb[j:j + TILE].T) * sa[i:i + TILE, None] * sb[None, j:j + TILE]
            error = ra[i:i + TILE, None] + (1 + ra[i:i + TILE, None]) * rb[None, j:j + TILE] + FLOAT_SLACK
            upper = approx + error
            keep = upper >= least
            if keep.sum() > 4 * k * sum(keep.shape) and min(keep.shape) > k:
                lower = np.where(keep, approx - error, -2)
                if same and i == j:
                    np.fill_diagonal(lower, -2)
                row = np.partition(lower, -k, axis=1)[:, -k]
                column = np.partition(lower, -k, axis=0)[-k, :]
                keep &= (upper >= row[:, None]) | (upper >= column[None, :])
            x, y = np.nonzero(keep)
            if same and i == j:
                x, y = x[x < y], y[x < y]
            out_i.append(x + i)
            out_j.append(y + j)
    x, y = np.concatenate(out_i), np.concatenate(out_j)
    cos = np.concatenate([np.einsum("ij,ij->i", a[x[s:s + 65_536]].astype(np.float64), b[y[s:s + 65_536]].astype(np.float64)) for s in range(0, len(x), 65_536)] or [np.zeros(0)])
    ok = cos >= least
    return x[ok], y[ok], cos[ok]


def k_best(ids: np.ndarray, others: np.ndarray, cos: np.ndarray, k: int) -> np.ndarray:
    """Positions of each id's k best partners, on equal cosine the smaller id first."""
    order = np.lexsort((others, -cos, ids))
    sorted_ids = ids[order]
    start = np.flatnonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1]]) if len(order) else np.zeros(0, int)
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    return order[place < k]


def _join(k: int, least: float):
    def best(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(parts).combine_chunks()
        widths = np.asarray(pc.binary_length(t.column("vec")))
        out = []
        for w in np.unique(widths):
            at = np.flatnonzero(widths == w)
            at = at[np.unique(np.asarray(t.column("id"))[at] * 4 + np.asarray(t.column("side"))[at], return_index=True)[1]]  # a row delivered twice counts once
            u = t.take(pa.array(at))
            ids, side = np.asarray(u.column("id")), np.asarray(u.column("side"))
            m = _matrix(u.column("vec"), w // 4)
            if (side == 0).all():
                x, y, cos = tile_pairs(m, m, k, least, True)
                a, b = ids[x], ids[y]
            else:
                left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
                if not len(left) or not len(right):
                    continue
                x, y, cos = tile_pairs(m[left], m[right], k, least, False)
                a, b = ids[left][x], ids[right][y]
            a, b, cos = np.r_[a, b], np.r_[b, a], np.r_[cos, cos]
            top = k_best(a, b, cos, k)
            out.append((a[top], b[top], cos[top]))
        if not out:
            return None
        a, b, cos = (np.concatenate(c) for c in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(cos)], names=["id", "other", "cos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            block = np.asarray(batch.column("block"))
            change = np.flatnonzero(block[1:] != block[:-1]) + 1
            for s, e in zip(np.r_[0, change].tolist(), np.r_[change, len(block)].tolist()):
                if e == s:
                    continue
                if int(block[s]) != key:
                    if parts and (done := best(parts)) is not None:
                        yield done
                    key, parts = int(block[s]), []
                parts.append(batch.slice(s, e - s))
        if parts and (done := best(parts)) is not None:
            yield done

    return run


def nearest(df: DataFrame, key: str, vector: str, k: int = 8, least: float = -1.0, probes: int = PROBES, block: int = BLOCK, max_block: int = MAX_BLOCK) -> DataFrame:
    """``id, other, cos``: the k most similar rows of each row with a cosine of at least ``least``."""
    unit = directions(df, key, vector)
    rank = F.row_number().over(Window.partitionBy("copy").orderBy("id"))
    # the k + 1 smallest ids of each direction that several rows share
    firsts = unit.select("copy", "id").distinct().withColumn("r", rank).filter(F.col("r") <= k + 1).groupBy("copy").agg(F.array_sort(F.collect_list("id")).alias("firsts")).filter(F.size("firsts") > 1)
    firsts = materialise(firsts)
    shared = firsts.select("copy", F.col("firsts")[0].alias("head"))
    if firsts.limit(MAX_SENT + 1).count() <= MAX_SENT:
        shared = F.broadcast(shared)
    alone = unit.join(shared, "copy", "left").filter(F.col("head").isNull() | (F.col("id") == F.col("head")))

    piv = pivots(alone, alone.count(), block)
    counts = {r["block"]: r["count"] for r in unit.select("id", "dim", "vec").mapInArrow(_assign(piv, probes, None), "block int").groupBy("block").count().filter(F.col("count") > max_block).collect()}
    tiles = {b: math.ceil(n / max_block) for b, n in counts.items()}
    spread = alone.select("id", "dim", "vec").mapInArrow(_assign(piv, probes, tiles), "block bigint, side byte, id bigint, vec binary")
    found = spread.repartition("block").sortWithinPartitions("block").mapInArrow(_join(k, least), "id bigint, other bigint, cos double")
    one = F.struct((-F.col("cos")).alias("far"), F.col("other").alias("other"))
    best = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k)  # noqa: E731  at most k of each block
    lists = found.groupBy("id").agg(best(F.collect_list(one)).alias("near"))

    # partners that stand for several rows give way to the smallest of those
    heads = firsts.select(F.col("firsts")[0].alias("head"), F.col("firsts").alias("members"))
    flat = lists.select("id", F.explode("near").alias("n")).select("id", "n.far", F.col("n.other").alias("head"))
    flat = flat.join(heads, "head", "left").select("id", "far", F.explode(F.coalesce("members", F.array("head"))).alias("other"))
    lists = materialise(flat.groupBy("id").agg(best(F.collect_list(F.struct("far", "other"))).alias("near")))  # read twice below
    plain = lists.join(heads.select(F.col("head").alias("id")), "id", "left_anti").select("id", "near")
    copies = unit.select("id", "copy").join(firsts, "copy").select("id", "firsts", F.col("firsts")[0].alias("head")).dropDuplicates(["id"])
    copies = copies.join(lists.withColumnRenamed("id", "head"), "head", "left")
    own = F.transform(F.array_remove("firsts", F.col("id")), lambda x: F.struct(F.lit(-1.0).alias("far"), x.alias("other")))
    empty = F.expr("cast(array() as array<struct<far:double,other:bigint>>)")
    copies = copies.select("id", F.slice(F.concat(own, F.coalesce("near", empty)), 1, k).alias("near"))
    both = plain.unionByName(copies).select("id", F.explode("near").alias("n"))
    return both.select("id", "n.other", (-F.col("n.far")).alias("cos"))
