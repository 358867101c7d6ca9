"""Previous and next row within a key, without one task per key.

A key may hold a third of all rows.  Rows are cut into buckets of the ordering
value; windows run within (key, bucket), and only the first and last row of
each bucket cross a border, through a table of one row per (key, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_neighbours(df: DataFrame, keys: list[str], order: str, cols: list[str], width: int, prev: str | None = "prev", nxt: str | None = "nxt") -> DataFrame:
    """Add structs of ``cols`` of the rows just before and after in ``order``.

    keys and order must be non-null, order distinct within a key; width is the
    bucket's extent in units of order. A missing neighbour is null.
    """
    b = df.withColumn("_b", F.floor(F.col(order) / F.lit(width)).cast("long"))
    row = F.struct(*cols)
    near = Window.partitionBy(*keys, "_b").orderBy(order)
    ends = b.groupBy(*keys, "_b").agg(F.min_by(row, order).alias("_head"), F.max_by(row, order).alias("_tail"))
    over = Window.partitionBy(*keys).orderBy("_b")
    ends = ends.select(*keys, "_b", F.lag("_tail").over(over).alias("_before"), F.lead("_head").over(over).alias("_after"))
    out = b.withColumn("_p", F.lag(row).over(near)).withColumn("_n", F.lead(row).over(near)).join(ends, [*keys, "_b"])
    if prev:
        out = out.withColumn(prev, F.coalesce("_p", "_before"))
    if nxt:
        out = out.withColumn(nxt, F.coalesce("_n", "_after"))
    return out.drop("_b", "_p", "_n", "_before", "_after")


def with_next(df: DataFrame, keys: list[str], piece: Column, order: list[Column], cols: list[str], name: str = "nxt") -> DataFrame:
    """Add a struct of ``cols`` of the row just behind in any total order, as above.

    keys must be non-null; ``piece`` cuts a key and must not decrease with the order.
    """
    row, near = F.struct(*cols), Window.partitionBy(*keys, "_b").orderBy(*order)
    b = df.withColumn("_b", piece)
    heads = b.groupBy(*keys, "_b").agg(F.min_by(row, F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)])).alias("_head"))
    heads = heads.select(*keys, "_b", F.lead("_head").over(Window.partitionBy(*keys).orderBy("_b")).alias("_after"))
    return b.withColumn("_n", F.lead(row).over(near)).join(heads, [*keys, "_b"]).withColumn(name, F.coalesce("_n", "_after")).drop("_b", "_n", "_after")


def joined_text(df: DataFrame, keys: list[str], piece: Column, order: list[str], text: Column, sep: str) -> DataFrame:
    """``keys, n, text``: the texts of each key in ``order``, joined; a large key is put together from ordered pieces.

    piece must not decrease with the order (null last); text must be non-null.
    """
    last = lambda c: [F.col(c).isNull(), F.col(c)]
    struct = F.struct(*[x.alias(f"_{i}") for i, x in enumerate(x for c in order for x in last(c))], F.col("_t"))
    of = lambda rows: F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["_t"]), sep)
    part = df.withColumns({"_t": text, "_b": piece}).groupBy(*keys, "_b").agg(F.count("*").alias("n"), of(struct).alias("_t"))
    return part.groupBy(*keys).agg(F.sum("n").alias("n"), of(F.struct(F.col("_b").isNull().alias("_n"), "_b", "_t")).alias("text"))


def around(df: DataFrame, key: str, order: str, reach: int, width: int) -> DataFrame:
    """Add ``around``: how many rows of the key lie within ``reach`` rows of each, itself included; buckets as above."""
    b = df.withColumn("_b", F.floor(F.col(order) / F.lit(width)).cast("long"))
    over = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    n = b.groupBy(key, "_b").agg(F.count("*").alias("_n"))
    n = n.select(key, "_b", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(key)).alias("_all"))
    at = F.col("_before") + F.row_number().over(Window.partitionBy(key, "_b").orderBy(order))
    out = b.join(n, [key, "_b"]).withColumn("_at", at)
    count = F.least(F.col("_at") - 1, F.lit(reach)) + 1 + F.least(F.col("_all") - F.col("_at"), F.lit(reach))
    return out.withColumn("around", count.cast("bigint")).drop("_b", "_before", "_all", "_at")
