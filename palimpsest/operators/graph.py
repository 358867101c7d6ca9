"""Entity hops, aliases, containment matches and lineage, as equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.session import materialise

MAX_DEPTH = 5
HOP_ENTITIES = 20


def resolve_aliases(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Replace ``name`` by its canonical form where an alias says so; chains are followed one step, as written."""
    a = aliases.select(F.lower(F.trim("alias")).alias("name"), F.lower(F.trim("canonical")).alias("canonical")).dropDuplicates(["name"])
    return names.join(a, "name", "left").withColumn("name", F.coalesce("canonical", "name")).drop("canonical")


def contained(queries: DataFrame, vocabulary: DataFrame, most: int | None = 10) -> DataFrame:
    """``qid, name``: names all of whose tokens the query has, at most ``most`` by name (None: all).

    Tokens meet by an equi-join and are counted, so the vocabulary is never
    paired with all queries.
    """
    word = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([a-z][a-z0-9'-]+)"), F.lit(1))
    v = vocabulary.select("name", F.array_distinct(word(F.col("name"))).alias("t")).filter(F.size("t") > 0)
    q = queries.select("qid", F.explode(F.array_distinct(word(F.col("question")))).alias("w"))
    met = q.join(v.select("name", F.size("t").alias("n"), F.explode("t").alias("w")), "w").groupBy("qid", "name", "n").count()
    if most is None:
        return met.filter("count = n").select("qid", "name")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("name"))
    return met.filter("count = n").select("qid", "name").withColumn("r", rank).filter(F.col("r") <= most).select("qid", "name")


def hop_one(query_names: DataFrame, links: DataFrame, k: int | None = None) -> DataFrame:
    """``qid, fact_id, matched, rank``: facts by number of the query's names they bear."""
    got = query_names.select("qid", "name").distinct().join(links, "name").groupBy("qid", "fact_id").agg(F.count("*").alias("matched"))
    ranked = got.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("matched"), "fact_id")).cast("bigint"))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def hop_two(query_names: DataFrame, links: DataFrame, first: DataFrame, k: int | None = None, entities: int | None = HOP_ENTITIES) -> DataFrame:
    """Facts of the other names of the first hop's facts, without those facts; of the names the first ``entities``, None keeps all."""
    names = first.select("qid", "fact_id").join(links, "fact_id").select("qid", "name").distinct()
    names = names.join(query_names.select("qid", "name").distinct(), ["qid", "name"], "left_anti")
    if entities is not None:
        names = names.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("name"))).filter(F.col("r") <= entities).select("qid", "name")
    got = names.join(links, "name").groupBy("qid", "fact_id").agg(F.count("*").alias("matched")).join(first.select("qid", "fact_id"), ["qid", "fact_id"], "left_anti")
    ranked = got.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("matched"), "fact_id")).cast("bigint"))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def lineage_closure(edges: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """``child, parent, depth``: all ancestors within ``depth`` steps, each at its least depth; safe on cycles."""
    step = materialise(edges.select("child", "parent").distinct())
    seen = step.withColumn("depth", F.lit(1))
    front = step
    for d in range(2, depth + 1):
        # written, as the next step and the result both read it
        front = materialise(front.join(step.select(F.col("child").alias("parent"), F.col("parent").alias("next")), "parent").select("child", F.col("next").alias("parent")).distinct())
        seen = seen.unionByName(front.withColumn("depth", F.lit(d)))
    return seen.groupBy("child", "parent").agg(F.min("depth").cast("bigint").alias("depth"))


def recursive_closure(spark: SparkSession, edges_view: str, depth: int = MAX_DEPTH) -> DataFrame:
    """The same closure as one recursive query."""
    return spark.sql(f"""
        with recursive up(child, parent, depth) as (
          select child, parent, 1 from {edges_view} union all
          select u.child, e.parent, u.depth + 1 from up u join {edges_view} e on e.child = u.parent where u.depth < {depth})
        select child, parent, cast(min(depth) as bigint) depth from up group by child, parent""")
