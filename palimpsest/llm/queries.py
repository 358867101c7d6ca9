"""Registered queries of the training-data problems tagged llm."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import conversations, encode, names, packing, pii, quality, similar
from palimpsest.sources.tables import once, table

NEIGHBOURS, LEAST_COSINE = 8, 0.90


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    subjects = once(table(spark, d, "facts").select("id", "subject"), "id")
    objects = once(table(spark, d, "facts").filter("predicate in ('works_at', 'studies_at')").select("id", "object"), "id")
    return names.pairs(names.same_entity(table(spark, d, "entities"), table(spark, d, "entity_aliases"), subjects, objects.select(F.col("object").alias("organisation"))))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    turns = conversations.rebuild(spark, f"{d}/episodes.parquet", table(spark, d, "session_meta"))
    return turns.select("session_id", "turn_no", "id")


def _similar(spark: SparkSession, d: str, name: str, kind: str) -> DataFrame:
    near = similar.nearest(table(spark, d, name).select("id", "emb"), "id", "emb", NEIGHBOURS, LEAST_COSINE)
    return near.select(F.lit(kind).alias("kind"), F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d, "episodes", "episode").unionByName(_similar(spark, d, "facts", "fact"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    e = once(table(spark, d, "episodes").select("id", "content"), "id").select(F.lit("episodes.content").alias("field"), F.col("id").alias("row_id"), F.col("content").alias("text"))
    f = once(table(spark, d, "facts").select("id", "statement"), "id").select(F.lit("facts.statement").alias("field"), F.col("id").alias("row_id"), F.col("statement").alias("text"))
    return e.unionByName(f)


def _learnt(spark: SparkSession, d: str) -> tuple:
    f = once(table(spark, d, "facts").select("id", "subject", "predicate", "object"), "id")
    names = f.select(F.col("subject").alias("name")).unionByName(table(spark, d, "entities").select("name"))
    towns = f.filter("predicate = 'lives_in'").select(F.col("object").alias("town"))
    organisations = f.filter("predicate in ('works_at', 'studies_at')").select(F.col("object").alias("organisation"))
    return pii.learn(_texts(spark, d).select("text"), names, towns, organisations)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(_texts(spark, d), *_learnt(spark, d))


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(_texts(spark, d), *_learnt(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(
        "doc_id", "source", "text",
        # copies are texts equal but for case and white space
        F.xxhash64(F.coalesce(F.regexp_replace(F.lower("text"), r"\s+", " "), F.lit(""))).alias("cluster"))
    budgets, parts = table(spark, d, "context_budgets"), []
    names = sorted({r["tokenizer"] or "" for r in budgets.select("tokenizer").distinct().limit(packing.MAX_BUDGETS).collect()})
    for name in names:  # sizes are in tokens of the tokenizer that a budget names
        if name not in encode.VOCABULARIES:
            raise ValueError(f"no vocabulary of the tokenizer {name!r}")
        sizes = encode.token_counts(docs, ["doc_id", "source", "cluster"], path=encode.VOCABULARIES[name])
        items = sizes.select(F.col("doc_id").alias("item"), "source", "cluster", F.col("tokens").alias("size"))
        parts.append(packing.pack(items, budgets.filter(F.col("tokenizer") == name)))
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("item", "doc_id")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return quality.scored(table(spark, d, "documents"), table(spark, d, "common_words"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    stats = quality.described(table(spark, d, "documents"), table(spark, d, "common_words"))
    said = quality.forms(stats, table(spark, d, "doc_labels"))
    return said.filter("form != 'prose'").select("doc_id", "form")


def p10_stats(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", "lang_group", *quality.RANKED, F.round("score", 6).alias("outlier_score"))


def queries() -> dict:
    return {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p7_found": p7_found, "p7_redacted": p7_redacted, "p8_ids": p8_ids, "p9_containers": p9_containers, "p10_found": p10_found, "p10_stats": p10_stats}


def oracle_sql() -> dict[str, str]:
    return {}
