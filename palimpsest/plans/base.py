"""Views of the store's tables for the registered queries, and the same views in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.bitemporal import write_form
from palimpsest.session import materialise
from palimpsest.sources.tables import once, table

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    """Queries of one module by name, with their SQL where there is any."""

    def __init__(self) -> None:
        self.run: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
        """Register a query; ``views`` names the SQL views (see VIEWS) its SQL uses."""

        def put(f: Query) -> Query:
            self.run[name] = f
            if sql is not None:
                head = ", ".join(VIEWS[v] for v in views.split())
                self.sql[name] = f"with {head}{',' if head and sql.lstrip().lower().startswith('with ') else ''} {sql.lstrip()[5:] if head and sql.lstrip().lower().startswith('with ') else sql}" if head else sql
            return f

        return put


VIEWS = {
    "ep": "ep as (select distinct id, session_id, role, content, ts from episodes)",
    "fa": """fa as (select distinct id, statement, lower(trim(coalesce(subject, ''))) subject, lower(trim(coalesce(predicate, ''))) predicate, object, kind, event_date, ingested_at,
      coalesce(valid_from, event_date, ingested_at) valid_from, invalid_at, superseded_by, episode_id, session_id, coalesce(trim(scope), '') scope from facts)""",
    "lk": "lk as (select distinct lower(trim(name)) as name, fact_id from entities where name is not null)",
    "al": "al as (select lower(trim(alias)) as alias, lower(trim(canonical)) canonical from entity_aliases)",
    "qs": "qs as (select distinct qid, question, answer, category, question_date, abstention from questions)",
    "gold": "gold as (select distinct qid, cast(t as bigint) id from (select qid, unnest(evidence_turns) t from questions))",
}


def ep(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "episodes").select("id", "session_id", "role", "content", "ts"), "id")


def fa(spark: SparkSession, d: str) -> DataFrame:
    return write_form(once(table(spark, d, "facts").drop("entities", "search_keys", "emb"), "id"))


def lk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").filter("name is not null").select(F.lower(F.trim("name")).alias("name"), "fact_id").distinct()


def al(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entity_aliases").select(F.lower(F.trim("alias")).alias("alias"), F.lower(F.trim("canonical")).alias("canonical"))


def qs(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "questions").drop("evidence_turns", "evidence_sessions"), "qid")


def alike(queries: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """Questions equal in ``by`` are answered once: (the one of least ``qid`` of each kind, ``qid, lead`` of all)."""
    q = materialise(queries)
    lead = q.groupBy(*by).agg(F.min("qid").alias("lead"))
    names = q.join(lead.select("lead", *[F.col(c).alias(f"_{c}") for c in by]), reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])).select("qid", "lead")
    return q.join(lead.select(F.col("lead").alias("qid")), "qid", "left_semi"), names


def to_all(answers: DataFrame, names: DataFrame) -> DataFrame:
    """The answers of the leading questions for every question."""
    return answers.withColumnRenamed("qid", "lead").join(names, "lead").select("qid", *[c for c in answers.columns if c != "qid"])


def gold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions").select("qid", F.explode("evidence_turns").alias("t")).select("qid", F.col("t").cast("bigint").alias("id")).distinct()
