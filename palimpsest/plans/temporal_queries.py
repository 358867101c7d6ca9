"""Registered queries of the bi-temporal problems: timestamps, history, as-of attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import asof, history
from palimpsest.operators import timestamps as ts
from palimpsest.sources.tables import iso_micros, iso_utc, once, spelling, table

USER_SIDE = ("user", "human")


def timed_values(spark: SparkSession, d: str) -> DataFrame:
    """Every time of the three fields with the zone and order of its session."""
    e = once(table(spark, d, "episodes").select("id", "session_id", "ts"), "id").select(
        F.lit("episodes.ts").alias("field"), "session_id", F.col("id").alias("ord"), F.col("id").cast("string").alias("row_id"), F.col("ts").alias("value"))
    f = once(table(spark, d, "facts").filter("event_date is not null").select("id", "session_id", "event_date"), "id").select(
        F.lit("facts.event_date").alias("field"), "session_id", F.col("id").alias("ord"), F.col("id").cast("string").alias("row_id"), F.col("event_date").alias("value"))
    q = once(table(spark, d, "questions").select("qid", "question_date", "evidence_sessions"), "qid").select(
        F.lit("questions.question_date").alias("field"), F.expr("try_element_at(evidence_sessions, 1)").alias("session_id"),
        F.expr("coalesce(try_cast(regexp_extract(qid, '([0-9]{1,18})$', 1) as bigint), 0)").alias("ord"), F.col("qid").alias("row_id"), F.col("question_date").alias("value"))
    rows = e.unionByName(f).unionByName(q)
    meta = once(table(spark, d, "session_meta").select("session_id", "tz", "date_order"), "session_id")
    return rows.join(meta, "session_id", "left").withColumnRenamed("session_id", "source")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    got = ts.normalise(timed_values(spark, d))
    exact = F.col("value").rlike(r"\A\d{4}-\d\d-\d\d(T\d\d:\d\d:\d\dZ)?\z")
    return got.filter(F.col("us").isNotNull() & ~F.col("against") & ~exact).select(
        "field", "row_id", ts.micros_text(F.col("us"), F.col("dated")).alias("normalised"))


FACT_TIMES = ("id", "subject", "predicate", "object", "scope", "ingested_at", "valid_from", "invalid_at", "superseded_by")


def p4_versions(spark: SparkSession, d: str) -> DataFrame:
    told = once(table(spark, d, "facts").select(*FACT_TIMES).filter(F.col("predicate").isin(*history.SINGLE_VALUED)), "id")
    return history.versions(history.intervals(history.change_log(told)))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    v = p4_versions(spark, d)
    return v.select("id", iso_utc(F.col("start_us")).alias("valid_from"), F.coalesce(iso_utc(F.col("end_us")), F.lit("open")).alias("invalid_at"))


def p4_timeline(spark: SparkSession, d: str) -> DataFrame:
    """All single-valued attributes of each subject and scope over elementary periods."""
    t = history.timeline(p4_versions(spark, d))
    return t.select("subject", "scope", iso_utc(F.col("start_us")).alias("valid_from"), F.coalesce(iso_utc(F.col("end_us")), F.lit("open")).alias("invalid_at"), *history.SINGLE_VALUED)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    meta = once(table(spark, d, "session_meta").filter("owner is not null").select("session_id", "owner", "tz", "date_order"), "session_id")
    turns = once(table(spark, d, "episodes").select("id", "session_id", "role", "ts").filter(F.lower(F.trim("role")).isin(*USER_SIDE)).drop("role"), "id")
    events = turns.join(meta, "session_id").select(
        F.col("id").alias("event_id"), spelling(F.col("owner")).alias("entity"), ts.instant(F.col("ts"), F.col("tz"), F.col("date_order")).alias("at_us"))
    told = once(table(spark, d, "facts").select(*FACT_TIMES).filter(F.col("predicate").isin("lives_in", "works_at") & (F.coalesce(F.trim("scope"), F.lit("")) == "")), "id")
    f = told.select(
        spelling(F.col("subject")).alias("entity"), F.col("predicate").alias("attribute"), "id", iso_micros(F.col("ingested_at")).alias("ingested_us"),
        F.coalesce(iso_micros(F.col("valid_from")), iso_micros(F.col("ingested_at"))).alias("start_us"),
        F.when(F.col("superseded_by").isNull(), iso_micros(F.col("invalid_at"))).alias("ended_us"))
    got = asof.as_known(events, f)
    return got.select(F.col("event_id").alias("episode_id"), F.col("attribute").alias("predicate"), "fact_id")


def queries() -> dict:
    return {"p4_found": p4_found, "p4_timeline": p4_timeline, "p5_found": p5_found, "p6_found": p6_found}


_SPELL = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
_US = """(case when regexp_matches(trim({0}), '(?i)[0-9]{{2}}:[0-9]{{2}}.*(z|[+-][0-9]{{2}}(:?[0-9]{{2}})?)$') then epoch_us(try_cast(trim({0}) as timestamptz))
 when {0} is not null then epoch_us(try_cast(trim({0}) as timestamp)) end)"""
_SINGLE = ", ".join(f"'{p}'" for p in history.SINGLE_VALUED)
_VERSIONS = f"""
 f as (select distinct id, coalesce({_SPELL.format("subject")}, '') subject, predicate, coalesce(trim(scope), '') scope, coalesce({_SPELL.format("object")}, '') object,
   {_US.format("ingested_at")} ing, coalesce({_US.format("valid_from")}, {_US.format("ingested_at")}) st, case when superseded_by is null then {_US.format("invalid_at")} end own
   from facts where predicate in ({_SINGLE})),
 one as (select * from (select *, row_number() over (partition by subject, predicate, scope, st order by coalesce(ing, -4611686018427387904) desc, id desc) rn from f where st is not null) where rn = 1),
 per as (select *, least(lead(st) over w, own) en from one window w as (partition by subject, predicate, scope order by st)),
 flag as (select *, coalesce(lag(en) over w = st and lag(object) over w = object, false) joined from per window w as (partition by subject, predicate, scope order by st)),
 isl as (select *, sum(case when joined then 0 else 1 end) over (partition by subject, predicate, scope order by st) g from flag),
 ver as (select subject, predicate, scope, min_by(id, st) id, min_by(object, st) object, min(st) st, max_by(struct_pack(e := en), st).e en from isl group by subject, predicate, scope, g)"""
_ISO = "strftime(make_timestamp({0}), '%Y-%m-%dT%H:%M:%SZ')"


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": f"with {_VERSIONS} select id, {_ISO.format('st')} valid_from, coalesce({_ISO.format('en')}, 'open') invalid_at from ver",
    }
