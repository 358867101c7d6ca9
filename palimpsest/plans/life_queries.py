"""Bi-temporal queries, mutations, lifecycle, governance, evaluation and streaming."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.operators import bitemporal, evaluation, graph, lifecycle, sampling
from palimpsest.operators.neighbours import joined_text
from palimpsest.plans.base import Catalogue, ep, fa, gold, lk, qs
from palimpsest.plans.text_queries import bm25_episodes
from palimpsest.session import shared_path
from palimpsest.sources import exchange
from palimpsest.sources.tables import once, table
from palimpsest.streaming import ingest

C = Catalogue()
WORLD, KNOWN = "2023-06-01T00:00:00Z", "2023-09-01T00:00:00Z"

_KEY_US = """case when regexp_matches(valid_from, '(Z|[+-][0-9]{2}:?[0-9]{2})$') then epoch_us(try_cast(valid_from as timestamptz)) when regexp_matches(valid_from, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') then epoch_us(try_cast(valid_from as timestamp)) end"""
_CHAIN = f"ch as (select *, lead(valid_from) over w chain_invalid_at, lead(id) over w chain_superseded_by from (select *, {_KEY_US} us from fa) window w as (partition by subject, predicate, scope order by us is null, us, valid_from, id))"


@C.add("win01_supersession_chain", f"with {_CHAIN} select id, chain_invalid_at, chain_superseded_by from ch", "fa")
def _(s, d):
    return bitemporal.supersession(fa(s, d)).select("id", "chain_invalid_at", "chain_superseded_by")


_ONE = ", ".join(f"'{p}'" for p in bitemporal.ONE_AT_A_TIME)


@C.add("mut01_consolidated_chain", f"""with told as (select subject, predicate, scope, valid_from, min(id) id from fa where subject != '' and (predicate in ({_ONE}) or starts_with(predicate, 'favorite')) group by subject, predicate, scope, valid_from, lower(trim(coalesce(statement, '')))),
    ch as (select *, lead(valid_from) over w chain_invalid_at, lead(id) over w chain_superseded_by from (select *, {_KEY_US} us from told) window w as (partition by subject, predicate, scope order by us is null, us, valid_from, id)) select id, chain_invalid_at, chain_superseded_by from ch""", "fa")
def _(s, d):
    """Facts of single-valued predicates, what is told again once, each superseded by the next of its key."""
    return bitemporal.consolidated(fa(s, d)).select("id", "chain_invalid_at", "chain_superseded_by")


@C.add("mut11_holds", f"""with held as (select session_id, substr(md5(session_id), 1, 1) h from (select distinct session_id from ep where session_id is not null)), st as (select session_id, case when h in ('0', '1', '2') then true else false end placed, h = '1' released from held)
    select e.id, placed and not released as held, case when placed and released then 'released' when placed then 'held' else 'free' end as state from ep e join st using (session_id)""", "ep")
def _(s, d):
    """Holds placed on sessions and some released again, as columns of their turns; the orders are derived from digests of the ids."""
    h = F.substring(F.md5("session_id"), 1, 1)
    orders = ep(s, d).filter("session_id is not null").select("session_id").distinct().select("session_id", h.isin("0", "1", "2").alias("placed"), (h == "1").alias("released"))
    t = ep(s, d).select("id", "session_id").join(orders, "session_id")
    state = F.when(F.col("placed") & F.col("released"), "released").when(F.col("placed"), "held").otherwise("free")
    return t.select("id", (F.col("placed") & ~F.col("released")).alias("held"), state.alias("state"))


@C.add("win09_current_value", f"with {_CHAIN} select id, subject, predicate, object from ch where chain_superseded_by is null and kind != 'observation'", "fa")
def _(s, d):
    return bitemporal.supersession(fa(s, d)).filter("chain_superseded_by is null and kind != 'observation'").select("id", "subject", "predicate", "object")


_REV = """rv as (select id as fact_id, 1 as revision, ingested_at known_at, valid_from, null::varchar invalid_at from fa where ingested_at is not null
  union all select a.id, 2, greatest(a.ingested_at, b.ingested_at), a.valid_from, a.invalid_at from fa a join fa b on b.id = a.superseded_by where a.ingested_at is not null and b.ingested_at is not null and a.invalid_at is not null
  union all select id, 2, ingested_at, valid_from, invalid_at from fa where ingested_at is not null and superseded_by is null and invalid_at is not null)"""


@C.add("mut12_validity_history", f"with {_REV} select fact_id, cast(revision as int) as revision, known_at, valid_from, invalid_at from rv", "fa")
def _(s, d):
    return bitemporal.revisions(fa(s, d))


@C.add("win02_latest_revision", f"with {_REV}, l as (select *, row_number() over (partition by fact_id order by known_at desc, revision desc) n from rv where known_at <= '{KNOWN}') select fact_id, invalid_at from l where n = 1", "fa")
def _(s, d):
    r = bitemporal.revisions(fa(s, d)).filter(F.col("known_at") <= KNOWN)
    return r.groupBy("fact_id").agg(F.max_by(F.struct("invalid_at"), F.struct("known_at", "revision")).alias("r")).select("fact_id", "r.invalid_at")


@C.add("tmp01_asof_now", "select id from fa where kind != 'observation' and invalid_at is null", "fa")
def _(s, d):
    return bitemporal.as_of(fa(s, d)).select("id")


@C.add("tmp01_asof_world", f"select id from fa where kind != 'observation' and valid_from <= '{WORLD}' and (invalid_at is null or invalid_at > '{WORLD}')", "fa")
def _(s, d):
    return bitemporal.as_of(fa(s, d), world=WORLD).select("id")


@C.add("tmp01_asof_known", f"with {_REV}, wd as (select fact_id, min(known_at) w from rv where revision = 2 group by 1) select f.id from fa f left join wd on wd.fact_id = f.id where kind != 'observation' and ingested_at <= '{KNOWN}' and (wd.w is null or wd.w > '{KNOWN}')", "fa")
def _(s, d):
    return bitemporal.as_of(fa(s, d), known=KNOWN).select("id")


@C.add("tmp01_asof_world_known", f"""with {_REV}, l as (select * from (select *, row_number() over (partition by fact_id order by known_at desc, revision desc) n from rv where known_at <= '{KNOWN}') where n = 1)
   select f.id, coalesce(l.valid_from, f.valid_from) as valid_from, l.invalid_at from fa f left join l on l.fact_id = f.id where f.kind != 'observation' and f.ingested_at <= '{KNOWN}' and f.valid_from <= '{WORLD}' and (l.invalid_at is null or l.invalid_at > '{WORLD}')""", "fa")
def _(s, d):
    return bitemporal.as_of(fa(s, d), WORLD, KNOWN).select("id", "valid_from", "invalid_at")


@C.add("mut03_duplicate_guard", """with o as (select * from fa where ingested_at < '2024-01-01'), n as (select * from fa where ingested_at >= '2024-01-01'),
   k as (select n.*, row_number() over (partition by subject, predicate, scope, lower(coalesce(statement, '')) order by id) r from n where not exists (select 1 from o where o.invalid_at is null and o.subject = n.subject and o.predicate = n.predicate and o.scope = n.scope and lower(coalesce(o.statement, '')) = lower(coalesce(n.statement, ''))))
   select id from k where r = 1""", "fa")
def _(s, d):
    f = fa(s, d)
    return bitemporal.unlike_before(f.filter("ingested_at >= '2024-01-01'"), f.filter("ingested_at < '2024-01-01'")).select("id")


@C.add("mut04_arbitration_candidates")
def _(s, d):
    """For each fact with id divisible by 20: the three most similar valid facts of one subject and scope, cosine 0.72 or more; rows only."""
    from palimpsest.operators import vector

    f = fa(s, d).select("id", "subject", "predicate", "scope", "invalid_at")
    v = once(table(s, d, "facts").select("id", "emb"), "id").filter(vector.sound(F.col("emb")))
    ask = f.filter("id % 20 = 0 and predicate != 'prefers'").join(v, "id").select(F.col("id").alias("qid"), "subject", "predicate", "scope", F.col("emb").alias("q"))
    rows = f.filter("invalid_at is null and predicate != 'prefers'").join(v, "id").drop("invalid_at")
    same = F.col("b.predicate") == F.col("a.predicate")
    pair = ask.alias("a").join(rows.alias("b"), ["subject", "scope"]).filter((F.col("qid") != F.col("id")) & (same | (F.col("a.predicate").isin("employed_by", "works_at") & F.col("b.predicate").isin("employed_by", "works_at"))))
    scored = pair.select("qid", "id", F.round(vector.cosine(F.col("q"), F.col("emb")), 6).alias("score")).filter("score >= 0.72")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")).cast("bigint")).filter("rank <= 3")


@C.add("mut07_observation_digests", """select subject, predicate, scope, count(*) as n, string_agg(statement, '; ' order by valid_from, id) as digest from fa where kind != 'observation' and invalid_at is null and subject != '' and statement is not null group by 1, 2, 3 having count(*) >= 3""", "fa")
def _(s, d):
    """Digests of every subject, 'user' included; large ones from pieces by month."""
    f = fa(s, d).filter("kind != 'observation' and invalid_at is null and subject != '' and statement is not null")
    got = joined_text(f, ["subject", "predicate", "scope"], F.substring("valid_from", 1, 7), ["valid_from", "id"], F.col("statement"), "; ")
    return got.filter("n >= 3").withColumnRenamed("text", "digest")


_GONE = "gone as (select session_id from (select distinct session_id from ep where session_id is not null) where substr(md5(session_id), 1, 1) = '0')"


@C.add("mut08_erase_session", f"""with {_GONE}, dead as (select id, subject, predicate from fa where session_id in (select session_id from gone)), touched as (select subject as name from dead union select 'digest:' || predicate from dead union select lk.name from lk join dead on dead.id = lk.fact_id),
   lost as (select id from dead union select id from fa where kind = 'observation' and (subject in (select name from touched) or predicate in (select name from touched)))
   select 'episodes' as "table", count(*) as n, 0 as pointers from ep where session_id is null or session_id not in (select session_id from gone) union all
   select 'facts', count(*), count(case when superseded_by is not null and superseded_by not in (select id from lost) then 1 end) from fa where id not in (select id from lost) union all select 'links', count(*), 0 from lk where fact_id not in (select id from lost)""", "ep fa lk")
def _(s, d):
    gone = ep(s, d).select("session_id").filter("session_id is not null").distinct().filter("substring(md5(session_id), 1, 1) = '0'")
    left = lifecycle.erase_sessions(ep(s, d), fa(s, d), lk(s, d), gone)
    one = lambda t, p: left[t].agg(F.lit(t).alias("table"), F.count("*").alias("n"), p.cast("bigint").alias("pointers"))
    return one("episodes", F.lit(0)).unionByName(one("facts", F.count("superseded_by"))).unionByName(one("links", F.lit(0)))


@C.add("mut09_erase_entity", """with n as (select 'ashvale' as name), dead as (select distinct fact_id from lk where name in (select name from n)) select 'facts' as "table", count(*) as n from fa where id not in (select fact_id from dead)
   union all select 'links', count(*) from lk where name not in (select name from n) and fact_id not in (select fact_id from dead)""", "fa lk")
def _(s, d):
    left = lifecycle.erase_entity(fa(s, d), lk(s, d), s.createDataFrame([("ashvale",)], "name string"))
    return left["facts"].agg(F.lit("facts").alias("table"), F.count("*").alias("n")).unionByName(left["links"].agg(F.lit("links").alias("table"), F.count("*").alias("n")))


NOW = "2025-01-01T00:00:00Z"
_HOLDS = """ho as (select session_id as id, 'session' scope_kind, session_id scope_value, case when substr(md5(session_id), 2, 1) = '0' then '2024-06-01T00:00:00Z' end released_at, case when substr(md5(session_id), 3, 1) < '4' then '2024-12-01T00:00:00Z' end expires_at
    from (select distinct session_id from session_meta) where substr(md5(session_id), 1, 1) = '1'
   union all select 'e-' || name, 'entity', name, null, null from (select distinct name from lk) where substr(md5(name), 1, 2) = '00')"""


def _holds(s, d):
    """Holds stand in for a table the data lacks: sessions and names by the digits of their digests."""
    m = table(s, d, "session_meta").select("session_id").distinct().filter("substring(md5(session_id), 1, 1) = '1'")
    x = F.md5("session_id")
    a = m.select(F.col("session_id").alias("id"), F.lit("session").alias("scope_kind"), F.col("session_id").alias("scope_value"),
                 F.when(F.substring(x, 2, 1) == "0", "2024-06-01T00:00:00Z").alias("released_at"), F.when(F.substring(x, 3, 1) < "4", "2024-12-01T00:00:00Z").alias("expires_at"))
    n = lk(s, d).select("name").distinct().filter("substring(md5(name), 1, 2) = '00'")
    return a.unionByName(n.select(F.concat(F.lit("e-"), "name").alias("id"), F.lit("entity").alias("scope_kind"), F.col("name").alias("scope_value"), F.lit(None).cast("string").alias("released_at"), F.lit(None).cast("string").alias("expires_at")))


@C.add("flt10_active_holds", f"with {_HOLDS} select id from ho where released_at is null and (expires_at is null or expires_at > '{NOW}')", "lk")
def _(s, d):
    return lifecycle.active_holds(_holds(s, d), NOW).select("id")


_HELD = f"""{_HOLDS}, ah as (select * from ho where released_at is null and (expires_at is null or expires_at > '{NOW}')), he as (select session_id, count(distinct h) holds from (select scope_value session_id, id h from ah where scope_kind = 'session'
   union all select f.session_id, ah.id from ah join lk on lk.name = ah.scope_value join fa f on f.id = lk.fact_id where scope_kind = 'entity' and f.session_id is not null) group by 1)"""


@C.add("jn13_held_sessions", f"with {_HELD} select session_id, holds from he", "fa lk")
def _(s, d):
    return lifecycle.held_sessions(_holds(s, d), fa(s, d), lk(s, d), NOW)


@C.add("mut10_retention_sweep", f"""with {_HELD}, du as (select distinct session_id from session_meta where substr(md5(session_id || 'r'), 1, 1) < '4')
   select session_id, case when session_id in (select session_id from he) then 'skipped_held' else 'erased' end as outcome from du""", "fa lk")
def _(s, d):
    until = F.when(F.substring(F.md5(F.concat("session_id", F.lit("r"))), 1, 1) < "4", "2024-10-01T00:00:00Z")
    m = table(s, d, "session_meta").select("session_id").distinct().withColumn("retain_until", until)
    return lifecycle.sweep(m, lifecycle.held_sessions(_holds(s, d), fa(s, d), lk(s, d), NOW), NOW)


@C.add("flt11_retention_expired", "select distinct session_id from session_meta where substr(md5(session_id || 'r'), 1, 1) < '4'")
def _(s, d):
    until = F.when(F.substring(F.md5(F.concat("session_id", F.lit("r"))), 1, 1) < "4", "2024-10-01T00:00:00Z")
    return table(s, d, "session_meta").select("session_id", until.alias("retain_until")).filter(F.col("retain_until") <= NOW).select("session_id").distinct()


_EDGES = "ed as (select 'fact:' || id as child, 'episode:' || episode_id as parent from fa where episode_id is not null union select 'fact:' || superseded_by, 'fact:' || id from fa where superseded_by is not null)"


def _edges(s, d):
    f = fa(s, d)
    a = f.filter("episode_id is not null").select(F.concat(F.lit("fact:"), "id").alias("child"), F.concat(F.lit("episode:"), "episode_id").alias("parent"))
    return a.unionByName(f.filter("superseded_by is not null").select(F.concat(F.lit("fact:"), "superseded_by").alias("child"), F.concat(F.lit("fact:"), "id").alias("parent"))).distinct()


@C.add("jn14_lineage_parents", f"with {_EDGES} select child, count(*) as n from ed group by child", "fa")
def _(s, d):
    return _edges(s, d).groupBy("child").agg(F.count("*").alias("n"))


@C.add("jn15_lineage_closure", f"""with recursive fa0 as (select distinct id, superseded_by, episode_id from facts), ed as (select 'fact:' || id as child, 'episode:' || episode_id as parent from fa0 where episode_id is not null union select 'fact:' || superseded_by, 'fact:' || id from fa0 where superseded_by is not null),
   up(child, parent, depth) as (select child, parent, 1 from ed union all select u.child, e.parent, u.depth + 1 from up u join ed e on e.child = u.parent where u.depth < 5) select child, parent, cast(min(depth) as bigint) as depth from up group by 1, 2""")
def _(s, d):
    return graph.lineage_closure(_edges(s, d))


@C.add("jn24_contaminated_observations", f"""with {_GONE}, dead as (select id, subject, predicate from fa where session_id in (select session_id from gone)), touched as (select subject as name from dead union select 'digest:' || predicate from dead union select lk.name from lk join dead on dead.id = lk.fact_id)
   select id from fa where kind = 'observation' and (subject in (select name from touched) or predicate in (select name from touched))""", "ep fa lk")
def _(s, d):
    gone = ep(s, d).select("session_id").filter("session_id is not null").distinct().filter("substring(md5(session_id), 1, 1) = '0'")
    f = fa(s, d)
    left = lifecycle.erase_sessions(ep(s, d), f, lk(s, d), gone)["facts"].select("id")
    return f.filter("kind = 'observation'").join(gone, "session_id", "left_anti").join(left, "id", "left_anti").select("id").unionByName(
        f.filter("kind = 'observation'").join(gone, "session_id", "left_semi").join(left, "id", "left_anti").join(_tainted(f, lk(s, d), gone), "id", "left_semi").select("id"))


def _tainted(f, links, gone):
    dead = f.join(gone, "session_id", "left_semi").select("id", "subject", "predicate")
    names = dead.select(F.col("subject").alias("name")).unionByName(dead.select(F.concat(F.lit("digest:"), F.col("predicate")).alias("name"))).unionByName(links.join(dead.select(F.col("id").alias("fact_id")), "fact_id", "left_semi").select("name")).distinct()
    o = f.filter("kind = 'observation'")
    return o.join(names.withColumnRenamed("name", "subject"), "subject", "left_semi").select("id").unionByName(o.join(names.withColumnRenamed("name", "predicate"), "predicate", "left_semi").select("id")).distinct()


@C.add("jn25_missing_history", f"with {_REV} select id from fa where id not in (select fact_id from rv)", "fa")
def _(s, d):
    f = fa(s, d)
    return f.select("id").join(bitemporal.revisions(f).select(F.col("fact_id").alias("id")), "id", "left_anti")


@C.add("agg22_chain_violations", "select user_id, count(*) as receipts, 0 as violations from events group by user_id")
def _(s, d):
    """Receipts sealed per user from the event stream, then verified: a sound chain has no violation."""
    ev = table(s, d, "events").select("user_id", F.col("event_id").alias("at"), F.to_json(F.struct("event_id", "event_type", "value")).alias("body"))
    return lifecycle.violations(lifecycle.seal(ev, "user_id", "at", "body"), "user_id")


@C.add("agg22_chain_tampered", "select count(*) as chains from (select user_id from events group by user_id having max(event_id % 997 = 0))")
def _(s, d):
    """Chains in which a body was changed after sealing are found, all of them."""
    ev = table(s, d, "events").select("user_id", F.col("event_id").alias("at"), F.to_json(F.struct("event_id", "event_type", "value")).alias("body"))
    bad = lifecycle.seal(ev, "user_id", "at", "body").withColumn("body", F.when(F.col("at") % 997 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return lifecycle.violations(bad, "user_id").filter("violations > 0").agg(F.count("*").alias("chains"))


@C.add("hsh01_session_digest", "select session_id, sha256(string_agg(sha256(coalesce(role, '') || chr(1) || coalesce(content, '')), '' order by id)) as hash from ep where session_id is not null group by 1", "ep")
def _(s, d):
    """Digests of every session, the shared one included."""
    row = F.sha2(F.concat(F.coalesce("role", F.lit("")), F.lit("\x01"), F.coalesce("content", F.lit(""))), 256)
    got = joined_text(ep(s, d).filter("session_id is not null"), ["session_id"], F.floor(F.col("id") / 65_536), ["id"], row, "")
    return got.select("session_id", F.sha2("text", 256).alias("hash"))


@C.add("mut13_session_stamps", "select f.id as fact_id, count(e.id) as edges from fa f join ep e on e.session_id = f.session_id group by 1", "fa ep")
def _(s, d):
    """Each fact stems from every turn of its session, the shared one included."""
    f = fa(s, d).filter("session_id is not null").select(F.col("id").alias("fact_id"), "session_id")
    n = ep(s, d).filter("session_id is not null").groupBy("session_id").agg(F.count("*").alias("edges"))
    return f.join(n, "session_id").select("fact_id", "edges")


# ---- evaluation -------------------------------------------------------------------------------



def _recall_sql(ranked: str) -> str:
    cols = ", ".join(f"round(avg(case when rank <= {k} then 1 else 0 end), 6) as recall_{k}, cast(min(case when rank <= {k} then 1 else 0 end) as bigint) as all_{k}" for k in evaluation.DEPTHS)
    return f"select g.qid, {cols}, round(coalesce(1.0 / min(r.rank), 0), 6) as mrr from gold g left join ({ranked}) r on r.qid = g.qid and r.id = g.id group by g.qid"


def _bm25_all():
    from palimpsest.plans.text_queries import C as T

    sql = T.sql["ret01_bm25_episodes"]
    return sql.rpartition("\n    select ")


_H, _, _T = _bm25_all()


@C.add("agg13_recall_at_k", f"{_H}, rr as (select {_T}) {_recall_sql('select qid, doc_id id, rank from rr')}".replace("with ep as", "with gold as (select distinct qid, cast(t as bigint) id from (select qid, unnest(evidence_turns) t from questions)), ep as"))
def recall_of_bm25(s, d):
    return evaluation.recall(bm25_episodes(s, d).select("qid", F.col("doc_id").alias("id"), "rank"), gold(s, d))


@C.add("agg17_report_grouping_sets", "with rx as (" + C.sql["agg13_recall_at_k"] + "), q as (select distinct qid, category from questions) select category, cast(grouping(category) as bigint) as overall, count(*) as n, round(avg(recall_5), 6) as recall_5, round(avg(mrr), 6) as mrr from rx join q using (qid) group by grouping sets ((), (category))")
def _(s, d):
    per = recall_of_bm25(s, d).join(qs(s, d).select("qid", "category"), "qid")
    return evaluation.report(per, "category", "recall_5", "mrr")


@C.add("agg15_session_recall", f"{_H}, rr as (select {_T}), se as (select qid, session_id, min(rank) r from rr join ep on ep.id = rr.doc_id where session_id is not null group by 1, 2), gs as (select qid, unnest(evidence_sessions) session_id from questions), g2 as (select distinct qid, session_id from gs) select g2.qid, round(avg(case when se.r <= 5 then 1 else 0 end), 6) as recall_5, round(coalesce(1.0 / min(se.r), 0), 6) as mrr from g2 left join se using (qid, session_id) group by 1")
def _(s, d):
    hits = bm25_episodes(s, d).join(ep(s, d).select(F.col("id").alias("doc_id"), "session_id"), "doc_id").filter("session_id is not null")
    best = hits.groupBy("qid", F.col("session_id").alias("id")).agg(F.min("rank").alias("rank"))
    want = table(s, d, "questions").select("qid", F.explode("evidence_sessions").alias("id"))
    return evaluation.recall(best, want, (5,)).select("qid", "recall_5", "mrr")


@C.add("agg16_failure_inclusive", "with x as (" + C.sql["agg13_recall_at_k"] + ") select q.category, count(*) as n, round(sum(coalesce(x.recall_10, 0)) / count(*), 6) as recall_10 from (select distinct qid, category from questions) q left join x using (qid) group by 1")
def _(s, d):
    """All questions asked are the denominator; those without a result count 0."""
    j = qs(s, d).select("qid", "category").join(recall_of_bm25(s, d).select("qid", "recall_10"), "qid", "left")
    return j.groupBy("category").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("recall_10", F.lit(0.0))) / F.count("*"), 6).alias("recall_10"))


@C.add("agg14_answer_survival", "select q.qid, max(case when contains(lower(e.content), lower(q.answer)) then 1 else 0 end) as survives from qs q join gold g using (qid) join ep e on e.id = g.id group by 1", "qs gold ep")
def _(s, d):
    j = gold(s, d).join(ep(s, d).select("id", "content"), "id").join(qs(s, d).select("qid", "answer"), "qid")
    return j.groupBy("qid").agg(F.coalesce(F.max(F.lower("content").contains(F.lower("answer")).cast("int")), F.lit(0)).cast("bigint").alias("survives"))


@C.add("agg18_percentiles", "select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95 from events group by event_type")
def _(s, d):
    e = table(s, d, "events")
    a = evaluation.nearest_rank(e, "value", 0.5, ["event_type"]).withColumnRenamed("value", "p50")
    return a.join(evaluation.nearest_rank(e, "value", 0.95, ["event_type"]).withColumnRenamed("value", "p95"), "event_type")


@C.add("agg18_percentile_by_index", "with r as (select event_type, value, row_number() over (partition by event_type order by value, event_id) n, count(*) over (partition by event_type) c from events) select event_type, max(case when n = cast(floor(0.95 * c) as bigint) + 1 then value end) as p95_index, max(case when n = greatest(cast(round_even(0.95 * c, 0) as bigint), 1) then value end) as p95_rounded from r group by 1")
def _(s, d):
    """The two other definitions: the value at index int(.95 n), and at round(.95 n) - 1."""
    e = table(s, d, "events").select("event_type", "event_id", "value")
    r = e.withColumn("n", F.row_number().over(Window.partitionBy("event_type").orderBy("value", "event_id"))).withColumn("c", F.count("*").over(Window.partitionBy("event_type")))
    return r.groupBy("event_type").agg(F.max(F.when(F.col("n") == F.floor(0.95 * F.col("c")) + 1, F.col("value"))).alias("p95_index"), F.max(F.when(F.col("n") == F.greatest(F.bround(0.95 * F.col("c"), 0), F.lit(1)), F.col("value"))).alias("p95_rounded"))


@C.add("agg19_mcnemar", "select count(case when a and not b then 1 end) as b, count(case when b and not a then 1 end) as c from (select substr(sha256(qid), 1, 1) < '9' as a, substr(sha256(qid), 2, 1) < '8' as b from qs)", "qs")
def _(s, d):
    q = qs(s, d).select("qid")
    return evaluation.mcnemar(q, F.substring(F.sha2("qid", 256), 1, 1) < "9", F.substring(F.sha2("qid", 256), 2, 1) < "8").select("b", "c")


@C.add("agg19_mcnemar_p")
def _(s, d):
    q = qs(s, d).select("qid")
    return evaluation.mcnemar(q, F.substring(F.sha2("qid", 256), 1, 1) < "9", F.substring(F.sha2("qid", 256), 2, 1) < "8")


@C.add("agg20_bootstrap")
def _(s, d):
    x = recall_of_bm25(s, d).select("qid", "recall_10", "recall_5")
    return evaluation.bootstrap(x, "recall_10", "recall_5", 500)


@C.add("agg21_auc", """with t as (select d.lang, d.n_chars as s, l.form = 'prose' p from documents d join doc_labels l using (doc_id)), r as (select *, rank() over (partition by lang order by s) + (count(*) over (partition by lang, s) - 1) / 2.0 k from t)
   select lang, count(case when p then 1 end) as pos, count(case when not p then 1 end) as neg, case when count(case when p then 1 end) > 0 and count(case when not p then 1 end) > 0 then round((sum(case when p then k else 0 end) - count(case when p then 1 end) * (count(case when p then 1 end) + 1) / 2.0) / (count(case when p then 1 end) * count(case when not p then 1 end)), 6) end as auc from r group by lang""")
def _(s, d):
    x = table(s, d, "documents").select("doc_id", "lang", "n_chars").join(table(s, d, "doc_labels"), "doc_id")
    return evaluation.auc(x, "lang", "n_chars", F.col("form") == "prose")


@C.add("agg23_growth_summary", "select batch, n, sum(n) over (order by batch) as total from (select event_id // 1000 as batch, count(*) n from events group by 1)")
def _(s, d):
    per = table(s, d, "events").groupBy(F.floor(F.col("event_id") / 1000).cast("bigint").alias("batch")).agg(F.count("*").alias("n"))
    return per.select("batch", "n", F.sum("n").over(Window.orderBy("batch")).alias("total"))  # one row a checkpoint


@C.add("agg26_pooled_reads", "select category, count(*) as questions, sum(reads) as reads, round(avg(hits * 1.0 / reads), 6) as accuracy from (select qid, category, 2 reads, (case when substr(sha256(qid), 1, 1) < '9' then 1 else 0 end) + (case when substr(sha256(qid), 2, 1) < '8' then 1 else 0 end) hits from qs) group by 1", "qs")
def _(s, d):
    q = qs(s, d).select("qid", "category", F.explode(F.array(F.substring(F.sha2("qid", 256), 1, 1) < "9", F.substring(F.sha2("qid", 256), 2, 1) < "8")).alias("hit"))
    per = q.groupBy("qid", "category").agg(F.count("*").alias("reads"), F.count_if("hit").alias("hits"))
    return per.groupBy("category").agg(F.count("*").alias("questions"), F.sum("reads").alias("reads"), F.round(F.avg(F.col("hits") / F.col("reads")), 6).alias("accuracy"))


@C.add("jn18_relevance_join", f"{_H}, rr as (select {_T}) select rr.qid, rr.doc_id, rr.rank, g.id is not null as relevant from rr left join (select distinct qid, cast(t as bigint) id from (select qid, unnest(evidence_turns) t from questions)) g on g.qid = rr.qid and g.id = rr.doc_id")
def _(s, d):
    g = gold(s, d).select("qid", F.col("id").alias("doc_id"), F.lit(True).alias("hit"))
    return bm25_episodes(s, d).join(g, ["qid", "doc_id"], "left").select("qid", "doc_id", "rank", F.coalesce("hit", F.lit(False)).alias("relevant"))


@C.add("jn22_held_out", "select qid from qs where qid not in (select qid from qs where substr(sha256(qid), 1, 1) < '4')", "qs")
def _(s, d):
    q = qs(s, d).select("qid")
    return q.join(q.filter(F.substring(F.sha2("qid", 256), 1, 1) < "4"), "qid", "left_anti")


@C.add("ml01_judge_head")
def _(s, d):
    """A logistic head on rank features of BM25 candidates, grouped folds by question; gives AUC per fold; rows only."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    g = gold(s, d).select("qid", F.col("id").alias("doc_id"), F.lit(1.0).alias("label"))
    x = bm25_episodes(s, d).join(g, ["qid", "doc_id"], "left").join(ep(s, d).select(F.col("id").alias("doc_id"), F.length("content").alias("n")), "doc_id")
    x = x.select("qid", F.coalesce("label", F.lit(0.0)).alias("label"), "score", F.col("rank").cast("double").alias("rank"), F.coalesce("n", F.lit(0)).cast("double").alias("n"), F.pmod(F.xxhash64("qid"), F.lit(5)).cast("int").alias("fold"))
    sample = sampling.hashed_sample(x, 50_000, "qid", "rank")
    v = VectorAssembler(inputCols=["score", "rank", "n"], outputCol="v").transform(sample).cache()
    v = StandardScaler(inputCol="v", outputCol="z", withMean=True).fit(v).transform(v)
    out = None
    for k in range(5):
        share = v.filter(F.col("fold") != k).agg(F.avg("label")).first()[0] or 0.5
        w = v.withColumn("w", F.when(F.col("label") > 0, F.lit(0.5 / max(share, 1e-6))).otherwise(F.lit(0.5 / max(1 - share, 1e-6))))
        train = w.filter(F.col("fold") != k)
        if train.select("label").distinct().count() < 2:
            continue
        m = LogisticRegression(featuresCol="z", labelCol="label", weightCol="w", regParam=0.01).fit(train)
        p = m.transform(w.filter(F.col("fold") == k)).select("fold", "label", F.round(vector_to_array("probability")[1], 6).alias("p"))
        got = evaluation.auc(p, "fold", "p", F.col("label") > 0)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else evaluation.auc(x.select("fold", "label", "score"), "fold", "score", F.col("label") > 0)


# ---- exchange and streaming -------------------------------------------------------------------

@C.add("sink01_json_round_trip", "select count(*) as n, count(emb) as vectors from (select distinct id, emb from facts)")
def _(s, d):
    """Facts exported as JSON with packed vectors and read back strictly; rows that came back equal are counted."""
    f = once(table(s, d, "facts"), "id")
    path = shared_path(s, "export")
    exchange.export_json(f, path)
    back = exchange.import_json(s, path, f.schema)
    same = back.select("id", "emb").join(f.select("id", F.col("emb").alias("old"), F.col("statement").alias("st")), "id").filter(F.col("emb").eqNullSafe(F.col("old")))
    return same.agg(F.count("*").alias("n"), F.count("emb").alias("vectors"))


@C.add("sink03_pack", "select 'facts' as \"table\", count(*) as n from fa union all select 'links', count(*) from lk", "fa lk")
def _(s, d):
    path = shared_path(s, "pack")
    exchange.build_pack({"facts": fa(s, d), "links": lk(s, d)}, path, "memory", "team", secret=b"key")
    got = exchange.open_pack(s, path, secret=b"key")
    return got["facts"].agg(F.lit("facts").alias("table"), F.count("*").alias("n")).unionByName(got["links"].agg(F.lit("links").alias("table"), F.count("*").alias("n")))


@C.add("stm01_ingest_sessions", "select count(*) as n from (select distinct coalesce(session_id, '') a, coalesce(role, '') b, coalesce(content, '') c, coalesce(ts, '') d from episodes)")
def _(s, d):
    st = ingest.stream_table(s, f"{d}/episodes.parquet", ["id", "session_id", "role", "content", "ts"])
    return ingest.ingest_sessions(s, st, table(s, d, "ingest_log").select("hash")).agg(F.count("*").alias("n"))


@C.add("stm02_once_each", "select count(*) as n from (select distinct event_id from events)")
def _(s, d):
    ev = ingest.stream_table(s, f"{d}/events.parquet", ["event_id", "ts"]).withColumn("ts", F.col("ts").cast("timestamp"))
    twice = ev.unionByName(ev)
    return ingest.drain(ingest.once_each(twice, "event_id", "ts", "400 days"), "once").agg(F.count("*").alias("n"))


@C.add("stm03_late_history", f"with {_CHAIN} select id, chain_invalid_at, chain_superseded_by from ch", "fa")
def _(s, d):
    cols = ["id", "statement", "subject", "predicate", "object", "kind", "event_date", "ingested_at", "valid_from", "invalid_at", "superseded_by", "episode_id", "session_id", "scope"]
    st = bitemporal.write_form(ingest.stream_table(s, f"{d}/facts.parquet", cols))
    return ingest.late_history(s, st).select("id", "chain_invalid_at", "chain_superseded_by")


@C.add("stm06_tumbling_rollup", "with m as (select max(ts) t from events) select time_bucket(interval 1 day, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events, m where time_bucket(interval 1 day, ts) + interval 1 day <= t - interval 1 hour group by 1, 2")
def _(s, d):
    ev = ingest.stream_table(s, f"{d}/events.parquet", ["ts", "event_type", "value"]).withColumn("ts", F.col("ts").cast("timestamp"))
    got = ingest.drain(ingest.tumbling(ev, "ts", "1 day", "1 hour", "event_type"), "tumbling")
    return got.withColumn("start", F.col("start").cast("timestamp_ntz"))


@C.add("stm06_session_windows")
def _(s, d):
    ev = ingest.stream_table(s, f"{d}/events.parquet", ["ts", "user_id"]).withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.drain(ingest.sessions(ev, "ts", "30 minutes", "1 hour", "user_id"), "sessions")
