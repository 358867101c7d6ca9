"""Scans, filters, joins, aggregates, windows and set operations of the store."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import fusion, graph
from palimpsest.plans.base import Catalogue, al, ep, fa, lk, qs
from palimpsest.sources.tables import table

C = Catalogue()
FROM, TO, NEAR = "2024-01-01", "2024-02-01", "2024-03-15T12:00:00Z"


@C.add("src02_episode_append", "select id, session_id, lower(coalesce(role, 'user')) as role, coalesce(content, '') as content, ts from ep", "ep")
def _(s, d):
    return ep(s, d).select("id", "session_id", F.lower(F.coalesce("role", F.lit("user"))).alias("role"), F.coalesce("content", F.lit("")).alias("content"), "ts")


@C.add("src03_fact_append", "select id, subject, predicate, object, scope, valid_from from fa", "fa")
def _(s, d):
    return fa(s, d).select("id", "subject", "predicate", "object", "scope", "valid_from")


@C.add("src05_batch_lookup", "select e.id, e.session_id, e.ts from ep e join (select distinct episode_id from fa where episode_id is not null) f on e.id = f.episode_id", "ep fa")
def _(s, d):
    ids = fa(s, d).select(F.col("episode_id").alias("id")).filter("id is not null").distinct()
    return ep(s, d).join(ids, "id").select("id", "session_id", "ts")


@C.add("src06_time_range", f"select id, ts from ep where ts >= '{FROM}' and ts <= '{TO}'", "ep")
def _(s, d):
    return ep(s, d).filter(F.col("ts").between(FROM, TO)).select("id", "ts")


_DAY_SQL = "try_cast(regexp_extract(ts, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') as date)"


@C.add("src07_nearest", f"""with d as (select id, ts, {_DAY_SQL} dy from ep), s as (
    select id, ts, dy, ts > '{NEAR}' up, row_number() over (partition by ts > '{NEAR}' order by case when ts > '{NEAR}' then ts end asc, case when not ts > '{NEAR}' then ts end desc, id) n from d where dy is not null and ts is not null)
    select id, cast(rank as bigint) as rank, score from (select id, round(1.0 / (1 + abs(date_diff('day', dy, date '{NEAR[:10]}'))), 6) score,
      row_number() over (order by round(1.0 / (1 + abs(date_diff('day', dy, date '{NEAR[:10]}'))), 6) desc, up, n) as rank from s where n <= 12) where rank <= 20""", "ep")
def _(s, d):
    day = F.regexp_extract("ts", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}", 0).try_cast("date")
    e = ep(s, d).withColumn("dy", day).filter("dy is not null")
    below = e.filter(F.col("ts") <= NEAR).orderBy(F.desc("ts"), "id").limit(12).withColumn("up", F.lit(False)).withColumn("n", F.row_number().over(Window.orderBy(F.desc("ts"), "id")))
    above = e.filter(F.col("ts") > NEAR).orderBy("ts", "id").limit(12).withColumn("up", F.lit(True)).withColumn("n", F.row_number().over(Window.orderBy("ts", "id")))
    both = below.unionByName(above).withColumn("score", F.round(1.0 / (1 + F.abs(F.datediff("dy", F.lit(NEAR[:10]).cast("date")))), 6))
    return both.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "up", "n")).cast("bigint")).filter("rank <= 20").select("id", "rank", "score")


@C.add("src08_neighbours", "select id, lag(id) over w prev_id, lead(id) over w next_id from ep where session_id is not null window w as (partition by session_id order by id)", "ep")
def _(s, d):
    from palimpsest.operators.neighbours import with_neighbours

    e = ep(s, d).filter("session_id is not null").select("id", "session_id")
    return with_neighbours(e, ["session_id"], "id", ["id"], 65_536).select("id", F.col("prev.id").alias("prev_id"), F.col("nxt.id").alias("next_id"))


@C.add("src09_entity_vocabulary", "select distinct name from lk", "lk")
def _(s, d):
    return lk(s, d).select("name").distinct()


@C.add("src12_dedupe_ledger", "select session_id, count(*) as n from (select distinct hash, session_id from ingest_log) l where not exists (select 1 from ingest_log x where x.hash = l.hash and x.ingested_at < '2024-06-01') group by session_id")
def _(s, d):
    from palimpsest.operators.lifecycle import unseen

    log = table(s, d, "ingest_log")
    return unseen(log.select("hash", "session_id"), log.filter(F.col("ingested_at") < "2024-06-01")).groupBy("session_id").agg(F.count("*").alias("n"))


@C.add("src14_diagnostics", """select 'episodes' as "table", count(*) n, count(distinct id) ids, count(emb) vectors from episodes union all select 'facts', count(*), count(distinct id), count(emb) from facts
    union all select 'entities', count(*), count(distinct name), 0 from entities union all select 'entity_aliases', count(*), count(distinct alias), 0 from entity_aliases""")
def _(s, d):
    one = lambda t, key, vec: table(s, d, t).agg(F.lit(t).alias("table"), F.count("*").alias("n"), F.countDistinct(key).alias("ids"), (F.count("emb") if vec else F.lit(0).cast("bigint")).alias("vectors"))
    return one("episodes", "id", True).unionByName(one("facts", "id", True)).unionByName(one("entities", "name", False)).unionByName(one("entity_aliases", "alias", False))


@C.add("src15_legacy_scope", "select id, coalesce(trim(scope), '') as scope from (select distinct id, scope from facts)")
def _(s, d):
    f = table(s, d, "facts")
    scope = F.coalesce(F.trim("scope"), F.lit("")) if "scope" in f.columns else F.lit("")
    return f.select("id", scope.alias("scope")).distinct()


@C.add("src21_growth_documents", "select cast(i as bigint) as id, 'doc ' || i || ' on topic ' || (i % 5) as text, cast(i % 5 as bigint) topic from range(10000) t(i)")
def _(s, d):
    return s.range(10_000).select("id", F.concat(F.lit("doc "), F.col("id"), F.lit(" on topic "), F.col("id") % 5).alias("text"), (F.col("id") % 5).alias("topic"))


@C.add("flt01_currently_valid", "select id from fa where invalid_at is null", "fa")
def _(s, d):
    return fa(s, d).filter("invalid_at is null").select("id")


@C.add("flt02_key_history", "select id, valid_from, invalid_at from fa where subject = 'user' and scope = ''", "fa")
def _(s, d):
    return fa(s, d).filter("subject = 'user' and scope = ''").select("id", "valid_from", "invalid_at")


@C.add("flt03_without_observations", "select kind, count(*) as n from fa where kind != 'observation' group by kind", "fa")
def _(s, d):
    return fa(s, d).filter("kind != 'observation'").groupBy("kind").agg(F.count("*").alias("n"))


@C.add("flt09_policy_filter", """select id from fa where coalesce(case when id % 11 = 0 then 'untrusted' when id % 7 = 0 then 'tool' end, 'owner') in ('owner', 'agent', 'tool') and id % 13 != 0""", "fa")
def _(s, d):
    """Origins and quarantine stand in for the governance columns, which the tables lack."""
    f = fa(s, d).select("id", F.when(F.col("id") % 11 == 0, "untrusted").when(F.col("id") % 7 == 0, "tool").alias("origin"), (F.col("id") % 13 == 0).alias("quarantined"))
    return f.filter(F.coalesce("origin", F.lit("owner")).isin("owner", "agent", "tool") & ~F.col("quarantined")).select("id")


def _spark_secret_sql(c: str) -> str:
    for p in tx.SECRETS:
        c = f"regexp_replace({c}, '{p}', '[REDACTED]', 'g')"
    return c


@C.add("flt12_redaction", f"select id, r as redacted from (select id, content, {_spark_secret_sql('content')} r from ep) where r is distinct from content", "ep")
def _(s, d):
    return ep(s, d).select("id", "content", tx.redact_secrets(F.col("content")).alias("redacted")).filter(~F.col("redacted").eqNullSafe(F.col("content"))).select("id", "redacted")


@C.add("flt13_limits", "select id, substr(coalesce(role, 'user'), 1, 40) as role, substr(content, 1, 8000) as content from ep", "ep")
def _(s, d):
    return ep(s, d).select("id", F.substring(F.coalesce("role", F.lit("user")), 1, 40).alias("role"), F.substring("content", 1, 8000).alias("content"))


@C.add("flt18_unanswerable", "select qid from qs where lower(qid) like '%\\_abs' escape '\\' or category = '5' or abstention", "qs")
def _(s, d):
    return qs(s, d).filter(F.lower("qid").endswith("_abs") | (F.col("category") == "5") | F.col("abstention")).select("qid")


@C.add("flt19_split", "select case when (instr('0123456789abcdef', substr(sha256(qid), 2, 1)) - 1) % 2 = 0 then 'dev' else 'test' end as split, count(*) as n from qs group by 1", "qs")
def _(s, d):
    first = F.conv(F.substring(F.sha2("qid", 256), 1, 2), 16, 10).cast("int")
    return qs(s, d).groupBy(F.when(first % 2 == 0, "dev").otherwise("test").alias("split")).agg(F.count("*").alias("n"))


@C.add("prj02_vector_text", "select id, statement || case when scope != '' then ' scope:' || scope else '' end as text from fa", "fa")
def _(s, d):
    return fa(s, d).select("id", F.concat("statement", F.when(F.col("scope") != "", F.concat(F.lit(" scope:"), F.col("scope"))).otherwise("")).alias("text"))


@C.add("prj03_contextual_text", "select id, coalesce(right(lag(content) over (partition by session_id order by id), 200), '') || chr(10) || coalesce(content, '') as text from ep where session_id is not null", "ep")
def _(s, d):
    from palimpsest.operators.neighbours import with_neighbours

    e = ep(s, d).filter("session_id is not null").withColumn("tail", F.expr("right(content, 200)"))
    n = with_neighbours(e, ["session_id"], "id", ["tail"], 65_536, nxt=None)
    return n.select("id", F.concat(F.coalesce("prev.tail", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit(""))).alias("text"))


@C.add("jn01_entity_facts", "select id from fa where id in (select fact_id from lk where name = 'ashvale') and kind != 'observation'", "fa lk")
def _(s, d):
    mine = lk(s, d).filter("name = 'ashvale'").select(F.col("fact_id").alias("id"))
    return fa(s, d).filter("kind != 'observation'").join(mine, "id", "left_semi").select("id")




_HOP_Q = "hq as (select distinct cast(l.fact_id as varchar) as qid, l.name from lk l join fa f on f.id = l.fact_id where f.predicate = 'works_at' and l.fact_id % 20 = 0)"


def _hop_names(s, d):
    """Queries by example: the names of every works_at fact whose id is divisible by 20 (a query set, run against all links)."""
    f = fa(s, d).filter("predicate = 'works_at' and id % 20 = 0").select(F.col("id").alias("fact_id"))
    return lk(s, d).join(f, "fact_id").select(F.col("fact_id").cast("string").alias("qid"), "name").distinct()


_HOP1 = _HOP_Q + """, h1 as (select qid, fact_id, cast(count(*) as bigint) matched from hq join lk using (name) group by qid, fact_id),
 r1 as (select *, row_number() over (partition by qid order by matched desc, fact_id) as rank from h1)"""


@C.add("jn02_entity_hop1", f"with {_HOP1} select qid, fact_id, matched, cast(rank as bigint) as rank from r1 where rank <= 20", "fa lk")
def _(s, d):
    return graph.hop_one(_hop_names(s, d), lk(s, d), 20)


@C.add("jn03_entity_two_hop", f"""with {_HOP1}, h2n as (select qid, name from (select qid, name, row_number() over (partition by qid order by name) r from (
    select distinct h.qid, l.name from (select * from r1 where rank <= 20) h join lk l using (fact_id) where not exists (select 1 from hq where hq.qid = h.qid and hq.name = l.name))) where r <= 20),
    h2 as (select n.qid, l.fact_id, cast(count(*) as bigint) matched from h2n n join lk l using (name) group by n.qid, l.fact_id)
    select qid, fact_id, matched, cast(rank as bigint) as rank from (select h2.*, row_number() over (partition by qid order by matched desc, fact_id) as rank from h2
      where not exists (select 1 from r1 where r1.rank <= 20 and r1.qid = h2.qid and r1.fact_id = h2.fact_id)) where rank <= 20""", "fa lk")
def _(s, d):
    names, links = _hop_names(s, d), lk(s, d)
    return graph.hop_two(names, links, graph.hop_one(names, links, 20), 20)


_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[a-z][a-z0-9''-]+'))"


@C.add("jn04_entity_containment", f"""with v as (select distinct name, {_WORDS.format('name')} t from lk), q as (select id as qid, {_WORDS.format('statement')} w from fa)
    select qid, name from (select q.qid, v.name, row_number() over (partition by q.qid order by v.name) r from q, v where len(v.t) > 0 and len(list_intersect(v.t, q.w)) = len(v.t)) where r <= 10""", "fa lk")
def _(s, d):
    q = fa(s, d).select(F.col("id").alias("qid"), F.col("statement").alias("question"))
    return graph.contained(q, lk(s, d).select("name").distinct())


@C.add("jn06_alias_resolution", "select coalesce(al.canonical, lk.name) as name, count(*) as n from lk left join (select alias, any_value(canonical) canonical from al group by alias) al on al.alias = lk.name group by 1", "lk al")
def _(s, d):
    return graph.resolve_aliases(lk(s, d), table(s, d, "entity_aliases")).groupBy("name").agg(F.count("*").alias("n"))


@C.add("jn09_candidates_to_rows", "select f.id, e.content, e.ts from fa f join ep e on e.id = f.episode_id where f.kind != 'observation'", "fa ep")
def _(s, d):
    f = fa(s, d).filter("kind != 'observation' and episode_id is not null").select("id", "episode_id")
    return f.join(ep(s, d).withColumnRenamed("id", "episode_id"), "episode_id").select("id", "content", "ts")


@C.add("jn17_nearest_date", f"""with d as (select id, ts, {_DAY_SQL} dy from ep where ts is not null), q as (select distinct qid, try_cast(regexp_extract(question_date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') as date) qd from qs),
    c as (select qid, id, dy, qd, row_number() over (partition by qid order by abs(date_diff('day', dy, qd)), id) r from q join d on dy between qd - 3 and qd + 3 where qd is not null)
    select qid, id, cast(r as bigint) as rank, round(1.0 / (1 + abs(date_diff('day', dy, qd))), 6) score from c where r <= 10""", "ep qs")
def _(s, d):
    """Turns nearest to a date within three days, by an equi-join on the day."""
    day = lambda c: F.regexp_extract(c, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}", 0).try_cast("date")
    q = qs(s, d).select("qid", day("question_date").alias("qd")).filter("qd is not null").withColumn("dy", F.explode(F.sequence(F.date_sub("qd", 3), F.date_add("qd", 3))))
    e = ep(s, d).select("id", day("ts").alias("dy")).filter("dy is not null")
    gap = F.abs(F.datediff("dy", "qd"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(gap, "id"))
    return q.join(e, "dy").withColumn("rank", rank.cast("bigint")).filter("rank <= 10").select("qid", "id", "rank", F.round(1.0 / (1 + gap), 6).alias("score"))


@C.add("jn21_distractors", "select qid, session_id from (select q.qid, m.session_id, row_number() over (partition by q.qid order by sha256('7' || q.qid || m.session_id)) r from (select qid, evidence_sessions ev from questions) q join (select distinct session_id, owner from session_meta) m on substr(sha256(q.qid), 1, 1) = substr(sha256(m.session_id), 1, 1) where not list_contains(coalesce(q.ev, []), m.session_id)) where r <= 5")
def _(s, d):
    """Unrelated sessions per question by a seeded hash, drawn from those in the same hash class."""
    q = table(s, d, "questions").select("qid", "evidence_sessions", F.substring(F.sha2("qid", 256), 1, 1).alias("h"))
    m = table(s, d, "session_meta").select("session_id").distinct().withColumn("h", F.substring(F.sha2("session_id", 256), 1, 1))
    pairs = q.join(m, "h").filter(~F.coalesce(F.array_contains("evidence_sessions", F.col("session_id")), F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.sha2(F.concat(F.lit("7"), "qid", "session_id"), 256)))
    return pairs.withColumn("r", rank).filter("r <= 5").select("qid", "session_id")


@C.add("jn23_federation", """with a as (select 'even' store, 0 so, doc_id, row_number() over (order by n_chars desc, doc_id) as rank from documents where doc_id % 2 = 0), b as (select 'odd', 1, doc_id, row_number() over (order by n_chars desc, doc_id) as rank from documents where doc_id % 2 = 1)
    select store, doc_id, cast(rank as bigint) as rank, round(1.0 / (60 + rank), 9) score from (select * from a where rank <= 50 union all select * from b where rank <= 50)""")
def _(s, d):
    """Two stores ranked apart; equal ranks stand in order of the stores, scores are never summed across stores."""
    docs = table(s, d, "documents").select("doc_id", "n_chars")
    top = lambda p: docs.filter(F.col("doc_id") % 2 == p).orderBy(F.desc("n_chars"), "doc_id").limit(50).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).cast("bigint"))
    both = top(0).withColumn("store", F.lit("even")).unionByName(top(1).withColumn("store", F.lit("odd")))
    return both.select("store", "doc_id", "rank", F.round(1.0 / (60 + F.col("rank")), 9).alias("score"))


@C.add("agg01_stats", "select (select count(*) from ep) as episodes, (select count(*) from fa) as facts, (select count(*) from fa where invalid_at is null) as valid_facts, (select count(distinct name) from lk) as entities", "ep fa lk")
def _(s, d):
    rows = ep(s, d).agg(F.count("*").alias("n")).select(F.lit("episodes").alias("k"), "n")
    rows = rows.unionByName(fa(s, d).agg(F.count("*").alias("facts"), F.count_if(F.col("invalid_at").isNull()).alias("valid_facts")).select(F.explode(F.create_map(F.lit("facts"), "facts", F.lit("valid_facts"), "valid_facts")).alias("k", "n")))
    rows = rows.unionByName(lk(s, d).agg(F.countDistinct("name").alias("n")).select(F.lit("entities").alias("k"), "n"))
    return rows.groupBy().pivot("k", ["episodes", "facts", "valid_facts", "entities"]).agg(F.first("n"))


@C.add("agg02_predicate_groups", "select subject, predicate, count(*) as n from fa where kind != 'observation' and subject != '' and predicate != '' group by 1, 2 having count(*) >= 2", "fa")
def _(s, d):
    f = fa(s, d).filter("kind != 'observation' and subject != '' and predicate != ''")
    return f.groupBy("subject", "predicate").agg(F.count("*").alias("n")).filter("n >= 2")


@C.add("agg03_scoped_groups", "select subject, predicate, scope, count(*) as n from fa where kind != 'observation' and subject != '' and predicate != '' and invalid_at is null group by 1, 2, 3 having count(*) >= 2", "fa")
def _(s, d):
    f = fa(s, d).filter("kind != 'observation' and subject != '' and predicate != '' and invalid_at is null")
    return f.groupBy("subject", "predicate", "scope").agg(F.count("*").alias("n")).filter("n >= 2")


_UNITS = r"([0-9,]+(?:\.[0-9]+)?)\s*(hours?|hrs?|days?|minutes?|mins?|miles?|kilometers?|km|weeks?|months?|years?|dollars?|usd)\b"
_CANON = {"hour": "hours", "hr": "hours", "day": "days", "minute": "minutes", "min": "minutes", "mile": "miles", "kilometer": "km", "km": "km", "week": "weeks", "month": "months", "year": "years", "dollar": "$", "usd": "$"}
_CANON_SQL = "case regexp_replace(lower(u), 's$', '') " + " ".join(f"when '{k}' then '{v}'" for k, v in _CANON.items()) + " end"


@C.add("agg11_numeric_totals", rf"""with m as (select id, unnest(regexp_extract_all(lower(coalesce(content, '')), '{_UNITS}')) x from ep), v as (select regexp_extract(x, '{_UNITS}', 1) n, regexp_extract(x, '{_UNITS}', 2) u from m),
    c as (select '$' as unit, unnest(regexp_extract_all(coalesce(content, ''), '\$\s*([0-9,]+(?:\.[0-9]+)?)', 1)) n from ep), a as (select {_CANON_SQL} unit, n from v union all select unit, n from c)
    select unit, cast(count(*) as bigint) as n, round(sum(cast(replace(n, ',', '') as double)), 2) as total from a where replace(n, ',', '') != '' group by unit having count(*) >= 2""", "ep")
def _(s, d):
    e = ep(s, d).select(F.lower(F.coalesce("content", F.lit(""))).alias("t"))
    units = e.select(F.explode(F.arrays_zip(F.regexp_extract_all("t", F.lit(_UNITS), F.lit(1)).alias("n"), F.regexp_extract_all("t", F.lit(_UNITS), F.lit(2)).alias("u"))).alias("x"))
    canon = F.create_map(*[F.lit(x) for kv in _CANON.items() for x in kv])
    units = units.select(canon[F.regexp_replace("x.u", "s$", "")].alias("unit"), F.col("x.n").alias("n"))
    money = e.select(F.lit("$").alias("unit"), F.explode(F.regexp_extract_all("t", F.lit(r"\$\s*([0-9,]+(?:\.[0-9]+)?)"), F.lit(1))).alias("n"))
    both = units.unionByName(money).withColumn("n", F.replace("n", F.lit(","), F.lit(""))).filter("n != ''")
    return both.groupBy("unit").agg(F.count("*").alias("n"), F.round(F.sum(F.col("n").cast("double")), 2).alias("total")).filter("n >= 2")


@C.add("agg12_entity_scope_groups", "select l.name, f.scope, count(*) as n from lk l join fa f on f.id = l.fact_id where f.kind != 'observation' and f.invalid_at is null group by 1, 2 having count(*) >= 3", "fa lk")
def _(s, d):
    f = fa(s, d).filter("kind != 'observation' and invalid_at is null").select(F.col("id").alias("fact_id"), "scope")
    return lk(s, d).join(f, "fact_id").groupBy("name", "scope").agg(F.count("*").alias("n")).filter("n >= 3")


@C.add("agg25_distinct_counts", "select predicate, count(distinct subject) as subjects, count(distinct object) as objects from fa group by predicate", "fa")
def _(s, d):
    return fa(s, d).groupBy("predicate").agg(F.countDistinct("subject").alias("subjects"), F.countDistinct("object").alias("objects"))


_BY = "select subject as qid, id, kind, session_id, invalid_at, row_number() over (partition by subject order by ingested_at desc nulls last, id) as rank from fa"


def _ranked_facts(s, d):
    w = Window.partitionBy("subject").orderBy(F.col("ingested_at").desc_nulls_last(), "id")
    return fa(s, d).select(F.col("subject").alias("qid"), "id", "kind", "session_id", "invalid_at", "statement", F.row_number().over(w).cast("bigint").alias("rank"))


@C.add("win04_prefix_dedupe", "select id from (select id, row_number() over (partition by coalesce(session_id, ''), substr(content, 1, 80) order by id) n from ep) where n = 1", "ep")
def _(s, d):
    e = ep(s, d).select("id", F.coalesce("session_id", F.lit("")).alias("s"), F.substring("content", 1, 80).alias("p"))
    return e.groupBy("s", "p").agg(F.min("id").alias("id")).select("id")


@C.add("win05_observation_slots", f"select qid, id from (select qid, id, kind, row_number() over (partition by qid, kind = 'observation' order by rank) n from ({_BY})) where n <= case when kind = 'observation' then 4 else 10 end", "fa")
def _(s, d):
    return fusion.slots(_ranked_facts(s, d), 10, 4, F.col("kind") == "observation").select("qid", "id")


@C.add("win06_current_first", f"select qid, id, cast(row_number() over (partition by qid order by invalid_at is not null, rank) as bigint) place from ({_BY}) where rank <= 10", "fa")
def _(s, d):
    w = Window.partitionBy("qid").orderBy(F.col("invalid_at").isNotNull(), "rank")
    return _ranked_facts(s, d).filter("rank <= 10").select("qid", "id", F.row_number().over(w).cast("bigint").alias("place"))


@C.add("win07_session_diverse", f"""with r as (select qid, id, rank, coalesce(session_id, '#' || id) s from ({_BY}) where rank <= 15), f as (select *, rank <= 5 top, row_number() over (partition by qid, s order by rank) seen from r),
    n as (select *, case when top and seen > 1 then row_number() over (partition by qid, top and seen > 1 order by rank) end dn, case when not top and seen = 1 then row_number() over (partition by qid, not top and seen = 1 order by rank) end fn from f),
    m as (select *, least(sum(case when top and seen > 1 then 1 else 0 end) over (partition by qid), sum(case when not top and seen = 1 then 1 else 0 end) over (partition by qid)) m from n)
    select qid, id, cast(row_number() over (partition by qid order by rank) as bigint) place from m where (top and (dn is null or dn > m)) or fn <= m""", "fa")
def _(s, d):
    return fusion.session_diverse(_ranked_facts(s, d).filter("rank <= 15").select("qid", "id", "session_id", "rank"), 5).select("qid", "id", "place")


@C.add("win08_window_of_turns", "select id, count(*) over (partition by session_id order by id rows between 2 preceding and 2 following) as around from ep where session_id is not null", "ep")
def _(s, d):
    """Turn windows of every session, the shared one included."""
    from palimpsest.operators.neighbours import around

    return around(ep(s, d).filter("session_id is not null").select("session_id", "id"), "session_id", "id", 2, 65_536).select("id", "around")


@C.add("win10_round_robin", "select doc_id, cast(turn as bigint) turn from (select doc_id, lang, row_number() over (partition by lang order by doc_id) turn from documents) order by turn, lang nulls first, doc_id limit 100")
def _(s, d):
    from palimpsest.operators.evaluation import round_robin

    return round_robin(table(s, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 100).select("doc_id", "turn")


@C.add("win12_session_cap", "select qid, id from (select qid, id, row_number() over (partition by qid, session_id order by rank) n from (" + _BY + ") where session_id is not null) where n <= 2", "fa")
def _(s, d):
    w = Window.partitionBy("qid", "session_id").orderBy("rank")
    return _ranked_facts(s, d).filter("session_id is not null").withColumn("n", F.row_number().over(w)).filter("n <= 2").select("qid", "id")


@C.add("win14_running_ingest", "select day, cast(sum(n) over (order by day) as bigint) as total from (select substr(ingested_at, 1, 10) as day, count(*) n from ingest_log group by 1)")
def _(s, d):
    per = table(s, d, "ingest_log").groupBy(F.substring("ingested_at", 1, 10).alias("day")).agg(F.count("*").alias("n"))
    return per.select("day", F.sum("n").over(Window.orderBy("day")).alias("total"))  # one row a day


@C.add("set01_candidate_union", "select distinct id from (select id from ep where lower(content) like '%reminder%' union all select episode_id from fa where predicate = 'asked_about' and episode_id is not null)", "ep fa")
def _(s, d):
    a = ep(s, d).filter(F.lower("content").contains("reminder")).select("id")
    return a.unionByName(fa(s, d).filter("predicate = 'asked_about' and episode_id is not null").select(F.col("episode_id").alias("id"))).distinct()


@C.add("set02_difference", "select distinct fact_id from lk where fact_id not in (select fact_id from lk where name = 'ashvale')", "lk")
def _(s, d):
    return lk(s, d).select("fact_id").distinct().join(lk(s, d).filter("name = 'ashvale'").select("fact_id"), "fact_id", "left_anti")


@C.add("set04_max_merge", "select session_id, max(length(content)) as best, arg_max(id, (length(content), -id)) as id from ep where session_id is not null and content is not null group by session_id", "ep")
def _(s, d):
    e = ep(s, d).filter("session_id is not null and content is not null")
    return e.groupBy("session_id").agg(F.max(F.length("content")).cast("bigint").alias("best"), F.max_by("id", F.struct(F.length("content"), -F.col("id"))).alias("id"))


@C.add("set06_replacement", """select id from (select id, row_number() over (partition by coalesce(statement, ''), subject, predicate, coalesce(object, ''), scope, kind order by id desc) n from fa) where n = 1""", "fa")
def _(s, d):
    f = fa(s, d).select("id", F.coalesce("statement", F.lit("")).alias("st"), "subject", "predicate", F.coalesce("object", F.lit("")).alias("ob"), "scope", "kind")
    return f.groupBy("st", "subject", "predicate", "ob", "scope", "kind").agg(F.max("id").alias("id")).select("id")


@C.add("prj01_hits", "select id, round(1.0 / (1 + id), 4) as score, kind != 'fact' or invalid_at is null as \"current\" from (select id, case when kind = 'observation' then kind else 'fact' end kind, invalid_at from fa)", "fa")
def _(s, d):
    f = fa(s, d).withColumn("kind", F.when(F.col("kind") == "observation", "observation").otherwise("fact"))
    return f.select("id", F.round(1.0 / (1 + F.col("id")), 4).alias("score"), ((F.col("kind") != "fact") | F.col("invalid_at").isNull()).alias("current"))
