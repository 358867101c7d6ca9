"""Text and time functions over whole tables, and retrieval built from them."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import phrases
from palimpsest.functions import text as tx
from palimpsest.operators import fusion, graph, lexical, packing, plugins, vector
from palimpsest.operators.neighbours import joined_text
from palimpsest.plans.base import Catalogue, alike, ep, fa, gold, lk, qs, to_all
from palimpsest.sources.tables import once, table

C = Catalogue()
_A, _P = tx.ACCENTED, tx.PLAIN
_FOLD = f"translate(lower({{0}}), '{_A}', '{_P}')"
_TOK = f"regexp_extract_all({_FOLD}, '[\\p{{{{L}}}}\\p{{{{N}}}}]+')"
_MATCH = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 1)[1:32]"
_STOP = "[" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + "]"
_TIDY = r"list_transform(regexp_extract_all(lower({0}), '[A-Za-z0-9][A-Za-z0-9''_-]*|[\p{{L}}\p{{N}}_]+'), lambda w: replace(regexp_replace(w, '^[''_-]+|[''_-]+$', '', 'g'), '''', ''))"
_SUF = "case " + " ".join(f"when suffix({{0}}, '{s}') and length({{0}}) > {len(s) + 3} then left({{0}}, length({{0}}) - {len(s)})" for s in tx.SUFFIXES) + " else {0} end"


def _intent(c: str, name: str) -> str:
    return f"coalesce(regexp_matches(lower({c}), '{tx.INTENTS[name]}'), false)"


@C.add("str01_match_tokens", f"select qid, array_to_string({_MATCH.format('question')}, ' ') as tokens from qs", "qs")
def _(s, d):
    return qs(s, d).select("qid", F.array_join(tx.match_tokens(F.col("question")), " ").alias("tokens"))


@C.add("str02_query_terms", f"""with t as (select qid, list_filter({_TIDY.format('question')}, lambda w: length(w) > 1) l from qs), u as (select qid, x, min(n) n from (select qid, unnest(l) x, generate_subscripts(l, 1) n from t) group by qid, x),
    k as (select qid, string_agg(x, ' ' order by n) filter (not list_contains({_STOP}, x)) kept, string_agg(x, ' ' order by n) every from u group by qid) select q.qid, coalesce(k.kept, k.every, '') as terms from qs q left join k using (qid)""", "qs")
def _(s, d):
    return qs(s, d).select("qid", F.array_join(tx.query_terms(F.col("question")), " ").alias("terms"))


@C.add("str03_light_stem", f"with w as (select distinct unnest({_TOK.format('statement')}) as word from fa) select word, {_SUF.format('word')} as stem from w", "fa")
def _(s, d):
    w = fa(s, d).select(F.explode(tx.index_tokens(F.col("statement"))).alias("word")).distinct()
    return w.select("word", tx.light_stem(F.col("word")).alias("stem"))


@C.add("str06_index_tokens", f"select id, len({_TOK.format('content')}) as n, array_to_string({_TOK.format('content')}, ' ') as tokens from ep where content is not null", "ep")
def _(s, d):
    return ep(s, d).filter("content is not null").select("id", F.size(tx.index_tokens(F.col("content"))).cast("bigint").alias("n"), F.array_join(tx.index_tokens(F.col("content")), " ").alias("tokens"))


@C.add("str07_entity_tokens", "select qid, array_to_string(regexp_extract_all(lower(question), '[a-z][a-z0-9''-]+'), ' ') as tokens from qs", "qs")
def _(s, d):
    return qs(s, d).select("qid", F.array_join(F.regexp_extract_all(F.lower("question"), F.lit(r"([a-z][a-z0-9'-]+)"), F.lit(1)), " ").alias("tokens"))


@C.add("str10_speaker", r"""select id, case when role is not null and lower(trim(role)) not in ('user', 'assistant', 'system', 'tool', 'human', 'ai', 'bot') then lower(trim(role))
    else lower(regexp_extract(coalesce(content, ''), '^\s*([A-Z][A-Za-z0-9_''.-]{0,30}(?: [A-Z][A-Za-z0-9_''.-]{0,30}){0,2}):\s', 1)) end as speaker from ep""", "ep")
def _(s, d):
    return ep(s, d).select("id", tx.speaker(F.col("role"), F.col("content")).alias("speaker"))


@C.add("str11_content_words", rf"""select id, len(list_filter(regexp_extract_all(lower(regexp_replace(coalesce(content, ''), '^\s*[A-Z][A-Za-z0-9_''.-]{{0,30}}(?: [A-Z][A-Za-z0-9_''.-]{{0,30}}){{0,2}}:\s', '')), '[A-Za-z0-9][A-Za-z0-9''_-]*|[\p{{L}}\p{{N}}_]+'),
    lambda w: length(w) > 2 and not list_contains({_STOP}, w))) as n from ep""", "ep")
def _(s, d):
    return ep(s, d).select("id", tx.content_words(F.col("content")).cast("bigint").alias("n"))


@C.add("str12_dateish", f"select id from ep where {_intent('content', 'dateish')}", "ep")
def _(s, d):
    return ep(s, d).filter(tx.intent(F.col("content"), "dateish")).select("id")


@C.add("str14_scope_normal", "select id, regexp_replace(lower(regexp_replace(scope, '[\\x22'']', '', 'g')), '\\s+', ' ', 'g') as scope from fa where scope != ''", "fa")
def _(s, d):
    return fa(s, d).filter("scope != ''").select("id", F.regexp_replace(F.lower(F.regexp_replace("scope", "[\"']", "")), r"\s+", " ").alias("scope"))


_ANCHOR = "try_cast(regexp_replace({0}, '^\\s*(\\d{{4}})[-/](\\d{{1,2}})[-/](\\d{{1,2}})[\\s\\S]*$', '\\1-\\2-\\3') as date)"


@C.add("str15_stamp", f"select id, coalesce(strftime({_ANCHOR.format('ts')}, '%Y-%m-%d %a'), 'undated') as stamp from ep where ts is null or regexp_matches(ts, '^\\d{{4}}[-/]\\d{{2}}[-/]\\d{{2}}') or not regexp_matches(ts, '^\\s*\\d{{4}}[-/]')", "ep")
def _(s, d):
    shaped = F.col("ts").isNull() | F.col("ts").rlike(r"^\d{4}[-/]\d{2}[-/]\d{2}") | ~F.col("ts").rlike(r"^\s*\d{4}[-/]")
    return ep(s, d).filter(shaped).select("id", tx.stamp(F.col("ts")).alias("stamp"))


@C.add("str17_survival_form", r"select id, lower(trim(regexp_replace(regexp_replace(content, ' \[[^\]]*\]', '', 'g'), '\s+', ' ', 'g'), ' ')) as text from ep where content is not null", "ep")
def _(s, d):
    t = F.regexp_replace(F.regexp_replace("content", r" \[[^\]]*\]", ""), r"\s+", " ")
    return ep(s, d).filter("content is not null").select("id", F.lower(F.trim(t)).alias("text"))


@C.add("str18_chunks", "select doc_id, cast(i as bigint) as chunk, substr(text, cast(i * 400 + 1 as bigint), 400) as part from (select doc_id, text, unnest(range(cast(ceil(length(text) / 400.0) as bigint))) i from documents where text is not null and length(text) > 0)")
def _(s, d):
    docs = table(s, d, "documents").filter("length(text) > 0").select("doc_id", "text")
    at = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / 400).cast("int") - 1)).alias("i"))
    return at.select("doc_id", F.col("i").cast("bigint").alias("chunk"), F.expr("substring(text, i * 400 + 1, 400)").alias("part"))


@C.add("str18_session_render", "select session_id, string_agg(coalesce(role, 'user') || ': ' || coalesce(content, ''), chr(10) order by id) as text from ep where session_id is not null group by session_id", "ep")
def _(s, d):
    """Every session as text, the shared one from ordered pieces."""
    line = F.concat(F.coalesce("role", F.lit("user")), F.lit(": "), F.coalesce("content", F.lit("")))
    got = joined_text(ep(s, d).filter("session_id is not null"), ["session_id"], F.floor(F.col("id") / 65_536), ["id"], line, "\n")
    return got.select("session_id", "text")


@C.add("str19_overlap", "select id, cast(len(list_intersect(string_split(lower(statement), ' '), string_split(lower(coalesce(object, '')), ' '))) as bigint) as n from fa where statement is not null", "fa")
def _(s, d):
    return fa(s, d).filter("statement is not null").select("id", tx.overlap(F.col("statement"), F.coalesce("object", F.lit(""))).cast("bigint").alias("n"))


@C.add("str20_clip", "select id, case when length(content) > 60 then substr(content, 1, 60) || ' ...' else content end as text from ep where content is not null", "ep")
def _(s, d):
    return ep(s, d).filter("content is not null").select("id", tx.clip(F.col("content"), 60).alias("text"))


@C.add("str21_predicate_label", "select distinct predicate, replace(predicate, '_', ' ') as label from fa", "fa")
def _(s, d):
    return fa(s, d).select("predicate", F.replace("predicate", F.lit("_"), F.lit(" ")).alias("label")).distinct()


@C.add("str08_excerpt")
def _(s, d):
    """Excerpts of whole documents for the question 'token budget of the session index'; rows only."""

    @F.pandas_udf("string")
    def cut(t):
        return t.map(lambda x: None if x is None else packing.excerpt(x, "token budget of the session index", 300))

    return table(s, d, "documents").select("doc_id", cut("text").alias("text"))


@C.add("flt17_intents", "select qid, " + ", ".join(f"{_intent('question', k)} as {k}" for k in tx.INTENTS) + " from qs", "qs")
def _(s, d):
    return qs(s, d).select("qid", *[tx.intent(F.col("question"), k).alias(k) for k in tx.INTENTS])


_DATES = r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})"


@C.add("dt16_extract_dates", rf"""with t as (select 'f' || id as id, valid_from as text from fa union all select 'e' || id, ts from ep), m as (select id, text, unnest(regexp_extract_all(text, '{_DATES}')) x from t where text is not null)
    select id, string_agg(distinct lpad(regexp_extract(x, '{_DATES}', 1), 4, '0') || '-' || lpad(regexp_extract(x, '{_DATES}', 2), 2, '0') || '-' || lpad(regexp_extract(x, '{_DATES}', 3), 2, '0'), ',') as dates from m
    where not regexp_matches(text, '[A-Za-z]{{3,}}\s+\d') and not regexp_matches(text, '\d\s+[A-Za-z]{{3,}}') group by id""", "fa ep")
def _(s, d):
    t = fa(s, d).select(F.concat(F.lit("f"), "id").alias("id"), F.col("valid_from").alias("text")).unionByName(ep(s, d).select(F.concat(F.lit("e"), "id").alias("id"), F.col("ts").alias("text")))
    t = t.filter(~F.col("text").rlike(r"[A-Za-z]{3,}\s+\d") & ~F.col("text").rlike(r"\d\s+[A-Za-z]{3,}"))
    return t.select("id", F.array_join(tx.dates_in(F.col("text")), ",").alias("dates")).filter("dates != ''")


@C.add("dt16_extract_named_dates", r"""select id, strftime(t, '%Y-%m-%d') || ',' || strftime(t, '%Y-%m') || '-15' as dates from (select id, coalesce(try_strptime(event_date, '%d %B %Y'), try_strptime(event_date, '%d %b %Y')) t from fa where regexp_matches(event_date, '^\d{1,2} [A-Za-z]+ \d{4}$'))""", "fa")
def _(s, d):
    """A day with its month's name also reads as that month, which stands for its 15th."""
    f = fa(s, d).filter(F.col("event_date").rlike(r"^\d{1,2} [A-Za-z]+ \d{4}$"))
    return f.select("id", F.array_join(tx.dates_in(F.col("event_date")), ",").alias("dates"))


@C.add("dt17_parse_anchor", "select id, try_cast(substr(ts, 1, 10) as date) as day from ep where regexp_matches(ts, '^\\d{4}-\\d\\d-\\d\\d')", "ep")
def _(s, d):
    return ep(s, d).filter(F.col("ts").rlike(r"^\d{4}-\d\d-\d\d")).select("id", tx.anchor_date(F.col("ts")).alias("day"))


_ANCHORED = f"an as (select id, content, {_ANCHOR.format('ts')} a from ep where regexp_matches(ts, '^\\d{{4}}-\\d\\d-\\d\\d'))"


def _anchored(s, d):
    return ep(s, d).filter(F.col("ts").rlike(r"^\d{4}-\d\d-\d\d")).select("id", "content", tx.anchor_date(F.col("ts")).alias("a")).filter("a is not null")


@C.add("dt03_yesterday", f"with {_ANCHORED} select id, a - 1 as day from an where a is not null and regexp_matches(lower(content), '\\b(yesterday|last night)\\b')", "ep")
def _(s, d):
    return _anchored(s, d).filter(F.lower("content").rlike(r"\b(yesterday|last night)\b")).select("id", F.date_sub("a", 1).alias("day"))


@C.add("dt04_today", f"with {_ANCHORED} select id, a as day from an where a is not null and regexp_matches(lower(content), '\\b(today|tonight|this morning|this afternoon|this evening|earlier today)\\b')", "ep")
def _(s, d):
    return _anchored(s, d).filter(F.lower("content").rlike(r"\b(today|tonight|this morning|this afternoon|this evening|earlier today)\b")).select("id", F.col("a").alias("day"))


_AGO_SQL = f"""with {_ANCHORED}, n as (select id, a, unnest([1, 2, 3, 5, 8]) n from an where a is not null)
  select id, u as unit, cast(n as bigint) as n, cast(case u when 'day' then a - cast(n as int) when 'week' then date_trunc('week', a - cast(7 * n as int)) when 'month' then date_trunc('month', date_trunc('month', a) - to_months(cast(n as int))) else make_date(year(a) - n, 1, 1) end as date) as first,
  cast(case u when 'day' then a - cast(n as int) when 'week' then date_trunc('week', a - cast(7 * n as int)) + interval 6 day when 'month' then last_day(cast(date_trunc('month', a) - to_months(cast(n as int)) as date)) else make_date(year(a) - n, 12, 31) end as date) as last
  from n, (select unnest(['day', 'week', 'month', 'year']) u)"""


@C.add("dt06_n_units_ago", _AGO_SQL, "ep")
def _(s, d):
    x = _anchored(s, d).select("id", "a", F.explode(F.array(*[F.lit(n).cast("bigint") for n in (1, 2, 3, 5, 8)])).alias("n")).select("*", F.explode(F.array(*map(F.lit, ("day", "week", "month", "year")))).alias("unit"))
    return x.select("id", "unit", "n", phrases.ago(F.col("a"), F.col("n"), F.col("unit")).alias("r")).select("id", "unit", "n", "r.*")


@C.add("dt09_weekdays", f"with {_ANCHORED} select id, a - cast((isodow(a) - 1 - 4 - 1 + 7) % 7 + 1 as int) as last_friday, a + cast((4 - (isodow(a) - 1) - 1 + 7) % 7 + 1 as int) as next_friday, a - cast(isodow(a) - 1 as int) + 4 as this_friday from an where a is not null", "ep")
def _(s, d):
    wd = F.weekday("a")
    return _anchored(s, d).select("id", F.date_sub("a", F.pmod(wd - 5, F.lit(7)) + 1).alias("last_friday"), F.date_add("a", F.pmod(3 - wd, F.lit(7)) + 1).alias("next_friday"), F.date_add("a", 4 - wd).alias("this_friday"))


@C.add("dt10_period", f"with {_ANCHORED} select id, cast(date_trunc('week', a - 7) as date) as last_week, cast(date_trunc('month', date_trunc('month', a) - interval 1 month) as date) as last_month, make_date(year(a) + 1, 1, 1) as next_year from an where a is not null", "ep")
def _(s, d):
    return _anchored(s, d).select("id", F.trunc(F.date_sub("a", 7), "week").alias("last_week"), F.trunc(F.add_months("a", -1), "month").alias("last_month"), F.make_date(F.year("a") + 1, F.lit(1), F.lit(1)).alias("next_year"))


@C.add("dt13_number_words", "select w, case when regexp_matches(w, '^\\d+$') then case when cast(w as int) between 1 and 400 then cast(w as bigint) end else " + "case w " + " ".join(f"when '{k}' then {v}" for k, v in phrases.NUMBERS.items()) + " end end as n from (select distinct unnest(regexp_extract_all(lower(content), '\\b(?:\\d{1,3}|[a-z]+)\\b')) w from ep) where w is not null", "ep")
def _(s, d):
    w = ep(s, d).select(F.explode(F.regexp_extract_all(F.lower("content"), F.lit(r"\b(?:\d{1,3}|[a-z]+)\b"), F.lit(0))).alias("w")).distinct()
    return w.select("w", phrases.number_word(F.col("w")).cast("bigint").alias("n"))


@C.add("dt20_day_score", f"with {_ANCHORED} select id, round(1.0 / (1 + abs(date_diff('day', a, date '2024-03-15'))), 6) as score from an where a is not null", "ep")
def _(s, d):
    return _anchored(s, d).select("id", F.round(1.0 / (1 + F.abs(F.datediff("a", F.lit("2024-03-15").cast("date")))), 6).alias("score"))


@C.add("dt14_annotate")
def _(s, d):
    return _anchored(s, d).select("id", phrases.annotate_udf("content", "a").alias("text")).join(_anchored(s, d).select("id", "content"), "id").filter("text != content").select("id", "text")


@C.add("dt01_mentions")
def _(s, d):
    m = _anchored(s, d).select("id", F.explode(phrases.mentions_udf("content", "a")).alias("m"))
    return m.select("id", "m.*")


@C.add("dt15_query_window")
def _(s, d):
    return qs(s, d).select("qid", phrases.query_window_udf("question", tx.anchor_date(F.col("question_date"))).alias("w")).select("qid", "w.*")


@C.add("dt21_dataset_dates", r"""select id, x as "at" from (select id, strftime(try_strptime(substr(ts, 1, 10) || ' ' || substr(ts, 18, 5), '%Y/%m/%d %H:%M'), '%Y-%m-%d %H:%M:%S') x from ep where regexp_matches(ts, '^\d{4}/\d\d/\d\d \([A-Z][a-z]{2}\) \d\d:\d\d$')) where x is not null""", "ep")
def _(s, d):
    """Days that do not exist have no date."""
    e = ep(s, d).filter(F.col("ts").rlike(r"^\d{4}/\d\d/\d\d \([A-Z][a-z]{2}\) \d\d:\d\d$"))
    at = F.concat(F.replace(F.substring("ts", 1, 10), F.lit("/"), F.lit("-")), F.lit(" "), F.substring("ts", 18, 5), F.lit(":00"))
    return e.select("id", F.date_format(at.try_cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("at")).filter("at is not null")


# ---- lexical retrieval ------------------------------------------------------------------------

def _bm25_sql(docs: str, terms: str, k: int = 10, prefix: bool = False) -> str:
    vocab = ", ex as (select distinct v.term word, q.term from (select distinct term from tok) v, (select distinct term from qt) q where starts_with(v.term, q.term)), ptf as (select tf.doc_id, ex.term, sum(tf.tf) tf, any_value(dl) dl from tf join ex on ex.word = tf.term group by 1, 2)" if prefix else ""
    src = "ptf" if prefix else "tf"
    return f"""{docs}, tok as (select doc_id, unnest(t) term, len(t) dl from (select doc_id, {_TOK.format("coalesce(text, '')")} t from docs)), st as (select count(*)::double n, avg(len({_TOK.format("coalesce(text, '')")})) a from docs),
    {terms}, tf as (select doc_id, term, count(*) tf, any_value(dl) dl from tok group by 1, 2){vocab}, df as (select term, count(*)::double df from {src} group by 1),
    sc as (select qid, doc_id, round(sum(w * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) score from qt join {src} using (term) join df using (term), st group by 1, 2)
    select qid, doc_id, score, cast(rank as bigint) as rank from (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from sc) where rank <= {k}"""


_QT = f"qt as (select qid, term, count(*) w from (select qid, unnest({_MATCH.format('question')}) term from qs) group by 1, 2)"


def _episode_docs(s, d):
    return ep(s, d).select(F.col("id").alias("doc_id"), F.col("content").alias("text"))


def _told_docs(s, d, name: str, text: str):
    """Texts of a table with their ids; rows that stand there twice are left to bm25, which counts ids."""
    return table(s, d, name).select(F.col("id").alias("doc_id"), F.col(text).alias("text"))


def _raw_terms(s, d, q: DataFrame | None = None):
    return lexical.terms_of(qs(s, d) if q is None else q, tx.match_tokens(F.col("question")))


@C.add("ret01_bm25_episodes", "with " + _bm25_sql("docs as (select id as doc_id, content as text from ep)", _QT), "ep qs")
def bm25_episodes(s, d):
    return lexical.bm25(_episode_docs(s, d), _raw_terms(s, d), 10)


@C.add("ret01_bm25_facts", "with " + _bm25_sql("docs as (select id as doc_id, statement as text from fa)", _QT), "fa qs")
def _(s, d):
    return lexical.bm25(fa(s, d).select(F.col("id").alias("doc_id"), F.col("statement").alias("text")), _raw_terms(s, d), 10)


_STEMS = f"""t0 as (select qid, list_filter({_TIDY.format('question')}, lambda w: length(w) > 1 and not list_contains({_STOP}, w)) l from qs), u0 as (select distinct qid, unnest(l) x from t0),
   qt as (select qid, term, count(*) w from (select qid, {_SUF.format('x')} term from u0) where length(term) >= 4 group by 1, 2)"""


def _content_terms(s, d, q: DataFrame | None = None) -> DataFrame:
    t = (qs(s, d) if q is None else q).select("qid", F.explode(tx.query_terms(F.col("question"))).alias("x")).filter(~F.array_contains(F.array(*[F.lit(w) for w in tx.STOPWORDS]), F.col("x")))
    return t.select("qid", tx.light_stem(F.col("x")).alias("term")).filter("length(term) >= 4").groupBy("qid", "term").agg(F.count("*").alias("weight"))


@C.add("ret02_bm25_prefix", "with " + _bm25_sql("docs as (select id as doc_id, statement as text from fa)", _STEMS, prefix=True), "fa qs")
def _(s, d):
    return lexical.bm25(fa(s, d).select(F.col("id").alias("doc_id"), F.col("statement").alias("text")), _content_terms(s, d), 10, prefix=True)


@C.add("ret03_key_index", "with " + _bm25_sql("docs as (select id as doc_id, array_to_string(search_keys, ' ') as text from (select distinct id, search_keys from facts) where len(search_keys) > 0)", _QT), "qs")
def _(s, d):
    keys = once(table(s, d, "facts").select("id", "search_keys").filter("size(search_keys) > 0"), "id").select(F.col("id").alias("doc_id"), F.array_join("search_keys", " ").alias("text"))
    return lexical.bm25(keys, _raw_terms(s, d), 10)


@C.add("agg05_corpus_statistics", f"with tok as (select id, unnest({_TOK.format('content')}) term from ep where content is not null) select term, count(distinct id) as df, count(*) as cf from tok group by term", "ep")
def _(s, d):
    post = lexical.postings(_episode_docs(s, d).filter("text is not null"))
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("bigint").alias("cf"))


# ---- vectors ----------------------------------------------------------------------------------

def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


_COS = "round(list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])) / (sqrt(list_dot_product(cast(a.embedding as double[]), cast(a.embedding as double[]))) * sqrt(list_dot_product(cast(b.embedding as double[]), cast(b.embedding as double[])))), 6)"
_VEC = f"select qid, id, score, cast(rank as bigint) as rank from (select a.vec_id qid, b.vec_id id, {_COS} score, row_number() over (partition by a.vec_id order by {_COS} desc, b.vec_id) as rank from embeddings a, embeddings b where a.vec_id % 20 = 0 and b.vec_id != a.vec_id) where rank <= 10"


def _vector_hits(s, d):
    v = _vectors(s, d)
    return vector.search(v, v.filter("id % 20 = 0").select(F.col("id").alias("qid"), "v"), 10)


@C.add("vec02_cosine_topk", _VEC)
def _(s, d):
    """Queries are the vectors whose id is divisible by 20, searched against all."""
    return _vector_hits(s, d)


@C.add("vec01_normalise", "select vec_id, round(list_sum(list_transform(cast(embedding as double[]), lambda x: x * x)), 6) as norm2, round(embedding[1]::double / sqrt(list_sum(list_transform(cast(embedding as double[]), lambda x: x * x))), 6) as first from embeddings")
def _(s, d):
    v = table(s, d, "embeddings")
    n = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return v.select("vec_id", F.round(n, 6).alias("norm2"), F.round(vector.unit(F.col("embedding"))[0], 6).alias("first"))


@C.add("vec03_all_scores", f"select b.vec_id as id, {_COS} as score from embeddings a, embeddings b where a.vec_id = 0")
def _(s, d):
    q = s.createDataFrame(_vectors(s, d).filter("id = 0").select("v").limit(1).collect(), "q array<float>")
    return _vectors(s, d).join(F.broadcast(q)).select("id", F.round(vector.cosine(F.col("q"), F.col("v")), 6).alias("score"))


@C.add("vec04_ngram_md5_embed", """with g as (select qid, substr(t, i, n) g from (select qid, lower(question) t, unnest([3, 4]) n from qs), lateral (select unnest(range(1, greatest(length(t) - n + 2, 1))) i) where length(t) >= n),
    c as (select qid as id, cast(('0x' || substr(md5(g), 1, 8)) as bigint) % 256 bucket, count(*) c from g group by 1, 2) select id, bucket, round(c / sqrt(sum(c * c) over (partition by id)), 6) as weight from c""", "qs")
def _(s, d):
    return vector.gram_buckets(qs(s, d).select(F.col("qid").alias("id"), F.col("question").alias("text")))


@C.add("vec09_guard", "select len(emb) as dim, count(*) as n from (select distinct id, emb from episodes) where emb is not null and not list_contains(list_transform(emb, lambda x: isfinite(x)), false) group by 1")
def _(s, d):
    e = once(table(s, d, "episodes").select("id", "emb"), "id").filter(F.col("emb").isNotNull() & F.forall("emb", lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return e.groupBy(F.size("emb").cast("bigint").alias("dim")).agg(F.count("*").alias("n"))


# ---- fusion -----------------------------------------------------------------------------------

EMBEDDER = plugins.HashEmbedder(256, "md5")  # the digest that SQL has as well


def semantic(s, d, k: int, docs: DataFrame | None = None, queries: DataFrame | None = None) -> DataFrame:
    """``qid, id, score, rank``: texts (``id, text``; all turns) nearest to each question (``qid, question``), both embedded from their own words."""
    docs = table(s, d, "episodes").select("id", F.col("content").alias("text")) if docs is None else docs
    return vector.search_texts(docs, qs(s, d) if queries is None else queries, EMBEDDER.counts, k)


def _unit_sql(name: str, rel: str, key: str, text: str) -> str:
    """SQL of ``key, bucket, w``: unit vectors of hashed character grams."""
    return f"""{name}g as (select k, substr(t, i, n) g from (select {key} k, lower(coalesce({text}, '')) t, unnest([3, 4]) n from {rel}), lateral (select unnest(range(1, greatest(length(t) - n + 2, 1))) i) where length(t) >= n),
    {name}c as (select k, cast(('0x' || substr(md5(g), 1, 8)) as bigint) % 256 bucket, count(*)::double c from {name}g group by 1, 2), {name} as (select k, bucket, c / sqrt(sum(c * c) over (partition by k)) w from {name}c)"""


def _semantic_sql(name: str, k: int, docs: str = "ep", key: str = "id", text: str = "content") -> str:
    """SQL of ``qid, id, score, rank`` of the semantic channel."""
    return f"""{_unit_sql(name + "q", "qs", "qid", "question")}, {_unit_sql(name + "e", docs, key, text)},
    {name}s as (select q.k qid, e.k id, round(sum(q.w * e.w), 6) score from {name}q q join {name}e e using (bucket) group by 1, 2),
    {name} as (select * from (select *, row_number() over (partition by qid order by score desc, id) as rank from {name}s where score > 0) where rank <= {k})"""


def _lexical(s, d, k: int, q: DataFrame | None = None) -> DataFrame:
    return lexical.bm25(_told_docs(s, d, "episodes", "content"), _content_terms(s, d, q).withColumnRenamed("term", "t").select("qid", F.col("t").alias("term"), "weight"), k, prefix=True).select("qid", F.col("doc_id").alias("id"), "score", "rank")


@C.add("ret04_semantic_search", f"with {_semantic_sql('sx', 20)} select qid, id, score, cast(rank as bigint) as rank from sx", "ep qs")
def _(s, d):
    """Turns nearest to each question by the vectors of their words."""
    return semantic(s, d, 20)


_LEX = _bm25_sql("docs as (select id as doc_id, content as text from ep)", _QT, 50)
_LEX_HEAD, _, _LEX_TAIL = _LEX.rpartition("\n    select ")
_LX = f"with {_LEX_HEAD}, lx as (select {_LEX_TAIL})"


def by_words(s, d, k: int = 50, q: DataFrame | None = None) -> DataFrame:
    """The lexical channel of turns."""
    return lexical.bm25(_told_docs(s, d, "episodes", "content"), _raw_terms(s, d, q), k).select("qid", F.lit("episode").alias("kind"), F.col("doc_id").alias("id"), "score", "rank")


def facts_by_words(s, d, k: int = 50, q: DataFrame | None = None) -> DataFrame:
    """The lexical channel of statements."""
    return lexical.bm25(_told_docs(s, d, "facts", "statement"), _raw_terms(s, d, q), k).select("qid", F.lit("fact").alias("kind"), F.col("doc_id").alias("id"), "score", "rank")


def by_letters(s, d, q: DataFrame | None = None) -> DataFrame:
    """The semantic channel of turns."""
    return semantic(s, d, 50, queries=q).select("qid", F.lit("episode").alias("kind"), "id", "score", "rank")


def _channels(s, d, q: DataFrame | None = None) -> dict[str, DataFrame]:
    return {"bm25": by_words(s, d, q=q), "key": facts_by_words(s, d, q=q), "vec": by_letters(s, d, q)}


_FX = f"""ftok as (select doc_id, unnest(t) term, len(t) dl from (select id doc_id, {_TOK.format("coalesce(statement, '')")} t from fa)), fst as (select count(*)::double n, avg(len({_TOK.format("coalesce(statement, '')")})) a from fa),
  ftf as (select doc_id, term, count(*) tf, any_value(dl) dl from ftok group by 1, 2), fdf as (select term, count(*)::double df from ftf group by 1),
  fsc as (select qid, doc_id, round(sum(w * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) score from qt join ftf using (term) join fdf using (term), fst group by 1, 2),
  fx as (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from fsc)"""

_RRF = f"""{_LX}, {_FX},
  {_semantic_sql("gx", 50)},
  ch as (select qid, 'episode' kind, doc_id id, 'bm25' ch, 0.9 / (60 + rank) p from lx union all select qid, 'fact', doc_id, 'key', 0.7 / (60 + rank) from fx where rank <= 50 union all select qid, 'episode', id, 'vec', 1.0 / (60 + rank) from gx)
  select qid, kind, id, round(sum(p), 9) as score, string_agg(ch, ',' order by ch) as channels from ch group by 1, 2, 3"""


@C.add("agg07_rrf_fusion", _RRF, "ep fa qs")
def _(s, d):
    """Weighted reciprocal ranks of the lexical channels of turns and facts and of the semantic channel of turns."""
    return fusion.reciprocal_ranks(_channels(s, d))


@C.add("agg08_convex_scores", f"""{_LX}, {_semantic_sql("v", 50)},
   a as (select qid, doc_id id, 0.5 * case when max(score) over (partition by qid) > 0 then score / max(score) over (partition by qid) else 1 end p from lx),
   b0 as (select *, max(score) over (partition by qid) hi, least(min(score) over (partition by qid), max(score) over (partition by qid) - 0.25) lo from v), b as (select qid, id, 0.5 * case when hi <= lo then 1 else (score - lo) / (hi - lo) end p from b0)
   select qid, id, round(sum(p), 6) as score from (select * from a union all select * from b) group by 1, 2""", "ep qs")
def _(s, d):
    q, names = alike(qs(s, d).select("qid", "question"), "question")
    return to_all(fusion.convex(by_words(s, d, q=q).select("qid", "id", "score"), by_letters(s, d, q).select("qid", "id", "score")), names)


@C.add("agg09_session_rollup", f"""{_LX} select qid, id, round(score + 0.25 * greatest(max(score) over (partition by qid, coalesce(session_id, '#' || id)), 0), 8) as score from (select lx.qid, lx.doc_id id, lx.score, ep.session_id from lx join ep on ep.id = lx.doc_id)""", "ep qs")
def _(s, d):
    lex = by_words(s, d).select("qid", "id", "score")
    return fusion.session_roll_up(lex.join(ep(s, d).select("id", "session_id"), "id")).select("qid", "id", "score")


@C.add("ret09_evidence_priors", f"""{_LX}, j as (select lx.qid, lx.doc_id id, lx.score, lower(trim(e.role)) in ('assistant', 'ai', 'bot') reply, {_intent('q.question', 'addresses_assistant')} ad, {_intent('q.question', 'asks_when')} wh, {_intent('e.content', 'dateish')} dt, e.session_id
    from lx join ep e on e.id = lx.doc_id join qs q using (qid)),
    p as (select qid, id, session_id, round((case when reply and not ad then score * 0.2 else score end) + case when wh and dt then 0.15 else 0 end, 8) score from j),
    r as (select qid, id, round(score + 0.25 * greatest(max(score) over (partition by qid, coalesce(session_id, '#' || id)), 0), 8) score from p)
    select qid, id, score, cast(row_number() over (partition by qid order by score desc, id) as bigint) as rank from r""", "ep qs")
def evidence_ranked(s, d, asked: DataFrame | None = None):
    """The evidence engine's priors and session roll-up over the lexical candidates."""
    asked = qs(s, d) if asked is None else asked
    lex = by_words(s, d, q=asked).select("qid", "id", "score")
    e = ep(s, d).select("id", "session_id", F.lower(F.trim("role")).isin("assistant", "ai", "bot").alias("reply"), tx.intent(F.col("content"), "dateish").alias("dateish"))
    q = asked.select("qid", tx.intent(F.col("question"), "addresses_assistant").alias("addressed"), tx.intent(F.col("question"), "asks_when").alias("asks_when"))
    j = lex.join(e, "id").join(q, "qid").withColumn("side", F.when(F.col("reply"), "reply").otherwise("user")).withColumn("in_window", F.lit(False)).withColumn("other_speaker", F.lit(False))
    r = fusion.session_roll_up(fusion.evidence_priors(j))
    return r.select("qid", "id", "score", fusion.by_rank().cast("bigint").alias("rank"))


@C.add("ret09_evidence_full")
def _(s, d):
    """Both channels (prefix BM25 and vectors, depth 200), convex fusion, priors with time windows, roll-up; rows only."""
    w = phrases.query_window_udf("question", tx.anchor_date(F.col("question_date")))
    asked, names = alike(qs(s, d).select("qid", "question", w.alias("w")), "question", "w")
    both = fusion.convex(_lexical(s, d, 200, asked).select("qid", "id", "score"), semantic(s, d, 200, queries=asked).select("qid", "id", "score"))
    e = ep(s, d).select("id", "session_id", F.lower(F.trim("role")).isin("assistant", "ai", "bot").alias("reply"), tx.intent(F.col("content"), "dateish").alias("dateish"), tx.anchor_date(F.col("ts")).alias("day"))
    q = asked.select("qid", tx.intent(F.col("question"), "addresses_assistant").alias("addressed"), tx.intent(F.col("question"), "asks_when").alias("asks_when"), "w")
    j = both.join(e, "id").join(q, "qid").withColumn("side", F.when(F.col("reply"), "reply").otherwise("user")).withColumn("in_window", F.coalesce(F.col("day").between(F.col("w.first"), F.col("w.last")), F.lit(False))).withColumn("other_speaker", F.lit(False))
    r = fusion.session_roll_up(fusion.evidence_priors(j))
    return to_all(r.select("qid", "id", "session_id", "score", fusion.by_rank().cast("bigint").alias("rank")).filter("rank <= 50"), names)


@C.add("ret13_head_rerank", f"""{_LX}, r as (select lx.qid, lx.doc_id id, lx.score, lx.rank, cast(len(list_intersect(string_split(lower(q.question), ' '), string_split(lower(e.content), ' '))) as double) o from lx join ep e on e.id = lx.doc_id join qs q using (qid)),
   b as (select qid, id, round(case when rank <= 20 then 0.5 * score / max(score) over (partition by qid) + 0.5 * o / 10 else -1.0 * rank end, 6) s from r)
   select qid, id, cast(row_number() over (partition by qid order by s desc, id) as bigint) place from b""", "ep qs")
def _(s, d):
    """The first 20 are reordered by a blend of the fused score and a word-overlap judge; the rest keep their order."""
    lex = by_words(s, d).select("qid", "id", "score", "rank")
    j = lex.join(ep(s, d).select("id", "content"), "id").join(qs(s, d).select("qid", "question"), "qid")
    judged = tx.overlap(F.col("question"), F.col("content"))
    top = F.max("score").over(Window.partitionBy("qid"))
    b = j.withColumn("s", F.round(F.when(F.col("rank") <= 20, 0.5 * F.col("score") / top + 0.5 * judged / 10).otherwise(-1.0 * F.col("rank")), 6))
    return b.select("qid", "id", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("s"), "id")).cast("bigint").alias("place"))


@C.add("ret15_router", f"""with v as (select distinct name from lk), q as (select qid, question from qs), k as (select q.qid, least(count(*), 10) n from q, v where len(list_distinct(regexp_extract_all(lower(v.name), '[a-z][a-z0-9''-]+'))) > 0
   and len(list_intersect(list_distinct(regexp_extract_all(lower(v.name), '[a-z][a-z0-9''-]+')), list_distinct(regexp_extract_all(lower(q.question), '[a-z][a-z0-9''-]+')))) = len(list_distinct(regexp_extract_all(lower(v.name), '[a-z][a-z0-9''-]+'))) group by 1)
   select q.qid, case when {_intent('q.question', 'aggregation')} then 'deep' when regexp_matches(q.question, '\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}') or regexp_matches(lower(q.question), '(january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)\\s+(\\d{{1,2}},?\\s+)?\\d{{4}}') or {_intent('q.question', 'temporal')} then 'timeline'
     when {_intent('q.question', 'relation')} or coalesce(k.n, 0) >= 2 then 'relations' else 'facts' end as profile from q left join k using (qid)""", "qs lk")
def _(s, d):
    q = qs(s, d).select("qid", "question")
    known = graph.contained(q, lk(s, d).select("name").distinct()).groupBy("qid").agg(F.count("*").alias("n"))
    return q.join(known, "qid", "left").select("qid", tx.route(F.col("question"), F.coalesce("n", F.lit(0))).alias("profile"))


@C.add("ret18_pack_context")
def _(s, d):
    """Fused turns and facts of each question packed into one text; rows only."""
    q, names = alike(qs(s, d).select("qid", "question"), "question")
    fused = fusion.reciprocal_ranks(_channels(s, d, q))
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "kind", "id"))).filter("rank <= 20")
    none = F.lit(None).cast("string")
    e = ep(s, d).select(F.lit("episode").alias("kind"), "id", F.col("content").alias("text"), "role", "ts", none.alias("scope"), none.alias("valid_from"), none.alias("invalid_at"))
    f = fa(s, d).select(F.lit("fact").alias("kind"), "id", F.col("statement").alias("text"), none.alias("role"), none.alias("ts"), "scope", "valid_from", "invalid_at")
    return to_all(packing.context(ranked.join(e.unionByName(f), ["kind", "id"])), names)


@C.add("ret19_pack_evidence")
def _(s, d):
    """Evidence packed greedily into 3,000 characters per question; rows only, the budget is tested."""
    r = evidence_ranked(s, d).join(ep(s, d).select("id", "session_id", "role", "ts", "content"), "id")
    return packing.evidence(r, qs(s, d).select("qid", "question"), packing.Budget(chars=3000))


@C.add("ret12_alternatives")
def _(s, d):
    """Sub-queries of 'A or B' questions answered apart and merged by best score; rows only."""
    q = qs(s, d).filter(F.lower("question").contains(" or ") & tx.intent(F.col("question"), "ordering"))
    parts = F.filter(F.transform(F.filter(F.split("question", "[,:?]"), lambda x: F.lower(x).rlike(r"\bor\b")), lambda x: F.split(x, r"(?i)\bor\b")), lambda x: F.size(x) > 1)
    sub = q.select("qid", F.posexplode(F.flatten(parts)).alias("n", "question")).withColumn("sub", F.concat("qid", F.lit("#"), "n"))
    terms = lexical.terms_of(sub.select(F.col("sub").alias("qid"), "question"), tx.query_terms(F.col("question")))
    hits = lexical.bm25(_episode_docs(s, d), terms, 20).withColumn("qid", F.substring_index("qid", "#", 1))
    return hits.groupBy("qid", "doc_id").agg(F.max("score").alias("score"))


@C.add("ret23_dense_baseline", _VEC.replace("rank <= 10", "rank <= 5"))
def _(s, d):
    return _vector_hits(s, d).filter("rank <= 5")


