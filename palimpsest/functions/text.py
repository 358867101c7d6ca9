"""Text functions as Column expressions: folding, tokens, stems, intents, redaction."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Accented Latin letters (U+00C0 to U+017F) and their base letters, by decomposition."""
    src, dst = [], []
    for cp in range(0xC0, 0x180):
        d = unicodedata.normalize("NFD", chr(cp))
        if len(d) > 1 and d[0].isascii() and d[0].isalpha():
            src.append(chr(cp).lower())
            dst.append(d[0].lower())
    both = dict(zip(src, dst))
    return "".join(both), "".join(both.values())


ACCENTED, PLAIN = _accents()

# Function words and filler of questions to a memory.
STOPWORDS = tuple("""
a about above after again against all am an and any are as at be because been
before being below between both but by can could did do does doing down during
each few for from further had has have having he her here hers herself him
himself his how i if in into is it its itself just me more most my myself no nor
not now of off on once only or other our ours ourselves out over own same she
should so some such than that the their theirs them themselves then there these
they this those through to too under until up very was we were what when where
which while who whom why will with would you your yours yourself yourselves
im ive id ill youre youve dont didnt doesnt isnt wasnt cant couldnt wont
also get got really thing things something anything much many one
remind recall remember previous previously earlier conversation chat talked
talk discussed mentioned tell told know wondering wonder asked ask
please thanks thank hey hi okay ok yes yeah sure like
""".split())
# Suffixes a light stem cuts, in this order.
SUFFIXES = ("ings", "ing", "edly", "ed", "ies", "es", "s")

# Shapes of secrets, replaced in this order.
SECRETS = (
    r"\bsk-[A-Za-z0-9_-]{16,}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{20,}\b",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    r"(?i)\bbearer\s+[A-Za-z0-9._~+/-]{16,}=*",
    r"(?i)\b(password|passwd|api[_-]?key|secret|token)\s*[:=]\s*\S{6,}",
)


def fold(c: Column) -> Column:
    """Lower case without Latin accents."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def index_tokens(c: Column) -> Column:
    """Tokens of the lexical index: runs of letters and digits of the folded text."""
    return F.regexp_extract_all(fold(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def match_tokens(c: Column, most: int = 32) -> Column:
    """Query tokens: words of more than one character, the first ``most``, duplicates kept."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.slice(F.filter(words, lambda w: F.length(w) > 1), 1, most)


def query_terms(c: Column) -> Column:
    """Content terms in order without repeats; all longer tokens if only stop words remain."""
    raw = F.regexp_extract_all(F.lower(c), F.lit(r"([A-Za-z0-9][A-Za-z0-9'_-]*|[\p{L}\p{N}_]+)"), F.lit(1))
    tidy = F.transform(raw, lambda w: F.regexp_replace(F.regexp_replace(w, r"^['_-]+|['_-]+$", ""), "'", ""))
    long = F.array_distinct(F.filter(tidy, lambda w: F.length(w) > 1))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    terms = F.filter(long, lambda w: ~F.array_contains(stop, w))
    return F.when(F.size(terms) > 0, terms).otherwise(long)


def light_stem(w: Column) -> Column:
    """Cut the first fitting suffix from words that stay longer than three letters."""
    out = F
    for k, s in enumerate(SUFFIXES):
        out = out.when(w.endswith(s) & (F.length(w) > len(s) + 3), F.substring(w, F.lit(1), F.length(w) - len(s)))
    return out.otherwise(w)


def redact_secrets(c: Column) -> Column:
    for p in SECRETS:
        c = F.regexp_replace(c, p, "[REDACTED]")
    return c


def clip(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(" ..."))).otherwise(c)


# Patterns of intents; case does not matter.
INTENTS = {
    "aggregation": r"\b(how many|how much|number of|count of|total|in total|combined|altogether|sum of|on average)\b|\bhow many different\b",
    "addresses_assistant": (
        r"\byou\s+(?:\w+\s+){0,3}?(?:said|told|mentioned|suggested|recommended|recommend|gave|give|provided|listed|shared|described|explained|wrote|write|created|"
        r"came up|named|called|proposed|offered|advised|helped|generated|drafted|showed|answered|responded|included)\b"
        r"|\byour\s+(?:suggestion|recommendation|advice|answer|response|list|explanation|previous|earlier|last|reply|idea|tip)s?\b"
        r"|\byou\s+(?:made|played|used|picked|chose)\b|\bremind me\b|\bwe\s+(?:talked|discussed|chatted|spoke|went over)\b"
        r"|\b(?:our|the)\s+(?:previous|last|earlier)\s+(?:\w+\s+)?(?:chat|conversation|discussion|game|session)\b"),
    "asks_when": r"^\s*(?:when\b|what (?:date|day|year|month|time)\b|which (?:date|day|year|month)\b)|\bhow long ago\b|\bhow many (?:days|weeks|months|years)\b",
    "ordering": r"\b(first|before|after|earlier|later|order|sooner|most recently)\b",
    "temporal": r"\b(when|before|after|since|until|during|first time|last time|previous|previously|earlier|ago|timeline|history of|back then|at the time|as of)\b",
    "relation": r"\b(who|whom|whose|related to|relationship|connected|connection|works? with|work at|colleague|friend of|married|partner|mentor|between|know each other|team|reports? to)\b",
    "dateish": (
        r"\b(?:19|20)\d{2}\b|\b(?:january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec)\b"
        r"|\b(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday|weekend|yesterday|tomorrow|tonight|today|ago|last (?:week|month|year|night))\b"),
}


def intent(c: Column, name: str) -> Column:
    return F.coalesce(F.lower(c).rlike(INTENTS[name]), F.lit(False))


def route(c: Column, known_entities: Column) -> Column:
    """Profile of a question: aggregation, then dates or tense, then relations or two known entities, else facts."""
    dated = F.size(dates_in(c)) > 0
    return (F.when(intent(c, "aggregation"), "deep").when(dated | intent(c, "temporal"), "timeline")
            .when(intent(c, "relation") | (known_entities >= 2), "relations").otherwise("facts"))


def speaker(role: Column, content: Column) -> Column:
    """A role that is a name, else the name before a leading colon, else empty."""
    generic = F.lower(F.trim(role)).isin("user", "assistant", "system", "tool", "human", "ai", "bot")
    said = F.regexp_extract(content, r"^\s*([A-Z][\w'.-]{0,30}(?: [A-Z][\w'.-]{0,30}){0,2}):\s", 1)
    return F.when(role.isNotNull() & ~generic, F.lower(F.trim(role))).otherwise(F.lower(F.coalesce(said, F.lit(""))))


def overlap(a: Column, b: Column) -> Column:
    """Number of distinct space-separated words two texts share."""
    return F.size(F.array_intersect(F.split(F.lower(a), " "), F.split(F.lower(b), " ")))


_MONTH_NAMES = "January February March April May June July August September October November December".split()


def _month(c: Column) -> Column:
    """Number of a month's name or its first three letters, else null."""
    out = F
    for k, m in enumerate(_MONTH_NAMES):
        out = out.when(F.lower(c).isin(m.lower(), m[:3].lower()), F.lit(k + 1))
    return out


def dates_in(c: Column) -> Column:
    """Explicit dates of a text as ISO strings, by form and then place, without repeats.

    Forms: year-month-day in numbers (not checked), day month year, month day year,
    and month year, which stands for the 15th.
    """
    text = F.coalesce(c, F.lit(""))

    def each(pattern: str, groups: int, build) -> Column:
        got = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in range(1, groups + 1)]
        return F.transform(F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(got)]), build)

    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    iso = lambda y, m, d: F.concat(y, F.lit("-"), two(m), F.lit("-"), d)
    found = F.concat(
        each(r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})", 3, lambda x: iso(x["g0"], x["g1"], two(x["g2"]))),
        each(r"(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})", 3, lambda x: iso(x["g2"], _month(x["g1"]), two(x["g0"]))),
        each(r"([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})", 3, lambda x: iso(x["g2"], _month(x["g0"]), two(x["g1"]))),
        each(r"([A-Za-z]+)\s+(\d{4})", 2, lambda x: iso(x["g1"], _month(x["g0"]), F.lit("15"))),
    )
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def anchor_date(c: Column) -> Column:
    """The day a time text starts with, null if it names none."""
    day = F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*(\d{4})[-/](\d{1,2})[-/](\d{1,2})", 0)
    y, m, d = (F.regexp_extract(day, r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})", k) for k in (1, 2, 3))
    return F.when(day != "", F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"))).try_cast("date")


def content_words(c: Column) -> Column:
    """Number of words longer than two letters that are no stop words, after a speaker's name."""
    body = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s*[A-Z][\w'.-]{0,30}(?: [A-Z][\w'.-]{0,30}){0,2}:\s", "")
    words = F.regexp_extract_all(F.lower(body), F.lit(r"([A-Za-z0-9][A-Za-z0-9'_-]*|[\p{L}\p{N}_]+)"), F.lit(1))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.size(F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)))


def stamp(c: Column) -> Column:
    """``yyyy-MM-dd Ddd`` of a time text, ``undated`` without one."""
    return F.coalesce(F.date_format(anchor_date(c), "yyyy-MM-dd EEE"), F.lit("undated"))
