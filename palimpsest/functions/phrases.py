"""Relative time phrases: finding them, resolving them to dates, writing the dates in.

A phrase names a step along a numbered line of periods: the line of days, of
weeks, of Fridays, of winters.  A line numbers the period that a day belongs to
and gives the dates of a numbered period; "two weeks ago" is two back on the line
of weeks, "last winter" is the latest winter that is over.  The words of the
phrases stand in tables, from which one pattern is built; it reads a text once,
so the phrase that begins first wins. "earlier this week" is therefore read as
"this week", the whole of it.  Ambiguous forms without a cue of tense are not
resolved.  The column expressions at the end do the same for one phrase inside
the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Number words, days, months, seasons with their first month, and days named by their distance from today.
NUMBERS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
           "a couple of": 2, "couple of": 2, "a couple": 2}
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SEASONS = {"spring": 3, "summer": 6, "fall": 9, "autumn": 9, "winter": 12}
DISTANCES = {"the day before yesterday": -2, "the day after tomorrow": 2, "yesterday": -1, "last night": -1, "tomorrow": 1,
             "today": 0, "tonight": 0, "this morning": 0, "this afternoon": 0, "this evening": 0, "earlier today": 0}
SIDES = {"last": "over", "this past": "over", "this": "own", "this coming": "own", "next": "ahead"}
MOST = 400  # larger counts are no phrase
# Days that a counted unit of "the past N units" reaches back.
REACH = {"day": 1, "week": 7, "month": 31, "year": 366}

Range = tuple[date, date]


@dataclass(frozen=True)
class Line:
    """A line of periods: the number of a day's period, and the dates of a numbered period."""

    gran: str
    number: Callable[[date], int]
    dates: Callable[[int], Range]

    def over(self, day: date) -> int:
        """The latest period that is over."""
        return next(i for i in range(self.number(day), self.number(day) - 4, -1) if self.dates(i)[1] < day)

    def ahead(self, day: date) -> int:
        """The earliest period that has not begun."""
        return next(i for i in range(self.number(day), self.number(day) + 4) if self.dates(i)[0] > day)

    def own(self, day: date) -> int:
        """The period around the day, or else that of its year or week."""
        here = self.number(day)
        return here if self.gran != "season" or self.dates(here)[1] >= day else day.year


def _months(first: int, n: int = 1) -> Range:
    """The dates of n months from a month counted from year 0."""
    of = lambda k: date(k // 12, k % 12 + 1, 1)
    return of(first), of(first + n) - timedelta(days=1)


def _weekly(gran: str, first: int, last: int) -> Line:
    """One run of days in each week, counted from Monday as 0."""
    return Line(gran, lambda d: (d.toordinal() - 1) // 7, lambda i: (date.fromordinal(7 * i + first + 1), date.fromordinal(7 * i + last + 1)))


def _season(month: int) -> Line:
    return Line("season", lambda d: d.year - (d.month < month), lambda y: _months(12 * y + month - 1, 3))


UNITS = {
    "day": Line("day", date.toordinal, lambda i: (date.fromordinal(i),) * 2),
    "week": _weekly("week", 0, 6),
    "month": Line("month", lambda d: 12 * d.year + d.month - 1, _months),
    "year": Line("year", lambda d: d.year, lambda y: _months(12 * y, 12)),
    "weekend": _weekly("weekend", 5, 6),
}
NAMED = {
    **{unit: UNITS[unit] for unit in ("week", "month", "year", "weekend")}, **{name: _weekly("day", k, k) for k, name in enumerate(DAYS)},
    **{name: _season(month) for name, month in SEASONS.items()},
}


def _any(words) -> str:
    return "|".join(r"\s+".join(w.split()) if w in SIDES else w for w in sorted(words, key=len, reverse=True))


_N = rf"\d{{1,3}}|{_any(NUMBERS)}"
PHRASE = re.compile(
    rf"\b(?:(?P<distance>{_any(DISTANCES)})|(?P<ago>{_N})\s+(?P<back>{_any(UNITS)})s?\s+ago|in\s+(?P<ahead>{_N})\s+(?P<on>{_any(UNITS.keys() - {'weekend'})})s?\b(?!\s+ago)"
    rf"|(?P<side>{_any(SIDES)})\s+(?P<name>{_any(NAMED)}))\b", re.IGNORECASE)
CUE = re.compile(r"yesterday|today|tonight|tomorrow|ago|last|next|this|\bin\s", re.IGNORECASE)


def _count(text: str) -> int | None:
    n = int(text) if text.isdigit() else NUMBERS[text]
    return n if 0 < n <= MOST else None


def _resolve(words: dict[str, str], day: date) -> tuple[date, date, str] | None:
    """The dates and the granularity that the words of a phrase mean on a day."""
    if "distance" in words:
        line, at = UNITS["day"], day.toordinal() + DISTANCES[words["distance"]]
    elif "side" in words:
        line, side = NAMED[words["name"]], " ".join(words["side"].split())
        if side == "this coming" and line.gran != "weekend":
            return None
        at = line.number(day) + 1 if line.gran == "weekend" and side == "next" else getattr(line, SIDES[side])(day)
    else:
        n = _count(words.get("ago") or words["ahead"])
        if n is None:
            return None
        line = UNITS[words.get("back") or words["on"]]
        if line.gran == "weekend":  # counted by the Saturdays before the day
            at = (day.toordinal() - 7) // 7 - (n - 1)
        else:
            at = line.number(day) + (-n if "ago" in words else n)
    return *line.dates(at), line.gran


def mentions(text: str | None, anchor: date | None) -> list[tuple[int, int, date, date, str]]:
    """(start, end, first, last, granularity) of the phrases of a text, by place."""
    if not text or anchor is None or not CUE.search(text):
        return []
    out = []
    for m in PHRASE.finditer(text):
        try:
            got = _resolve({k: v.lower() for k, v in m.groupdict().items() if v}, anchor)
        except (ValueError, OverflowError):  # before the year 1 or after 9999
            continue
        if got:
            out.append((*m.span(), *got))
    return out


def label(first: date, last: date, gran: str) -> str:
    """A short absolute form of a range."""
    shown = {"day": 10, "month": 7, "year": 4}.get(gran)
    return first.isoformat()[:shown] if shown else f"{first}..{last}"


def annotate(text: str | None, anchor: date | None, most: int = 6) -> str | None:
    """The text with ``[date]`` after each resolved phrase."""
    found = mentions(text, anchor)[:most]
    if not found:
        return text
    ends = [0, *(m[1] for m in found)]
    return "".join(f"{text[a:b]} [{label(*m[2:])}]" for a, b, m in zip(ends, ends[1:], found)) + text[ends[-1]:]


# Written dates: a day with its year in three orders, a month with its year, a month alone.
_ORD = r"(?P<d>\d{1,2})(?:st|nd|rd|th)?"
_FULL = rf"(?P<m>{'|'.join(MONTHS)})"
_DAY_FORMS = [re.compile(rf"\b{p}\b", re.IGNORECASE) for p in (r"(?P<y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2})", rf"{_ORD}\s+{_FULL}\s*,?\s*(?P<y>\d{{4}})", rf"{_FULL}\s+{_ORD}\s*,?\s*(?P<y>\d{{4}})")]
_SHORT = sorted({*MONTHS, *(m[:3] for m in MONTHS), "sept"}, key=len, reverse=True)
_MONTH_FORM = re.compile(rf"\b(?P<m>{'|'.join(_SHORT)})\.?\s+(?P<y>\d{{4}})\b", re.IGNORECASE)
_MONTH_ALONE = re.compile(rf"\b(?:in|during|since|back in)\s+{_FULL}\b(?!\s+\d)", re.IGNORECASE)
_SPAN_BACK = re.compile(rf"\b(?:past|last)\s+(?P<n>{_N})\s+(?P<unit>{'|'.join(REACH)})s\b", re.IGNORECASE)


def _month(text: str) -> int:
    return int(text) if text.isdigit() else 1 + [m[:3] for m in MONTHS].index(text.lower()[:3])


def _readings(query: str, now: date | None) -> Iterator[Range | None]:
    """What a question's dates could be, the more explicit forms first."""
    written = min((m for p in _DAY_FORMS if (m := p.search(query))), key=lambda m: m.start(), default=None)
    if written:
        try:
            yield (date(int(written["y"]), _month(written["m"]), int(written["d"])),) * 2
        except ValueError:
            pass
    if m := _MONTH_FORM.search(query):
        yield _months(12 * int(m["y"]) + _month(m["m"]) - 1)
    if now is None:
        return
    if (m := _SPAN_BACK.search(query)) and (n := _count(m["n"].lower())):
        yield now - timedelta(days=n * REACH[m["unit"].lower()]), now
    yield from (m[2:4] for m in mentions(query, now))
    if m := _MONTH_ALONE.search(query):
        k = _month(m["m"])
        yield _months(12 * (now.year - (k > now.month)) + k - 1)


def query_window(query: str | None, now: date | None) -> Range | None:
    """The dates a question is about: a day, a month, the past N units, a phrase, or the last such month."""
    return next(_readings(query, now), None) if query else None


_RANGE = [T.StructField("first", T.DateType()), T.StructField("last", T.DateType())]
MENTIONS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), *_RANGE, T.StructField("gran", T.StringType())]))


@F.pandas_udf(MENTIONS)
def mentions_udf(text: pd.Series, anchor: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("start", "end", "first", "last", "gran"), m)) for m in mentions(t, a)] for t, a in zip(text, anchor)])


@F.pandas_udf(T.StringType())
def annotate_udf(text: pd.Series, anchor: pd.Series) -> pd.Series:
    return pd.Series([annotate(t, a) for t, a in zip(text, anchor)])


@F.pandas_udf(T.StructType(_RANGE))
def query_window_udf(text: pd.Series, now: pd.Series) -> pd.DataFrame:
    got = [query_window(t, n) or (None, None) for t, n in zip(text, now)]
    return pd.DataFrame(got, columns=["first", "last"], dtype=object)


def ago(anchor: Column, n: Column, unit: Column) -> Column:
    """Struct (first, last) of ``n unit ago``, in the JVM."""
    week = F.trunc(F.date_sub(anchor, (n * 7).cast("int")), "week")
    month = F.trunc(F.add_months(anchor, (-n).cast("int")), "month")
    year = F.year(anchor) - n
    first = F.when(unit == "day", F.date_sub(anchor, n.cast("int"))).when(unit == "week", week).when(unit == "month", month).when(unit == "year", F.make_date(year, F.lit(1), F.lit(1)))
    last = F.when(unit == "day", F.date_sub(anchor, n.cast("int"))).when(unit == "week", F.date_add(week, 6)).when(unit == "month", F.last_day(month)).when(unit == "year", F.make_date(year, F.lit(12), F.lit(31)))
    return F.struct(first.alias("first"), last.alias("last"))


def number_word(c: Column) -> Column:
    """Digits 1 to 400 or a number word, else null."""
    out = F.when(c.rlike(r"^\d{1,3}$"), F.when(c.cast("int").between(1, 400), c.cast("int")))
    for w, n in NUMBERS.items():
        out = out.when(F.lower(c) == w, F.lit(n))
    return out
