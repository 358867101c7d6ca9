"""Times written in many forms, brought to one unambiguous form.

Each value yields the array of all its valid readings: one per order of day
and month, and one per side of a repeated local hour.  Every reading carries a
cost.  Against a declared order, and for the later side of a repeated hour, it
is DECLARED; an order of ``any`` declares nothing, and both readings cost the
same.  A Viterbi pass over the record order of each source picks one reading per
value, adding a penalty where the written form changes between neighbours and
where time runs backwards.  A null order is read as day first, as the tables say.

A reading that costs more than the cheapest by over what both its neighbours can
weigh (SLACK) can stand on no cheapest path and does not enter the pass; so where
an order is declared, the declaration decides, and where none is, the path does.

Scale: values are parsed once, and plain ISO forms in the JVM. The chain of a
source breaks exactly at every value with one reading left. Sources are cut into
blocks of record numbers; within a block all values between the first and the
last such anchor are settled at once. Of the rows beyond those anchors each block
gives the cheapest costs between the readings at its ends; a pass over these, one row per
block, picks the ends, and then the blocks settle their rows. No task
holds more than one block of a source.

Nulls, blanks and unreadable values have no reading and break no chain: they
pass through with ``n_readings`` 0 and null results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.session import materialise

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
DECLARED = 50.0  # cost of the order that was not declared, and of the later side of a repeated hour
SWITCH, BACKWARD = 1.0, 1.0
SLACK = 2 * (SWITCH + BACKWARD)
BLOCK = 65_536
ANY = "any"  # the order of a source that declares none

# English month names and their usual short forms.
MONTHS = {m: k + 1 for k, names in enumerate((
    ("january", "jan"), ("february", "feb"), ("march", "mar"), ("april", "apr"), ("may",), ("june", "jun"), ("july", "jul"),
    ("august", "aug"), ("september", "sep", "sept"), ("october", "oct"), ("november", "nov"), ("december", "dec"))) for m in names}
# Zone abbreviations (minutes from UTC) for sessions whose zone never uses them.
ABBREVIATIONS = {
    "utc": 0, "gmt": 0, "z": 0, "ut": 0, "wet": 0, "bst": 60, "west": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180,
    "ist": 330, "npt": 345, "jst": 540, "kst": 540, "aest": 600, "aedt": 660, "acst": 570, "awst": 480, "nzst": 720, "nzdt": 780,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "brt": -180, "art": -180,
}

_TIME = r"(?P<h>\d{1,2})(?::(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,12}))?)?)?(?:\s*(?P<ap>[ap])\.?m\.?)?(?:\s*(?P<z>z|utc[+-]\d{1,2}(?::?\d{2})?|gmt[+-]\d{1,2}(?::?\d{2})?|[+-]\d{2}(?::?\d{2}){0,2}|(?!on\b|at\b)[a-z]{2,5}))?(?:\s*[\[(](?P<r>[^\])]+)[\])])?"
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_MONTH = r"(?P<mon>[a-z]{3,9})\.?"
_DAY = r"(?P<d>\d{1,2})(?:st|nd|rd|th)?"
FORMS = [(name, re.compile(p)) for name, p in (
    ("iso", rf"(?P<y>\d{{4}})-(?P<m>\d{{1,2}})-(?P<d>\d{{1,2}})(?:(?:\s*t\s*|\s+){_TIME})?"),
    ("slash", rf"(?P<y>\d{{4}})[/.](?P<m>\d{{1,2}})[/.](?P<d>\d{{1,2}})(?:\s*\([a-z]+\))?(?:(?:\s*t\s*|,?\s+){_TIME})?"),
    ("epoch", r"(?P<e>[+-]?\d{9,10}(?:\.\d+)?|\d{12,13}|\d{15,16}|\d{18,19})"),
    ("numeric", rf"(?P<a>\d{{1,2}})(?P<sep>[/.-])(?P<b>\d{{1,2}})(?P=sep)(?P<y>\d{{4}})(?:(?:,?\s+){_TIME})?"),
    ("basic", r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?:[t ]?(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?:[.,](?P<f>\d+))?\s*(?P<z>z|[+-]\d{2}:?\d{2})?)?"),
    ("month-first", rf"{_WEEKDAY}{_MONTH}\s+{_DAY}(?:,\s*|\s+)(?P<y>\d{{4}})(?:(?:,?\s+(?:at\s+)?){_TIME})?"),
    ("day-first", rf"{_WEEKDAY}{_DAY}(?:\s+|-|\s+of\s+){_MONTH}(?:,\s*|\s+|-)(?P<y>\d{{4}})(?:(?:,?\s+(?:at\s+)?){_TIME})?"),
    ("time-day", rf"{_TIME}(?:\s+on|,)?\s+{_WEEKDAY}{_DAY}\s+{_MONTH}(?:,\s*|\s+)(?P<y>\d{{4}})"),
    ("time-month", rf"{_TIME}(?:\s+on|,)?\s+{_WEEKDAY}{_MONTH}\s+{_DAY}(?:,\s*|\s+)(?P<y>\d{{4}})"),
    ("ctime", rf"(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\s+{_MONTH}\s+{_DAY}\s+(?P<h>\d{{1,2}}):(?P<mi>\d{{2}}):(?P<s>\d{{2}})(?:\s+(?P<z>[a-z]{{2,5}}|[+-]\d{{4}}))?\s+(?P<y>\d{{4}})"),
)]
FORM_ID = {name: k for k, (name, _) in enumerate(FORMS)}
EXACT = re.compile(r"\d{4}-\d\d-\d\d(T\d\d:\d\d:\d\dZ)?")

READING = T.StructType([
    T.StructField("us", T.LongType()), T.StructField("dated", T.BooleanType()),
    T.StructField("form", T.IntegerType()), T.StructField("cost", T.DoubleType()),
])
READINGS = T.ArrayType(READING)


@lru_cache(maxsize=4096)
def _zone(name: str | None) -> ZoneInfo:
    try:
        return ZoneInfo(name) if name else ZoneInfo("UTC")
    except Exception:  # noqa: BLE001  an unknown zone name reads as none
        return ZoneInfo("UTC")


@lru_cache(maxsize=65_536)
def _abbreviated(abbr: str, tz: str | None, year: int) -> int | None:
    """Seconds from UTC that an abbreviation means in a zone, in or near a year."""
    zone = _zone(tz)
    for y in (year, year - 1, year + 1):
        for month in range(1, 13):
            at = datetime(max(2, min(9998, y)), month, 15, tzinfo=zone)
            if (at.tzname() or "").lower() == abbr:
                return int(at.utcoffset().total_seconds())
    return ABBREVIATIONS[abbr] * 60 if abbr in ABBREVIATIONS else None


def _micros(t: datetime) -> int:
    d = t - EPOCH
    return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds


def _local(naive: datetime, tz: str | None) -> list[tuple[int, float]]:
    """Instants of a local time: a skipped one moves on by the gap, a repeated one has two."""
    zone = _zone(tz)
    first, second = naive.replace(tzinfo=zone), naive.replace(tzinfo=zone, fold=1)
    a, b = first.utcoffset(), second.utcoffset()
    base = _micros(naive.replace(tzinfo=UTC))
    us = base - int(a.total_seconds()) * 1_000_000
    if a > b:  # repeated: the first side has the larger offset
        return [(us, 0.0), (base - int(b.total_seconds()) * 1_000_000, DECLARED)]
    return [(us, 0.0)]  # in a gap the offset before it moves the time on by the gap


def _offset(z: str) -> int | None:
    m = re.fullmatch(r"(?:utc|gmt)?([+-])(\d{1,2})(?::?(\d{2}))?(?::?(\d{2}))?", z)
    if not m:
        return None
    h, mi, s = int(m[2]), int(m[3] or 0), int(m[4] or 0)
    return None if h > 18 or mi > 59 else (h * 3600 + mi * 60 + s) * (1 if m[1] == "+" else -1)


def readings(value: str | None, tz: str | None = None, order: str | None = None) -> list[tuple[int, bool, int, float]]:
    """All valid readings of a value as (microseconds, is a date, form, cost), cheapest first."""
    if value is None:
        return []
    s = " ".join(value.lower().split())
    if not s or not any(c.isdigit() for c in s):
        return []
    for name, pattern in FORMS:
        m = pattern.fullmatch(s)
        if m:
            out = _read(name, m.groupdict(), tz, order)
            if out:
                return sorted(out, key=lambda r: (r[3], r[0]))
    return []


def _read(name: str, g: dict, tz: str | None, order: str | None) -> list[tuple[int, bool, int, float]]:
    form = FORM_ID[name] * 4
    if name == "epoch":
        whole, _, frac = g["e"].partition(".")
        n = len(whole.lstrip("+-"))
        scale = 1_000_000 if n <= 10 else 1_000 if n <= 13 else 1
        us = int(whole) // 1000 if n >= 18 else int(whole) * scale + (int((frac + "000000")[:6]) if frac else 0)
        return [(us, False, form, 0.0)]
    if name == "numeric":
        a, b = int(g["a"]), int(g["b"])
        said = (order or "dmy").strip().lower()
        days = [(a, b, 1, DECLARED if said == "mdy" else 0.0), (b, a, 2, 0.0 if said in ("mdy", ANY) else DECLARED)]
        if a == b:
            days = [x for x in days if x[3] == 0.0][:1]
    else:
        month = MONTHS.get(g["mon"]) if g.get("mon") else int(g["m"])
        if month is None:
            return []
        days = [(int(g["d"]), month, 0, 0.0)]
    out = []
    for day, month, variant, cost in days:
        try:
            date = datetime(int(g["y"]), month, day)
        except ValueError:
            continue
        if g.get("h") is None:
            out.append((_micros(date.replace(tzinfo=UTC)), True, form + variant, cost))
            continue
        h, mi, sec = int(g["h"]), int(g.get("mi") or 0), int(g.get("s") or 0)
        if g.get("mi") is None and not g.get("ap"):
            continue
        if g.get("ap"):
            if not 1 <= h <= 12:
                continue
            h = h % 12 + (12 if g["ap"] == "p" else 0)
        if h > 23 or mi > 59 or sec > 59:
            continue
        micro = int((g.get("f") or "0").ljust(6, "0")[:6])
        at = date + timedelta(hours=h, minutes=mi, seconds=sec, microseconds=micro)
        z = g.get("z")
        if z is None:
            region = g.get("r")
            out += [(us, False, form + variant, cost + extra) for us, extra in _local(at, region_name(region) or tz)]
            continue
        off = 0 if z == "z" else _offset(z)
        if off is None:
            off = _abbreviated(z, tz, at.year)
        if off is not None:
            out.append((_micros(at.replace(tzinfo=UTC)) - off * 1_000_000, False, form + variant, cost))
    return out


def region_name(r: str | None) -> str | None:
    """A bracketed zone name in its usual case, or null."""
    return "/".join("_".join(w.capitalize() for w in p.split("_")) for p in r.split("/")) if r and "/" in r else None


@F.pandas_udf(READINGS)
def readings_udf(value: pd.Series, tz: pd.Series, order: pd.Series) -> pd.Series:
    return pd.Series([readings(v, z, o) for v, z, o in zip(value, tz, order)])


@F.pandas_udf(T.LongType())
def instant_udf(value: pd.Series, tz: pd.Series, order: pd.Series) -> pd.Series:
    """The reading that follows the declarations, as microseconds; null if there is none."""
    return pd.Series([declared_instant(v, z, o) for v, z, o in zip(value, tz, order)], dtype="Int64")


def _plain(value: Column) -> Column:
    """Microseconds of a full ISO form with its zone, else null."""
    return F.when(value.rlike(r"^\d{4}-\d\d-\d\dT([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,6})?(Z|[+-]\d\d:\d\d)$"), F.unix_micros(value.try_cast("timestamp")))


def instant(value: Column, tz: Column, order: Column) -> Column:
    """As ``instant_udf``; plain ISO forms stay in the JVM."""
    plain = _plain(value)
    return F.coalesce(plain, instant_udf(F.when(plain.isNull(), value), tz, order))


def all_readings(value: Column, tz: Column, order: Column) -> Column:
    """As ``readings_udf``; plain ISO forms stay in the JVM."""
    plain = _plain(value)
    one = F.array(F.struct(plain.alias("us"), F.lit(False).alias("dated"), F.lit(FORM_ID["iso"] * 4).alias("form"), F.lit(0.0).alias("cost")))
    return F.when(plain.isNotNull(), one).otherwise(readings_udf(F.when(plain.isNull(), value), tz, order))


def declared_instant(value: str | None, tz: str | None = None, order: str | None = None) -> int | None:
    got = readings(value, tz, order)
    return got[0][0] if got and got[0][3] < DECLARED else None


def transition(a: tuple, b: tuple) -> float:
    """Penalty between the readings of neighbours, each (us, dated, form, cost)."""
    return SWITCH * (a[2] != b[2]) + BACKWARD * (b[0] < a[0])


def viterbi(chain: list[list[tuple]], first: int | None = None, last: int | None = None) -> list[int]:
    """Cheapest path through the readings of a chain, from and to a given reading if wanted; ties go to the earlier reading in the array."""
    if not chain:
        return []
    cost, back = [r[3] if first is None or j == first else float("inf") for j, r in enumerate(chain[0])], []
    for k in range(1, len(chain)):
        now, links = [], []
        for r in chain[k]:
            best = min(range(len(cost)), key=lambda j: (cost[j] + transition(chain[k - 1][j], r), j))
            now.append(cost[best] + transition(chain[k - 1][best], r) + r[3])
            links.append(best)
        cost = now
        back.append(links)
    at = min(range(len(cost)), key=lambda j: (cost[j], j)) if last is None else last
    path = [at]
    for links in reversed(back):
        at = links[at]
        path.append(at)
    return path[::-1]


def between(chain: list[list[tuple]]) -> list[list[float]]:
    """The cheapest costs from each reading of a chain's first value to each of its last."""
    out = [[r[3] if i == j else float("inf") for j, r in enumerate(chain[0])] for i in range(len(chain[0]))]
    for a, b in zip(chain, chain[1:]):
        step = [[transition(x, y) + y[3] for y in b] for x in a]
        out = [[min(row[i] + step[i][j] for i in range(len(a))) for j in range(len(b))] for row in out]
    return out


def eligible(rs: list[tuple]) -> list[int]:
    """Places of the readings that may stand on a cheapest path."""
    least = min(r[3] for r in rs)
    return [k for k, r in enumerate(rs) if r[3] <= least + SLACK]


KEY = ["field", "source", "block"]
SETTLED = T.StructType([
    T.StructField("field", T.StringType()), T.StructField("source", T.StringType()), T.StructField("block", T.LongType()),
    T.StructField("ord", T.LongType()), T.StructField("row_id", T.StringType()), T.StructField("value", T.StringType()),
    T.StructField("readings", READINGS), T.StructField("chosen", T.IntegerType()), T.StructField("state", T.IntegerType()),
])
INNER, EDGE, BORDER = 0, 1, 2  # settled; settled and an end of its block, on which other blocks depend; not settled
ROW = SETTLED.names[:7]


def _tuples(rs) -> list[tuple]:
    return [(r["us"], r["dated"], r["form"], r["cost"]) if isinstance(r, dict) else tuple(r) for r in rs]


class _Block:
    """Rows of one block of a source, settled run by run.

    Values with a choice between two anchors (values with one eligible reading)
    are settled at once. Those before the first anchor and behind the last one depend on
    other blocks: they come out unsettled, marked as border, with that anchor as context.
    """

    def __init__(self):
        self.out: list[tuple] = []
        self._clear()

    def _clear(self) -> None:
        self.anchor, self.run = None, []  # (row, readings, place, state), the row None if it went out as border; rows with a choice behind it

    def add(self, row: tuple, rs: list[tuple]) -> None:
        may = eligible(rs)
        if len(may) > 1:
            self.run.append((row, rs, may))
            return
        state = INNER
        if self.anchor is None:
            state = EDGE
            if self.run:
                self.out += [(*r, None, BORDER) for r, _, _ in self.run] + [(*row, None, BORDER)]
                row = None
        else:
            old, before, at, was = self.anchor
            if old is not None:
                self.out.append((*old, at, was))
            path = viterbi([[before[at]], *([x[k] for k in m] for _, x, m in self.run), [rs[may[0]]]])
            self.out += [(*r, m[k], INNER) for (r, _, m), k in zip(self.run, path[1:])]
        self.anchor, self.run = (row, rs, may[0], state), []

    def end(self) -> list[tuple]:
        if self.anchor is not None and self.anchor[0] is not None:
            row, _, at, _ = self.anchor
            self.out.append((*row, None, BORDER) if self.run else (*row, at, EDGE))
        self.out += [(*r, None, BORDER) for r, _, _ in self.run]
        self._clear()
        return self.taken()

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _grouped(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[tuple]:
    """(key, row) of all batches in their order; a last (None, None) ends them."""
    for pdf in batches:
        names = list(pdf.columns)
        at = [names.index(k) for k in key]
        for row in pdf.itertuples(index=False, name=None):
            yield tuple(row[k] for k in at), row
    yield None, None


def _inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    block, now, done = _Block(), None, []
    for key, row in _grouped((pdf[ROW] for pdf in batches), KEY):
        if key != now:
            done += block.end()
            now = key
        if len(done) > 20_000 or (key is None and done):
            yield pd.DataFrame(done, columns=SETTLED.names)
            done = []
        if key is None:
            return
        rs = _tuples(row[6])
        if row[1] is None or not rs:  # stands alone
            done.append((*row[:6], rs, 0, INNER))
        else:
            block.add((*row[:6], rs), rs)
            done += block.taken()


ENDS = "field string, source string, block bigint, head array<struct<us:bigint,dated:boolean,form:int,cost:double>>, tail array<struct<us:bigint,dated:boolean,form:int,cost:double>>, costs array<array<double>>"


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each block the readings at its ends and the costs between them."""
    chain, now, out = [], None, []
    for key, row in _grouped((pdf[ROW] for pdf in batches), KEY):
        if key != now and chain:
            out.append((*now, chain[0], chain[-1], between(chain)))
            chain = []
        now = key
        if key is None:
            break
        rs = _tuples(row[6])
        chain.append([rs[k] for k in eligible(rs)])
    if out:
        yield pd.DataFrame(out, columns=["field", "source", "block", "head", "tail", "costs"])


def _pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each block of a source the readings at its ends that the cheapest path takes."""
    blocks, now, out = [], None, []
    for key, row in _grouped(batches, ["field", "source"]):
        if key != now and blocks:
            best, froms = [min(row[j] for row in blocks[0][2]) for j in range(len(blocks[0][1]))], []
            for (_, tail, _), (head, after, costs) in zip(blocks, blocks[1:]):
                enter = [min((best[i] + transition(tail[i], r), i) for i in range(len(tail))) for r in head]
                ways = [min((enter[a][0] + costs[a][j], a) for a in range(len(head))) for j in range(len(after))]
                froms.append((enter, ways))
                best = [w[0] for w in ways]
            last = min(range(len(best)), key=lambda j: (best[j], j))
            for k in range(len(blocks) - 1, -1, -1):
                if k:
                    enter, ways = froms[k - 1]
                    first = ways[last][1]
                else:
                    first = min(range(len(blocks[0][0])), key=lambda a: (blocks[0][2][a][last], a))
                out.append((*now, numbers[k], first, last))
                last = froms[k - 1][0][first][1] if k else last
            blocks = []
        if not blocks:
            numbers = []
        now = key
        if key is None:
            break
        numbers.append(row[2])
        blocks.append((_tuples(row[3]), _tuples(row[4]), [list(c) for c in row[5]]))
    if out:
        yield pd.DataFrame(out, columns=["field", "source", "block", "first", "last"])


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each block along the cheapest path between its chosen ends."""
    rows, now, out = [], None, []
    for key, row in _grouped((pdf[[*ROW, "first", "last", "state"]] for pdf in batches), KEY):
        if key != now and rows:
            may = [eligible(rs) for _, rs in rows]
            path = viterbi([[rs[k] for k in m] for (_, rs), m in zip(rows, may)], int(rows[0][0][7]), int(rows[0][0][8]))
            out += [(*r[:6], rs, m[k], INNER) for (r, rs), m, k in zip(rows, may, path) if r[9] == BORDER]
            rows = []
        now = key
        if key is None:
            break
        rows.append((row, _tuples(row[6])))
    if out:
        yield pd.DataFrame(out, columns=SETTLED.names)


def normalise(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Settle one reading per value.

    rows: ``field, source, ord, row_id, value, tz, date_order`` (source null: the
    value stands alone). Returns ``field, row_id, value, us, dated, against, n_readings``,
    one row per row of the input; ``against`` tells a reading that goes against
    what was declared.
    """
    # rows without source are spread by their id, so that no task gets all of them
    number = F.when(F.col("source").isNull(), F.pmod(F.xxhash64("row_id"), F.lit(4096))).otherwise(F.floor(F.col("ord") / F.lit(block)))
    read = rows.select("field", "source", number.cast("long").alias("block"), F.col("ord").cast("long").alias("ord"), "row_id", "value",
                       all_readings(F.col("value"), F.col("tz"), F.col("date_order")).alias("readings"))
    first = materialise(read.repartition(*KEY).sortWithinPartitions(*KEY, "ord", "row_id").mapInPandas(_inside, SETTLED))  # read three times below
    # the ends of settled blocks stand between unsettled ones of their source
    unsettled = first.filter(F.col("state") == BORDER).select("field", "source").distinct()
    border = first.filter(F.col("state") != INNER).select(*ROW, "state").join(unsettled, ["field", "source"], "left_semi")
    in_order = lambda df, *key: df.repartition(*key).sortWithinPartitions(*key, "ord", "row_id")
    ends = in_order(border.drop("state"), *KEY).mapInPandas(_ends, ENDS)
    picked = ends.repartition("field", "source").sortWithinPartitions(*KEY).mapInPandas(_pick, "field string, source string, block bigint, first int, last int")
    second = in_order(border.join(picked, KEY), *KEY).mapInPandas(_settle, SETTLED)
    pick = ["field", "row_id", "value", "readings", "chosen"]
    all_rows = first.filter(F.col("state") != BORDER).select(pick).unionByName(second.select(pick))
    r = F.expr("try_element_at(readings, chosen + 1)")
    return all_rows.select("field", "row_id", "value", r["us"].alias("us"), r["dated"].alias("dated"),
                           (r["cost"] >= F.lit(DECLARED)).alias("against"), F.size("readings").alias("n_readings"))


def micros_text(us: Column, dated: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss.SSSSSSZ``, or the date alone."""
    sec = F.floor(us / F.lit(1_000_000)).cast("long")
    day = F.floor(sec / F.lit(86_400)).cast("int")
    rest = sec - day.cast("long") * F.lit(86_400)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    date = F.date_from_unix_date(day).cast("string")
    return F.when(dated, date).otherwise(F.concat(
        date, F.lit("T"), two(F.floor(rest / 3600).cast("int")), F.lit(":"), two((F.floor(rest / 60) % 60).cast("int")), F.lit(":"),
        two((rest % 60).cast("int")), F.lit("."), F.lpad((us - sec * F.lit(1_000_000)).cast("string"), 6, "0"), F.lit("Z")))
