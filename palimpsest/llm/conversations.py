"""Rebuilding conversations from message rows.

Messages run through two steps of keyed streaming state with event-time
watermarks and timers.

``pieces``: the key is the event-time day of the message and a shard of the sessions, so that a
session of any size is spread over its days. The state buffers each session's messages of the day,
late ones included, without repeats; when the watermark passes the end of
the day by the lateness allowed, the timer closes the pieces: a session's turns are put in order and
judged, and one row goes out with the turns and what a judgement across its borders needs
(first and last side, whether the sides alternate, blanks, counts).

``verdicts``: the key is a shard of the sessions, the state holds the summaries of each session's pieces, one short row a
day. When nothing more came for the session for ``gap_us`` of event time, or the stream is
closed, the timer judges the whole session and gives out, if it is sound, the number of
the turn before each piece.  ``conversations`` puts both together.

A historical table is replayed: no row is late, whatever order the files have, and
a closing mark behind the last possible time fires all timers. A live source
runs through the same steps with ``lateness_us`` and ``gap_us``; a row later than the lateness
is dropped by the watermark, as it would change a piece already given out.

Rules: of rows of one session equal in side, instant and content the one with
the smallest id stays. Kept is a session with an id, readable times throughout,
at least one turn of the two sides, which alternate from the user side to the
reply side, none of them blank. Rows of system, tool and unknown roles are
numbered but not judged. Turns are numbered by instant, then id.

Nulls: a null or empty session id, a null or unreadable time drop the session; a
null role is an unknown role; null content is blank. Rows of one id count once.
An empty table gives an empty result; columns beside those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.operators.timestamps import instant
from palimpsest.session import shared_path

# How clients write the two sides.
USER_SIDE = ("user", "human")
REPLY_SIDE = ("assistant", "ai", "bot")
# White space, control and format characters, and letters and marks without ink.
BLANK = r"^[\s\p{Z}\p{C}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2800}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}]*$"
DAY_US = 86_400_000_000
SHIFT_US = 62_135_596_800_000_000  # event time counts from the year 1, so that no readable time lies before the first watermark
SCALE = 64  # and runs slower by this, as the workers' timestamps hold no ten thousand years
CLOSING_US = 3_500_000 * DAY_US  # behind every time a four-digit year can name
MARK = "\0closing"
# Keys of state: so many for the sessions of one day, and so many for all sessions. A key's state holds the sessions that share
# it, each by itself, as a key costs a worker more than a session does; raise them with the number of open sessions.
DAY_SHARDS, SESSION_SHARDS = 4, 1024


def side(role: Column) -> Column:
    r = F.lower(F.trim(F.regexp_replace(role, r"^\s+|\s+$", "")))
    return F.when(r.isin(*USER_SIDE), "user").when(r.isin(*REPLY_SIDE), "reply").otherwise(F.coalesce(r, F.lit("")))


def messages(episodes: DataFrame, session_meta: DataFrame) -> DataFrame:
    """``session_id, id, us, side, blank, content_key`` of each row; works on streams."""
    meta = session_meta.select("session_id", "tz", "date_order").dropDuplicates(["session_id"])
    e = episodes.filter("session_id is not null and session_id != ''").join(meta, "session_id", "left")
    return e.select(
        "session_id", "id", instant(F.col("ts"), F.col("tz"), F.col("date_order")).alias("us"), side(F.col("role")).alias("side"),
        (F.col("content").isNull() | F.col("content").rlike(BLANK)).alias("blank"),
        F.when(F.col("content").isNull(), F.lit("")).otherwise(F.md5("content")).alias("content_key"))


PIECE = "session_id string, day bigint, n bigint, first string, last string, bad boolean, ids array<bigint>, sides array<string>"
BUFFER = "session array<string>, us array<bigint>, id array<bigint>, side array<string>, blank array<boolean>, content array<string>, unreadable array<string>"
LINE = "session array<string>, day array<bigint>, n array<bigint>, first array<string>, last array<string>, bad array<string>"
VERDICT = "session_id string, day bigint, offset bigint"
JUDGED = ("user", "reply")


def _close_piece(session: str, day: int, rows: list[tuple], unreadable: bool) -> tuple:
    """One row of PIECE from a session's (us, id, side, blank) of a day."""
    rows = sorted(rows)
    said = [(side, blank) for _, _, side, blank in rows if side in JUDGED]
    bad = unreadable or any(blank for _, blank in said) or any(a[0] == b[0] for a, b in zip(said, said[1:]))
    return session, day, len(rows), said[0][0] if said else None, said[-1][0] if said else None, bad, [r[1] for r in rows], [r[2] for r in rows]


def _buffer(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Buffer the messages of a day and some sessions until its timer fires."""
    day = int(key[0])
    end = _millis((day + 1) * DAY_US)
    if not state.exists and end <= state.getCurrentWatermarkMs():
        return  # the pieces went out already
    held: dict[tuple, tuple] = {}  # of (session, us, side, content) the smallest id, and whether it is blank
    unreadable: set[str] = set()
    if state.exists:
        *columns, known = state.get
        unreadable = set(known)
        held = {(x, us, side, content): (i, blank) for x, us, i, side, blank, content in zip(*columns)}
    if state.hasTimedOut:
        state.remove()
        rows: dict[str, list] = {x: [] for x in sorted(unreadable)}
        for (x, us, side, _), (i, blank) in held.items():
            rows.setdefault(x, []).append((us, i, side, blank))
        yield pd.DataFrame([_close_piece(x, day, r, x in unreadable) for x, r in rows.items()], columns=["session_id", "day", "n", "first", "last", "bad", "ids", "sides"])
        return
    for pdf in batches:
        for x, us, i, side, blank, content in zip(*(pdf[c].tolist() for c in ("session_id", "us", "id", "side", "blank", "content_key"))):
            if us is None or us != us:
                unreadable.add(x)
                continue
            one = (x, int(us), side, content)
            old = held.get(one)
            if old is None or i < old[0]:
                held[one] = (i, blank)
    columns = list(zip(*((x, us, i, side, blank, content) for (x, us, side, content), (i, blank) in held.items()))) or [()] * 6
    state.update((*map(list, columns), sorted(unreadable)))
    state.setTimeoutTimestamp(end)


def _millis(us: int) -> int:
    """Event time of a microsecond from the year 1, as the timers count it."""
    return int(us) // (1000 * SCALE)


def _clock(us: Column, lateness_us: int = 0) -> tuple[Column, str]:
    """Event time of microseconds from the year 1, and the delay of the watermark behind it."""
    return F.timestamp_micros(F.floor(us / F.lit(SCALE)).cast("bigint")), f"{lateness_us // SCALE} microseconds"


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("session_id"), F.lit(shards)).cast("int")


def pieces(msgs: DataFrame, lateness_us: int = 0, shards: int = DAY_SHARDS) -> DataFrame:
    """A stream of PIECE from a stream of ``messages``."""
    at = F.coalesce(F.col("us") + F.lit(SHIFT_US), F.lit(2 * DAY_US))
    clock, delay = _clock(at, lateness_us)
    kept = msgs.withColumns({"at": clock, "day": F.floor(at / F.lit(DAY_US)).cast("bigint"), "shard": _shard(shards)}).withWatermark("at", delay)
    return kept.groupBy("day", "shard").applyInPandasWithState(_buffer, PIECE, BUFFER, "append", GroupStateTimeout.EventTimeTimeout)


def _judge(session: str, lines: list[tuple]) -> list[tuple]:
    """(session, day, turns before the piece) of a sound session; lines: (day, n, first, last)."""
    lines = sorted(lines)
    said = [(first, last) for _, _, first, last in lines if first]
    if not said or said[0][0] != "user" or said[-1][1] != "reply" or any(a[1] == b[0] for a, b in zip(said, said[1:])):
        return []
    before = [0, *accumulate(n for _, n, _, _ in lines)]
    return [(session, day, k) for (day, *_), k in zip(lines, before)]


def _line_of(gap_us: int | None):
    def end(lines: list[tuple]) -> int:
        """When a session is over if nothing more comes."""
        return _millis((max(x[0] for x in lines) + 1) * DAY_US + gap_us if gap_us is not None else SHIFT_US + CLOSING_US - DAY_US)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lines: dict[str, list] = {}
        bad: set[str] = set()
        if state.exists:
            *columns, known = state.get
            bad = set(known)
            for x, *line in zip(*columns):
                lines.setdefault(x, []).append(tuple(line))
        if state.hasTimedOut:
            over = [x for x, got in lines.items() if end(got) <= state.getCurrentWatermarkMs()]
            out = [row for x in over if x not in bad for row in _judge(x, lines[x])]
            for x in over:
                del lines[x]
            bad &= lines.keys()
            if out:
                yield pd.DataFrame(out, columns=["session_id", "day", "offset"])
        else:
            for pdf in batches:
                for x, broken, *line in zip(*(pdf[c].tolist() for c in ("session_id", "bad", "day", "n", "first", "last"))):
                    lines.setdefault(x, []).append(tuple(line))
                    if broken:
                        bad.add(x)
        if not lines:
            state.remove()
            return
        columns = list(zip(*((x, *line) for x, got in lines.items() for line in got)))
        state.update((*map(list, columns), sorted(bad)))
        state.setTimeoutTimestamp(max(min(map(end, lines.values())), state.getCurrentWatermarkMs() + 1))

    return run


def verdicts(closed: DataFrame, gap_us: int | None = None, shards: int = SESSION_SHARDS) -> DataFrame:
    """A stream of VERDICT from a stream of PIECE; ``gap_us`` None: a session ends when the stream is closed."""
    clock, delay = _clock((F.col("day") + 1) * F.lit(DAY_US))
    kept = closed.select("session_id", "day", "n", "first", "last", "bad").withColumns({"at": clock, "shard": _shard(shards)}).withWatermark("at", delay)
    return kept.groupBy("shard").applyInPandasWithState(_line_of(gap_us), VERDICT, LINE, "append", GroupStateTimeout.EventTimeTimeout)


def conversations(closed: DataFrame, said: DataFrame) -> DataFrame:
    """``session_id, turn_no, id, side`` of the kept sessions, from written pieces and verdicts."""
    turns = closed.join(said, ["session_id", "day"]).select("session_id", "offset", F.posexplode(F.arrays_zip("ids", "sides")).alias("k", "t"))
    return turns.select("session_id", (F.col("offset") + F.col("k") + 1).cast("bigint").alias("turn_no"), F.col("t.ids").alias("id"), F.col("t.sides").alias("side"))


def _drain(stream: DataFrame, out: str, state: str) -> None:
    stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def only(path: str) -> str:
    """A glob for exactly this file or folder, as the source takes no single file."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/{{{name}}}"


def run(spark: SparkSession, msgs: DataFrame, lateness_us: int = 0, gap_us: int | None = None, replay: bool = False) -> DataFrame:
    """``conversations`` of all that a stream of ``messages`` holds when it is drained.

    With a ``gap_us`` only sessions that the gap has ended by then come out; without, a
    closing mark ends all, at once with the rows of a ``replay`` (one trigger), else behind them. The
    watermark of the first step says when a piece is whole, so the second step's
    is the days of the pieces it gets.
    """
    out, ends, mark = (shared_path(spark, f"conversations-{x}") for x in ("pieces", "verdicts", "mark"))
    cols = "session_id string, id bigint, us bigint, side string, blank boolean, content_key string"
    row = [(MARK, -1, CLOSING_US, "closing", False, "")]
    spark.createDataFrame(row if replay else [], cols).coalesce(1).write.parquet(mark)
    marked = msgs.unionByName(spark.readStream.schema(cols).parquet(mark))
    _drain(pieces(marked, lateness_us), out, out + "-state")
    if not replay and gap_us is None:
        spark.createDataFrame(row, cols).coalesce(1).write.mode("append").parquet(mark)
        _drain(pieces(marked, lateness_us), out, out + "-state")  # goes on from its state
    closed = spark.readStream.schema(PIECE).parquet(out)
    if gap_us is None:
        day = (CLOSING_US + SHIFT_US) // DAY_US
        spark.createDataFrame([(MARK, day, 0, None, None, True, [], [])], PIECE).coalesce(1).write.parquet(mark + "-piece")
        closed = closed.unionByName(spark.readStream.schema(PIECE).parquet(mark + "-piece"))
    _drain(verdicts(closed, gap_us), ends, ends + "-state")
    return conversations(spark.read.schema(PIECE).parquet(out), spark.read.schema(VERDICT).parquet(ends))


def rebuild(spark: SparkSession, episodes_path: str, session_meta: DataFrame) -> DataFrame:
    """``session_id, turn_no, id, side`` of the kept sessions of a parquet table, replayed."""
    stream = spark.readStream.schema(spark.read.parquet(episodes_path).schema).parquet(only(episodes_path))
    return run(spark, messages(stream.select("id", "session_id", "role", "content", "ts"), session_meta), replay=True)
