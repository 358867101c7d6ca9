import os

import pytest

from palimpsest.llm import conversations as cv

COLS = "id bigint, session_id string, role string, content string, ts string, emb array<float>"
META = "session_id string, owner string, tz string, date_order string"


def kept(spark, tmp_path, rows):
    path = os.path.join(str(tmp_path), "episodes.parquet")
    spark.createDataFrame([(*r, None) for r in rows], COLS).write.mode("overwrite").parquet(path)
    meta = spark.createDataFrame([("tz", None, "America/New_York", "mdy"), ("none", None, None, None)], META)
    got = cv.rebuild(spark, path, meta).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r["session_id"], r["turn_no"])):
        out.setdefault(r["session_id"], []).append(r["id"])
        assert r["turn_no"] == len(out[r["session_id"]])
    return out


def test_rules(spark, tmp_path):
    t = "2024-01-0{}T0{}:00:00Z".format
    rows = [
        (1, "ok", "User ", "hi", t(1, 1)), (2, "ok", "bot", "yes", t(1, 2)), (2, "ok", "bot", "yes", t(1, 2)), (3, "ok", "ai", "yes", "2024-01-01T03:00:00+01:00"), (4, "ok", "system", None, t(1, 3)),
        (5, "ok", "human", "more", t(3, 1)), (6, "ok", "assistant", "done", t(3, 2)),
        (10, "late", "assistant", "a", t(1, 2)), (11, "late", "user", "q", t(1, 1)),
        (20, "same", "user", "q", t(1, 1)), (21, "same", "user", "q2", t(1, 2)), (22, "same", "bot", "a", t(1, 3)),
        (30, "blank", "user", "​  ", t(1, 1)), (31, "blank", "bot", "a", t(1, 2)),
        (40, "unread", "user", "q", "soon"), (41, "unread", "bot", "a", t(1, 2)),
        (50, "open", "user", "q", t(1, 1)), (60, "backward", "bot", "a", t(1, 1)), (61, "backward", "user", "q", t(1, 2)),
        (70, None, "user", "q", t(1, 1)), (71, None, "bot", "a", t(1, 2)), (80, "only", "system", "s", t(1, 1)),
        (90, "border", "user", "q", "2024-01-01T23:59:59Z"), (91, "border", "bot", "a", "2024-01-02T00:00:00Z"),
        (95, "tie", "bot", "a", t(1, 1)), (94, "tie", "user", "q", t(1, 1)),
    ]
    assert kept(spark, tmp_path, rows) == {"ok": [1, 2, 4, 5, 6], "late": [11, 10], "border": [90, 91], "tie": [94, 95]}


def live(spark, tmp_path, files, **kw):
    """Conversations of files that arrive one after the other, a trigger each."""
    path = os.path.join(str(tmp_path), "live")
    cols = "session_id string, id bigint, us bigint, side string, blank boolean, content_key string"
    for k, rows in enumerate(files):
        spark.createDataFrame([(s, i, int(day * cv.DAY_US), side, False, str(i)) for s, i, day, side in rows], cols).coalesce(1).write.mode("append").parquet(path)
        newest = max((f.path for f in os.scandir(path) if f.name.startswith("part-")), key=os.path.getmtime)
        os.utime(newest, (1_700_000_000 + k * 60,) * 2)
    got = cv.run(spark, spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(path), **kw).collect()
    return {s: [r["id"] for r in sorted(got, key=lambda r: r["turn_no"]) if r["session_id"] == s] for s in {r["session_id"] for r in got}}


def test_a_row_within_the_lateness_still_counts(spark, tmp_path):
    files = [[("s", 1, 10.1, "user"), ("s", 3, 10.3, "user")], [("other", 9, 11.5, "user")], [("s", 2, 10.2, "reply")], [("s", 4, 10.4, "reply")], [("other", 8, 30.0, "system")]]
    assert live(spark, tmp_path, files, lateness_us=3 * cv.DAY_US) == {"s": [1, 2, 3, 4]}


def test_a_row_behind_the_lateness_is_dropped(spark, tmp_path):
    files = [[("s", 1, 10.1, "user"), ("s", 2, 10.2, "reply")], [("far", 9, 20.0, "user")], [("far", 8, 20.1, "reply")], [("s", 3, 10.3, "user")]]
    assert live(spark, tmp_path, files, lateness_us=cv.DAY_US) == {"s": [1, 2], "far": [9, 8]}


def test_timeout_ends_a_session(spark, tmp_path):
    """Of a stream that goes on, sessions come out that were silent for the gap, sound ones only."""
    files = [[("a", 1, 10.1, "user"), ("a", 2, 10.2, "reply"), ("open", 5, 10.1, "user")], [("b", 3, 13.0, "user"), ("b", 4, 13.1, "reply")], [("c", 6, 40.0, "user"), ("c", 7, 40.1, "reply")], [("d", 8, 80.0, "user")], [("d", 9, 90.0, "user")]]
    got = live(spark, tmp_path, files, gap_us=5 * cv.DAY_US)
    assert got["a"] == [1, 2]
    assert got["b"] == [3, 4]
    assert "open" not in got
    assert "d" not in got


def test_only_the_named_file_is_read(spark, tmp_path):
    path = os.path.join(str(tmp_path), "episodes.parquet")
    rows = [(1, "s", "user", "q", "2024-01-01T00:00:00Z", None), (2, "s", "bot", "a", "2024-01-01T00:00:01Z", None)]
    spark.createDataFrame(rows, COLS).write.parquet(path)
    spark.createDataFrame([(3, "s", "user", "q", "2024-01-01T00:00:02Z", None)], COLS).write.parquet(path + ".old")
    meta = spark.createDataFrame([], META)
    assert sorted(r["id"] for r in cv.rebuild(spark, path, meta).collect()) == [1, 2]


def test_empty_table(spark, tmp_path):
    assert kept(spark, tmp_path, []) == {}


@pytest.mark.parametrize(("text", "blank"), [("", True), (" \t\n", True), ("﻿", True), (" ​", True), ("⠀", True), ("x", False), ("।", False), ("🙂", False)])
def test_blank(spark, text, blank):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(text,)], "c string").select(F.col("c").rlike(cv.BLANK).alias("b")).first()["b"] is blank
