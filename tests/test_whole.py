"""Queries and operators that must leave out nothing, hot keys included."""

import os

from pyspark.sql import functions as F

from palimpsest.operators.neighbours import around, joined_text
from palimpsest.plans import registry
from tests.compare import duck_rows, rows, views


def test_shared_session_is_in(spark, sf):
    q = registry.queries()
    ids = {r["id"] for r in spark.read.parquet(f"{sf}/episodes.parquet").filter("session_id = 'capture-inbox'").collect()}
    assert ids
    for name in ("win08_window_of_turns", "win11_gap_markers"):
        assert ids <= {r["id"] for r in q[name](spark, sf).collect()}
    for name in ("hsh01_session_digest", "str18_session_render"):
        assert q[name](spark, sf).filter("session_id = 'capture-inbox'").count() == 1


def test_pieces_of_a_hot_key(spark):
    turns = [("hot", 3 * i + i % 2, f"t{i}") for i in range(200)] + [("one", 7, "x")]
    df = spark.createDataFrame(turns, "k string, id bigint, t string")
    want = {"hot": " ".join(t for k, _, t in turns if k == "hot"), "one": "x"}
    got = joined_text(df, ["k"], F.floor(F.col("id") / 10), ["id"], F.col("t"), " ").collect()
    assert {r["k"]: r["text"] for r in got} == want
    near = {r["id"]: r["around"] for r in around(df.filter("k = 'hot'"), "k", "id", 2, 10).collect()}
    ids = sorted(near)
    assert [near[i] for i in ids] == [3, 4] + [5] * 196 + [4, 3]


def test_digests_of_the_largest_subject(spark, sf):
    larger = os.path.join(os.path.dirname(sf), "sf0.01")  # the smallest has no subject 'user'
    name = "mut07_observation_digests"
    df = registry.queries()[name](spark, larger)
    assert df.filter("subject = 'user'").count() > 0
    cols, got = rows(df)
    assert got == duck_rows(views(larger), registry.oracle_sql()[name], cols)
