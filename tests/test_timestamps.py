import itertools
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import timestamps as ts

ROWS = "field string, source string, ord bigint, row_id string, value string, tz string, date_order string"


def text(value, tz=None, order=None):
    got = [r for r in ts.readings(value, tz, order) if r[3] < ts.DECLARED]
    if not got:
        return None
    us, dated = got[0][:2]
    from datetime import timedelta

    t = ts.EPOCH + timedelta(microseconds=us)
    return t.strftime("%Y-%m-%d") if dated else t.strftime("%Y-%m-%dT%H:%M:%S.%fZ")


@pytest.mark.parametrize(("value", "tz", "order", "want"), [
    ("2023-01-02T00:34:42+00:00[UTC]", None, None, "2023-01-02T00:34:42.000000Z"),
    ("1672621126520", None, None, "2023-01-02T00:58:46.520000Z"),
    ("1672637201", None, None, "2023-01-02T05:26:41.000000Z"),
    ("2023/05/30 (Tue) 23:40", "America/New_York", None, "2023-05-31T03:40:00.000000Z"),
    ("1:56 pm on 8 May, 2023", "UTC", None, "2023-05-08T13:56:00.000000Z"),
    ("01/02/2024 11:31", "UTC", "mdy", "2024-01-02T11:31:00.000000Z"),
    ("01/02/2024 11:31", "UTC", None, "2024-02-01T11:31:00.000000Z"),
    ("Jan 21, 2025 2:20:00 AM IST", "Asia/Kolkata", None, "2025-01-20T20:50:00.000000Z"),
    ("Sun, 6 Apr 2025 01:50:02 +1100", None, None, "2025-04-05T14:50:02.000000Z"),
    ("20230102T044909Z", None, None, "2023-01-02T04:49:09.000000Z"),
    ("2024-05-10T09:24:27.123456789Z", None, None, "2024-05-10T09:24:27.123456Z"),
    ("2023-11-05 01:30:00", "America/New_York", None, "2023-11-05T05:30:00.000000Z"),  # twice: the earlier one
    ("2023-03-12 02:30:00", "America/New_York", None, "2023-03-12T07:30:00.000000Z"),  # skipped: moved on by the gap
    ("20-May-2025", None, None, "2025-05-20"), ("February 7, 2023", None, None, "2023-02-07"), ("20230110", None, None, "2023-01-10"),
    ("31/04/2024", None, None, None), ("25:61 on 4 May, 2024", None, None, None), ("0000-00-00 00:00:00", None, None, None),
    ("2023/02/31 (Fri) 10:00", None, None, None), ("2023", None, None, None), ("2023-03", None, None, None), ("soon", None, None, None), ("", None, None, None), (None, None, None, None),
])
def test_readings(value, tz, order, want):
    assert text(value, tz, order) == want


def test_viterbi_is_the_cheapest_path():
    rnd = random.Random(3)
    for _ in range(60):
        chain = [[(rnd.randrange(9), False, rnd.randrange(3), rnd.choice([0.0, 0.5, 2.0])) for _ in range(rnd.randrange(1, 4))] for _ in range(rnd.randrange(1, 6))]

        def cost(p, chain=chain):
            return sum(chain[i][k][3] for i, k in enumerate(p)) + sum(ts.transition(chain[i][p[i]], chain[i + 1][p[i + 1]]) for i in range(len(p) - 1))

        best = min(cost(p) for p in itertools.product(*[range(len(c)) for c in chain]))
        assert cost(ts.viterbi(chain)) == pytest.approx(best)


def test_blocks_settle_like_whole_sources(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(300):
        v = rnd.choice(["03/04/2024 10:00", "05/06/2024 09:00", "13/04/2024 08:00", "2024-04-03T10:00:00Z", "07/08/2024 12:00", None, "unknown"])
        rows.append(("f", rnd.choice(["a", "b", None]), i, str(i), v, "UTC", rnd.choice(["dmy", "mdy", None])))
    df = spark.createDataFrame(rows, ROWS)
    one = {r["row_id"]: (r["us"], r["against"]) for r in ts.normalise(df).collect()}
    cut = {r["row_id"]: (r["us"], r["against"]) for r in ts.normalise(df, block=7).collect()}
    assert one == cut
    assert len(one) == 300
    for r in rows:
        us, against = one[r[3]]
        # a value with no reading in the declared order keeps the other one, marked as against it
        assert (None if against else us) == ts.declared_instant(r[4], r[5], r[6])


def cheapest(chain):
    """Cost of the best path, by brute force over prefixes."""
    cost = {k: r[3] for k, r in enumerate(chain[0])}
    for a, b in zip(chain, chain[1:]):
        cost = {j: min(cost[i] + ts.transition(a[i], r) for i in cost) + r[3] for j, r in enumerate(b)}
    return min(cost.values())


@pytest.mark.parametrize("block", [3, 11, 1000])
def test_the_path_decides_where_no_order_is_declared(spark, block):
    rnd = random.Random(8)
    rows, at = [], 0
    for i in range(240):
        source = "none" if i % 2 else rnd.choice("ab")  # "none" has no value with one reading
        v = f"{rnd.randrange(1, 13):02d}/{rnd.randrange(1, 13):02d}/2024 10:00" if source == "none" or rnd.random() < 0.8 else rnd.choice(["2024-04-03T10:00:00Z", "14/05/2024 10:00", "05/14/2024 10:00", None])
        rows.append(("f", source, i, str(i), v, "UTC", "any"))
    got = {r["row_id"]: r["us"] for r in ts.normalise(spark.createDataFrame(rows, ROWS), block=block).collect()}
    assert len(got) == 240
    for source in ("none", "a", "b"):
        mine = [(ts.readings(r[4], "UTC", "any"), got[r[3]]) for r in rows if r[1] == source]
        chain = [rs for rs, _ in mine if rs]
        path = [next(r for r in rs if r[0] == us) for rs, us in mine if rs]
        assert sum(r[3] for r in path) + sum(ts.transition(a, b) for a, b in zip(path, path[1:])) == pytest.approx(cheapest(chain))


def test_the_path_changes_a_reading(spark):
    rows = [("f", "s", i, str(i), v, "UTC", "any") for i, v in enumerate(["25/03/2024 10:00", "02/04/2024 10:00", "28/04/2024 10:00"])]
    rows += [("f", "t", i, f"t{i}", v, "UTC", "any") for i, v in enumerate(["03/25/2024 10:00", "04/02/2024 10:00", "04/28/2024 10:00"])]
    got = {r["row_id"]: r["us"] for r in ts.normalise(spark.createDataFrame(rows, ROWS)).collect()}
    assert [got[str(i)] for i in range(3)] == [got[f"t{i}"] for i in range(3)]  # the same days, each source in its own order


def test_plain_forms_are_read_alike_in_the_jvm(spark):
    values = ["2024-05-10T09:24:27Z", "2024-05-10T09:24:27.5+05:30", "2024-02-31T00:00:00Z", "2024-05-10T25:00:00Z", "2024-05-10", "5 May 2024", None, "", "9999-12-31T23:59:59Z", "0001-01-01T00:00:00Z"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", ts.instant(F.col("v"), F.lit("UTC"), F.lit(None).cast("string")).alias("us"))
    assert {r["v"]: r["us"] for r in df.collect()} == {v: ts.declared_instant(v, "UTC") for v in values}


def test_empty_table(spark):
    assert ts.normalise(spark.createDataFrame([], ROWS)).count() == 0
