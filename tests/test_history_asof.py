import random

from palimpsest.operators import asof, history

FACTS = "id bigint, subject string, predicate string, object string, scope string, ingested_at string, valid_from string, invalid_at string, superseded_by bigint, extra string"


def day(n):
    return f"2024-{1 + n // 28:02d}-{1 + n % 28:02d}T00:00:00Z"


def versions(spark, rows, **kw):
    df = spark.createDataFrame(rows, FACTS)
    out = history.versions(history.intervals(history.change_log(df), **kw), **kw)
    return sorted((r["id"], r["start_us"], r["end_us"]) for r in out.collect())


def test_late_fact_and_coalescing(spark):
    rows = [(1, "Ann ", "lives_in", "Oak", None, day(1), day(0), None, None, "x"), (2, "ann", "lives_in", " oak", "", day(9), day(5), None, None, "x"),
            (3, "ann", "lives_in", "Elm", "", day(50), day(20), day(30), None, "x"), (4, "ann", "lives_in", "Elm", "", day(60), day(30), day(31), 9, "x"),
            (5, "ann", "likes", "tea", "", day(1), day(0), None, None, "x"), (6, None, "lives_in", None, None, None, None, None, None, None)]
    got = versions(spark, rows)
    assert [r[0] for r in got] == [1, 3]  # 2 tells 1 again; 4 follows 3 without a gap and says the same
    assert got[1][2] is None  # the end of 4 names a successor and is not to be trusted


def test_buckets_do_not_matter(spark):
    rnd = random.Random(2)
    rows = [(i, "user", "drives", rnd.choice("abc"), "", day(rnd.randrange(250)), day(rnd.randrange(250)), day(rnd.randrange(250)) if rnd.random() < 0.3 else None, None, "") for i in range(150)]
    assert versions(spark, rows) == versions(spark, rows, bucket_us=history.DAY_US * 3)


def test_timeline_splits_and_coalesces(spark):
    rows = [(1, "ann", "lives_in", "Oak", "", day(0), day(0), None, None, ""), (2, "ann", "drives", "car", "", day(5), day(5), day(9), None, ""), (3, "ann", "lives_in", "Elm", "", day(9), day(9), None, None, "")]
    df = spark.createDataFrame(rows, FACTS)
    t = history.timeline(history.versions(history.intervals(history.change_log(df)))).orderBy("start_us").collect()
    assert [(r["lives_in"], r["drives"]) for r in t] == [("oak", None), ("oak", "car"), ("elm", None)]


def test_empty(spark):
    assert versions(spark, []) == []


def test_persistent_tree_keeps_old_roots():
    rnd = random.Random(1)
    tree, told = asof.PersistentTree(), []
    for known in range(200):
        key = (rnd.randrange(100), known, known)
        tree.insert(known, key, None)
        told.append((known, key))
    for _ in range(300):
        at, bound = rnd.randrange(-1, 200), (rnd.randrange(100), 10**9, 10**9)
        want = max((k for n, k in told if n <= at and k <= bound), default=None)
        got = tree.before(at, bound)
        assert (got[0] if got else None) == want


def test_as_known_matches_brute_force(spark):
    rnd = random.Random(4)
    facts = [(rnd.choice("ab"), rnd.choice(["p", "q"]), i, rnd.randrange(900), rnd.randrange(900), rnd.randrange(900) if rnd.random() < 0.3 else None) for i in range(120)]
    events = [(i, rnd.choice(["a", "b", "c", None]), rnd.randrange(900) if rnd.random() < 0.95 else None) for i in range(200)]
    f = spark.createDataFrame(facts, "entity string, attribute string, id bigint, start_us bigint, ingested_us bigint, ended_us bigint")
    e = spark.createDataFrame(events, "event_id bigint, entity string, at_us bigint")
    want = set()
    for i, ent, at in events:
        for p in "pq":
            best = max(((s, g, k, end) for x, a, k, s, g, end in facts if x == ent and a == p and at is not None and s <= at and g <= at), default=None, key=lambda r: r[:3])
            if best and not (best[3] is not None and best[3] <= at):
                want.add((i, p, best[2]))
    for width in (50, 10_000):
        got = [tuple(r) for r in asof.as_known(e, f, slice_us=width).collect()]
        assert set(got) == want
        assert len(got) == len(want)


def test_what_is_known_early_waits_for_its_start(spark):
    """A fact told in advance is in the root of the event but must not be found before it begins."""
    facts = [("a", "p", 1, 10, 10, None), ("a", "p", 2, 50, 20, None), ("a", "p", 3, 30, 60, None)]
    f = spark.createDataFrame(facts, "entity string, attribute string, id bigint, start_us bigint, ingested_us bigint, ended_us bigint")
    e = spark.createDataFrame([(t, "a", t) for t in (5, 25, 45, 55, 65)], "event_id bigint, entity string, at_us bigint")
    for width in (7, 1000):
        assert {r["event_id"]: r["fact_id"] for r in asof.as_known(e, f, slice_us=width).collect()} == {25: 1, 45: 1, 55: 2, 65: 2}
