import numpy as np

from palimpsest.llm import similar


def brute(ids, vecs, k, least):
    out = set()
    ok = [(i, np.array(v, float)) for i, v in zip(ids, vecs) if v is not None and len(v) and np.isfinite(v).all() and np.any(v)]
    for i, v in ok:
        near = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 6), j) for j, w in ok if j != i and len(w) == len(v))
        out |= {(i, j) for c, j in near[:k] if -c >= least}
    return out


def test_like_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 16))
    vecs = [(base[i % 12] + 0.1 * rng.normal(size=16)).astype(np.float32).tolist() for i in range(150)]
    vecs += [vecs[0], vecs[0], None, [0.0] * 16, [float("nan")] * 16, [], [1.0, 2.0], [2.0, 4.0]]
    ids = list(range(1, len(vecs) + 1))
    df = spark.createDataFrame(list(zip(ids, vecs, ["x"] * len(ids))), "id bigint, emb array<float>, copy string")
    want = brute(ids, vecs, 4, 0.8)
    for kw in ({}, {"max_block": 20}):
        got = {(r["id"], r["other"]) for r in similar.nearest(df.unionByName(df.limit(30)), "id", "emb", 4, 0.8, probes=3, block=64, **kw).collect()}
        assert len(got & want) / len(want) > 0.97
        assert len(got - want) <= 0.03 * len(want)


def test_a_third_of_all_rows_are_copies(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(200)] + [(1000 + i, [0.0, float(i + 1), 1.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "id bigint, emb array<float>")
    got = similar.nearest(df, "id", "emb", 3, 0.9).filter("id < 1000").collect()
    assert len(got) == 600
    assert {r["other"] for r in got} == {0, 1, 2, 3}


def test_error_bound_holds():
    rng = np.random.default_rng(1)
    m = rng.normal(size=(80, 64)).astype(np.float32)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    codes, scale, rest = similar.quantise(m)
    approx = (codes.astype(float) @ codes.astype(float).T) * scale[:, None] * scale[None, :]
    bound = rest[:, None] + (1 + rest[:, None]) * rest[None, :] + similar.FLOAT_SLACK
    assert (np.abs(m.astype(float) @ m.astype(float).T - approx) <= bound).all()


def test_empty(spark):
    assert similar.nearest(spark.createDataFrame([], "id bigint, emb array<float>"), "id", "emb").count() == 0
