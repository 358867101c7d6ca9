import numpy as np

from palimpsest.llm import similar


def _recall(spark, n, hot, spread):
    rng = np.random.default_rng(7)
    way = rng.normal(size=64)
    m = rng.normal(size=(n, 64)) / 8
    m[:hot] = way / np.linalg.norm(way) + spread * m[:hot]
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    like = m[:hot].astype(float) @ m[:hot].T.astype(float)
    np.fill_diagonal(like, -1)
    top = np.argsort(-like, axis=1)[:, :4]
    want = {(i, int(j)) for i in range(hot) for j in top[i] if like[i, j] >= 0.9}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id bigint, emb array<float>")
    got = {(r["id"], r["other"]) for r in similar.nearest(df, "id", "emb", 4, 0.9, block=32).collect()}
    return len(got & want) / len(want), len(want)


def test_a_third_of_all_rows_near_one_direction(spark):
    recall, pairs = _recall(spark, 6_000, 2_000, 0.4)
    assert pairs > 100
    assert recall > 0.97
