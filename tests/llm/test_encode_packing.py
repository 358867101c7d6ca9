import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import encode, packing

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(encode.DEFAULT_VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def ours():
    return encode.Encoder(encode.DEFAULT_VOCABULARY)


@pytest.fixture(scope="module")
def theirs():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(enc, texts):
    flat, n = enc.encode(texts)
    out, at = [], 0
    for k in n:
        out.append(flat[at:at + k].tolist())
        at += k
    return out


def test_known_shapes(ours, theirs):
    texts = [None, "", " ", "a" * 3000, "<|endoftext|> is text", "#!" * 900, "日本語 हिन्दी 🌱👍🏽", "\n\n\t x ", "it's 12 o'clock", "x y"]
    assert ids(ours, texts) == [theirs.encode_ordinary(t) if t else [] for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=6))
def test_like_the_library(ours, theirs, texts):
    assert ids(ours, texts) == [theirs.encode_ordinary(t) if t else [] for t in texts]


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (3, "hello world", "z"), (3, "hello world", "z")], "doc_id bigint, text string, ids string")
    got = encode.encode(df).orderBy("doc_id").collect()
    assert [len(r["ids"]) for r in got] == [0, 0, 2, 2]
    assert encode.encode(df.filter("false")).count() == 0
    assert encode.encode(df, empty_ids=(7,)).filter("doc_id = 1").first()["ids"] == [7]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.sampled_from("abc"), st.integers(0, 4)), max_size=60))
def test_best_fit_never_overfills(items):
    chosen = packing.best_fit([s for s, *_ in items], [a for _, a, _ in items], [c for *_, c in items], 50)
    room = {}
    for (size, *_), b in zip(items, chosen):
        room[b] = room.get(b, 0) + size
    assert all(v <= 50 for v in room.values())


def test_copies_are_kept_apart():
    chosen = packing.best_fit([10] * 20, ["s"] * 20, [1] * 4 + list(range(10, 26)), 50)
    assert len(set(chosen[:4])) >= 2
    assert len(set(chosen)) <= 5


def test_whole_items_and_pieces(spark):
    rows = [(i, "s" if i % 3 else None, i % 40, (i * 37) % 300) for i in range(500)] + [(1000, "s", 99, 2500), (1001, "s", 98, 0)]
    items = spark.createDataFrame(rows, "item bigint, source string, cluster bigint, size bigint")
    budgets = spark.createDataFrame([("small", 512), ("large", 2048)], "budget string, capacity bigint")
    got = packing.pack(items, budgets, shard_rows=100).toPandas()
    fill = got.groupby(["budget", "capacity", "container"]).length.sum().reset_index()
    assert (fill.length <= fill.capacity).all()
    for _, g in got.groupby("budget"):
        assert g.groupby("item").length.sum().to_dict() == {r[0]: r[3] for r in rows}
        cap = g.capacity.iloc[0]
        assert set(g[g.piece > 1].item) == {r[0] for r in rows if r[3] > cap}
        assert g.length.sum() / (g.container.nunique() * cap) > 0.9
    assert packing.pack(items.filter("false"), budgets).count() == 0
