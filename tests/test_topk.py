"""Batches of questions against many texts: nothing is left out, and a task gives only its best."""

import numpy as np
import pyarrow as pa

from palimpsest.operators import lexical, vector
from palimpsest.operators.plugins import HashEmbedder, _bucket
from palimpsest.operators.topk import distinct_texts
from palimpsest.plans.base import alike, to_all

EMBEDDER = HashEmbedder(256, "md5")


def test_a_task_gives_k_rows_a_query_over_all_blocks():
    """before, each block of 1,024 texts and each batch of vectors gave k rows."""
    page = lexical._Page([{"qid": q, "term": t, "weight": 1} for q in ("a", "b") for t in ("fig", "plum")], False)
    batches = [pa.RecordBatch.from_pydict({"gid": list(range(i, i + 5000)), "many": [1] * 5000, "t": [["fig"] * (1 + j % 7) + ["plum"] for j in range(5000)]}) for i in range(0, 20_000, 5000)]
    got = pa.Table.from_batches(list(page.scorer({-1: 50_000, -2: 250_000, 0: 20_000, 1: 20_000}, 3)(iter(batches)))).to_pylist()
    assert len(got) == 6
    texts = [pa.RecordBatch.from_pydict({"gid": list(range(i, i + 3000)), "text": [f"text {j}" for j in range(i, i + 3000)]}) for i in (0, 3000)]
    got = pa.Table.from_batches(list(vector._counted([{"qid": "a", "question": "text 77"}], EMBEDDER.counts, 4, 1e-6)(iter(texts)))).to_pylist()
    assert len(got) == 4
    assert got[0]["gid"] == 77


def test_equal_texts_all_come_back(spark):
    """F2: equal texts are scored once, and their ids are ranked one by one."""
    docs = spark.createDataFrame([(i, "green fig") for i in range(60, 0, -1)] + [(5, "green fig"), (99, None), (100, "plum")], "doc_id bigint, text string")
    terms = spark.createDataFrame([("q", "fig", 1)], "qid string, term string, weight bigint")
    assert [r["doc_id"] for r in lexical.bm25(docs, terms, 40).orderBy("rank").collect()] == list(range(1, 41))
    one = {r["text"]: r for r in distinct_texts(docs, "doc_id", 3).collect()}["green fig"]
    assert (one["gid"], one["many"], one["ids"]) == (1, 60, [1, 2, 3])


def test_scores_that_round_to_nothing_count(spark):
    """SQL ranks every text that shares a term; before, a share below half a millionth was left out."""
    docs = spark.createDataFrame([(i, "the") for i in range(1, 10)] + [(10, "the " + "word " * 300)], "doc_id bigint, text string")
    terms = spark.createDataFrame([("q", "the", 1)], "qid string, term string, weight bigint")
    assert [(r["doc_id"], r["score"]) for r in lexical.bm25(docs, terms, 20).orderBy("rank").collect()][-1] == (10, 0.0)


def test_texts_as_vectors(spark):
    """counts of grams compared as whole numbers give what vectors give, long texts included."""
    texts = ["", None, "ab", "my tea is green", "MY TEA is green", "wörld 😀 tea", "my tea " * 3000, "no grams shared xyz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    q = spark.createDataFrame([("q", "my tea"), ("long", "my tea is " * 2500), ("none", None)], "qid string, question string")
    unit = lambda d, k, t: spark.createDataFrame([(r[k], v) for r, v in ((r, EMBEDDER.embed([r[t]])[0]) for r in d.collect())], f"{k} {d.schema[k].dataType.simpleString()}, v array<double>")
    want = vector.search(unit(docs, "id", "text"), unit(q, "qid", "question"), 3, 1e-6, keep_self=True)
    rows = lambda df: sorted((r["qid"], r["rank"], r["id"], r["score"]) for r in df.collect())
    assert rows(vector.search_texts(docs, q, EMBEDDER.counts, 3)) == rows(want)
    old = [np.bincount([_bucket(t[k:k + n], "md5") % 256 for n in (3, 4) for k in range(len(t) - n + 1)] or [0], minlength=256) for t in ("wörld 😀 tea",)]
    assert (EMBEDDER.counts(["wörld 😀 tea"]) == old).all()


def test_equal_questions_are_answered_once_for_all(spark):
    """F6, F8: each kind of question has one lead, and every question gets its answer."""
    q = spark.createDataFrame([("c", "x", None), ("a", "x", None), ("b", None, "1"), ("d", None, "1"), ("e", "x", "1")], "qid string, question string, w string")
    lead, names = alike(q, "question", "w")
    assert sorted(r["qid"] for r in lead.collect()) == ["a", "b", "e"]
    answers = lead.selectExpr("qid", "concat('of ', qid) as t")
    assert sorted((r["qid"], r["t"]) for r in to_all(answers, names).collect()) == [("a", "of a"), ("b", "of b"), ("c", "of a"), ("d", "of b"), ("e", "of e")]


def test_most_words_in_common(spark):
    """the k that share most words, each once, empty ones between spaces included."""
    docs = spark.createDataFrame([(3, "A b  c"), (1, "b b b"), (2, "a b"), (4, None), (5, "z")], "doc_id bigint, text string")
    words = spark.createDataFrame([("q", w, 1) for w in ("a", "b", "")], "qid string, term string, weight int")
    got = [(r["doc_id"], r["score"]) for r in lexical.most_shared(docs, words, 3).orderBy("rank").collect()]
    assert got == [(3, 3.0), (2, 2.0), (1, 1.0)]
