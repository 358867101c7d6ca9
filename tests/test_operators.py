from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import phrases
from palimpsest.operators import bitemporal, evaluation, fusion, graph, lexical, lifecycle, packing, vector
from palimpsest.operators.sampling import hashed_sample
from palimpsest.sources import exchange

MONDAY = date(2023, 5, 8)


@pytest.mark.parametrize(("text", "want"), [
    ("we met yesterday", "2023-05-07"), ("the day before yesterday", "2023-05-06"), ("last week was hard", "2023-05-01..2023-05-07"), ("two weeks ago", "2023-04-24..2023-04-30"),
    ("a couple of days ago", "2023-05-06"), ("two weekends ago", "2023-04-29..2023-04-30"), ("next friday", "2023-05-12"), ("last monday", "2023-05-01"), ("this year", "2023"),
    ("last month", "2023-04"), ("in 3 months", "2023-08"), ("last winter", "2022-12-01..2023-02-28"), ("last weekend", "2023-05-06..2023-05-07"), ("on Friday", None), ("recently", None),
])
def test_phrases(text, want):
    got = phrases.mentions(text, MONDAY)
    assert (phrases.label(*got[0][2:]) if got else None) == want


def test_annotate_and_window():
    assert phrases.annotate("I went yesterday and last month", MONDAY) == "I went yesterday [2023-05-07] and last month [2023-04]"
    assert phrases.query_window("what happened in the past two months?", MONDAY) == (date(2023, 3, 7), MONDAY)
    assert phrases.query_window("in March", MONDAY) == (date(2023, 3, 1), date(2023, 3, 31))
    assert phrases.query_window("on 8 May 2022", MONDAY) == (date(2022, 5, 8), date(2022, 5, 8))
    assert phrases.query_window(None, MONDAY) is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab. \n", max_size=600), st.sampled_from(["s1", "s2", None])), max_size=12), st.integers(300, 1500))
def test_packed_turns_fit(turns, chars):
    hits = [{"id": i, "session_id": s, "role": "user", "ts": "2024-01-01", "content": c, "score": 1.0 - i / 20} for i, (c, s) in enumerate(turns)]
    kept = packing.pack_turns(hits, "ab", packing.Budget(chars=chars))
    assert sum(len(line) for _, line in kept) <= chars
    assert len({i for i, _ in kept}) == len(kept)


def test_excerpt_keeps_what_the_query_asks():
    text = "Opening line here. " + "Filler sentence number one. " * 20 + "The violin is in the attic. " + "More filler again. " * 20
    got = packing.excerpt(text, "where is my violin?", 120)
    assert "violin" in got
    assert len(got) <= 130


def test_rankings(spark):
    docs = spark.createDataFrame([(1, "red apple tree"), (2, "green apple"), (3, None), (4, ""), (5, "apple apple pie")], "doc_id bigint, text string")
    terms = spark.createDataFrame([("q", "apple", 1), ("q", "pie", 1), ("none", "zebra", 1)], "qid string, term string, weight bigint")
    some, every = lexical.bm25(docs, terms, 2), lexical.bm25(docs, terms, None)
    assert [r["doc_id"] for r in some.orderBy("rank").collect()] == [5, 1]  # a word in most texts counts next to nothing, so the id decides
    assert every.count() == 3
    assert lexical.bm25(docs.filter("false"), terms, 2).count() == 0


def test_vector_search_matches_the_plain_form(spark):
    rows = spark.createDataFrame([(i, [float(i % 7 - 3), float(i % 5), 1.0]) for i in range(40)] + [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0])], "id bigint, v array<float>")
    q = rows.filter("id in (3, 8)").select(F.col("id").alias("qid"), "v")
    got = {(r["qid"], r["rank"]): r["id"] for r in vector.search(rows, q, 5).collect()}
    for i in (3, 8):
        a = rows.filter(f"id = {i}").select("v").first()["v"]
        plain = rows.filter("size(v) = 3 and id != 101").filter(f"id != {i}").select("id", F.round(vector.cosine(F.array(*[F.lit(x) for x in a]), F.col("v")), 6).alias("s")).orderBy(F.desc("s"), "id").limit(5)
        assert [got[i, k] for k in range(1, 6)] == [r["id"] for r in plain.collect()]


def test_late_middle_fact_world_and_known(spark):
    rows = [(1, "a lives x", "a", "lives_in", "x", "profile", None, "2024-01-02", "2024-01-01", "2024-03-01", 3, None, None, ""),
            (2, "a lives z", "a", "lives_in", "z", "profile", None, "2024-07-02", "2024-06-01", None, None, None, None, ""),
            (3, "a lives y", "a", "lives_in", "y", "profile", None, "2024-08-02", "2024-03-01", "2024-06-01", 2, None, None, "")]
    f = spark.createDataFrame(rows, "id bigint, statement string, subject string, predicate string, object string, kind string, event_date string, ingested_at string, valid_from string, invalid_at string, superseded_by bigint, episode_id bigint, session_id string, scope string")
    chain = {r["id"]: r["chain_superseded_by"] for r in bitemporal.supersession(f).collect()}
    assert chain == {1: 3, 3: 2, 2: None}
    now = lambda w, k: sorted(r["object"] for r in bitemporal.as_of(f, w, k).collect())
    assert now("2024-04-01", "2024-07-15") == ["x"]  # y was not known yet
    assert now("2024-04-01", "2024-09-01") == ["y"]


def test_session_diversity(spark):
    r = spark.createDataFrame([("q", i, s, i) for i, s in enumerate(["a", "a", "b", "a", "c", "d"], 1)], "qid string, id bigint, session_id string, rank bigint")
    assert sorted(x["id"] for x in fusion.session_diverse(r, 3).collect()) == [1, 3, 5]


def test_lineage_on_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    got = {(r["child"], r["parent"]): r["depth"] for r in graph.lineage_closure(e).collect()}
    assert got["a", "b"] == 1
    assert got["a", "c"] == 2
    assert got["a", "a"] == 3
    e.createOrReplaceTempView("test_edges")
    assert {(r["child"], r["parent"]): r["depth"] for r in graph.recursive_closure(spark, "test_edges").collect()} == got


def test_chain_verification(spark):
    rows = spark.createDataFrame([("c", i, f"body {i}") for i in range(1, 8)], "chain string, at bigint, body string")
    sealed = lifecycle.seal(rows, "chain", "at", "body")
    bad = lambda df: df.select("violations").first()[0]
    assert bad(lifecycle.violations(sealed, "chain")) == 0
    assert bad(lifecycle.violations(sealed.withColumn("body", F.when(F.col("at") == 3, "x").otherwise(F.col("body"))), "chain")) == 1
    assert bad(lifecycle.violations(sealed.filter("at != 4"), "chain")) > 0


def test_metrics(spark):
    x = spark.createDataFrame([("g", 1.0, True), ("g", 2.0, False), ("g", 2.0, True), ("g", 3.0, True)], "g string, s double, y boolean")
    assert evaluation.auc(x, "g", "s", F.col("y")).first()["auc"] == pytest.approx(0.5)
    m = spark.createDataFrame([(True, False)] * 8 + [(False, True)] * 2, "a boolean, b boolean")
    assert evaluation.mcnemar(m, F.col("a"), F.col("b")).first()["p"] == pytest.approx(0.109375)
    r = spark.createDataFrame([("q", 1, 2)], "qid string, id bigint, rank bigint")
    gold = spark.createDataFrame([("q", 1), ("q", 9), ("w", 3)], "qid string, id bigint")
    got = {x["qid"]: x for x in evaluation.recall(r, gold, (1, 3)).collect()}
    assert got["q"]["recall_3"] == 0.5
    assert got["q"]["mrr"] == 0.5
    assert got["w"]["mrr"] == 0.0


def test_sample_is_bounded_and_stable(spark):
    df = spark.range(5000)
    a = sorted(r["id"] for r in hashed_sample(df, 100, "id").collect())
    assert a == sorted(r["id"] for r in hashed_sample(df.repartition(7), 100, "id").collect())
    assert len(a) == 100


def test_json_and_packs(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.1, -2.5]), (2, None)], "id bigint, emb array<float>")
    exchange.export_json(df, f"{tmp_path}/j")
    assert sorted(map(str, exchange.import_json(spark, f"{tmp_path}/j", df.schema).collect())) == sorted(map(str, df.collect()))
    exchange.build_pack({"t": df}, f"{tmp_path}/p", "n", "team", expires_at="2030-01-01", secret=b"k")
    assert exchange.open_pack(spark, f"{tmp_path}/p", b"k", now="2025-01-01")["t"].count() == 2
    with pytest.raises(ValueError, match="signature"):
        exchange.open_pack(spark, f"{tmp_path}/p", b"other", now="2025-01-01")
    with pytest.raises(ValueError, match="expired"):
        exchange.open_pack(spark, f"{tmp_path}/p", b"k", now="2031-01-01")


def test_public_formats(spark):
    import json

    loco = {"sample_id": "s", "conversation": {"session_1": [{"speaker": "Ann", "text": "Hi", "dia_id": "D1:1"}, {"speaker": "Bob", "text": "Yo", "dia_id": "D1:2", "blip_caption": "a cat"}], "session_1_date_time": "1:56 pm on 8 May, 2023"}, "qa": [{"question": "Who?", "answer": "Ann", "category": 1, "evidence": ["D1:1; D1:2"]}]}
    turns, qa = exchange.locomo(spark.createDataFrame([(json.dumps(loco),)], "value string"))
    assert [r["content"] for r in turns.orderBy("turn").collect()] == ["Ann: Hi", "Bob: Yo [shares a cat]"]
    assert qa.first()["evidence"] == ["D1:1", "D1:2"]
    item = {"question_id": "q", "haystack_dates": ["d"], "haystack_session_ids": ["s"], "haystack_sessions": [[{"role": "user", "content": "x"}]], "answer_session_ids": ["s"]}
    turns, _ = exchange.long_memory(spark.createDataFrame([(json.dumps(item),)], "value string"))
    assert turns.count() == 1
    item["haystack_dates"] = []
    with pytest.raises(Exception, match="haystack"):
        exchange.long_memory(spark.createDataFrame([(json.dumps(item),)], "value string"))[1].collect()


def test_bm25_pages_and_blocks_do_not_matter(spark, monkeypatch):
    import random

    rnd = random.Random(6)
    words = ["apple", "pear", "plum", "fig", "date", "lime", "kiwi"]
    docs = spark.createDataFrame([(i, " ".join(rnd.choices(words, k=rnd.randrange(0, 9)))) for i in range(60)], "doc_id bigint, text string")
    terms = spark.createDataFrame([(f"q{i}", w, 1) for i in range(9) for w in rnd.sample(words, 3)], "qid string, term string, weight bigint")
    every = {(r["qid"], r["doc_id"]): r["score"] for r in lexical.bm25(docs, terms, None).collect()}
    monkeypatch.setattr(lexical, "PAGE", 7)
    monkeypatch.setattr(lexical, "QUERY_TERMS", 4)
    monkeypatch.setattr(lexical, "DOC_BLOCK", 16)
    best = lexical.bm25(docs, terms, 5).collect()
    for q in {r["qid"] for r in best}:
        want = sorted(((-s, d) for (x, d), s in every.items() if x == q))[:5]
        assert [(-r["score"], r["doc_id"]) for r in sorted((r for r in best if r["qid"] == q), key=lambda r: r["rank"])] == want


def test_fact_block_keeps_to_its_share(spark):
    q = spark.createDataFrame([("q", "how many?"), ("none", "what?")], "qid string, question string")
    rows = [("q", "fact", f"fact number {i}", "" if i % 2 else "home", "2024-01-02", None if i % 3 else "2024-05-06", i) for i in range(40)] + [("q", "observation", "an overview", "", None, None, 0)]
    facts = spark.createDataFrame(rows, "qid string, kind string, text string, scope string, valid_from string, invalid_at string, rank bigint")
    budget = packing.Budget(chars=2000)
    head = {r["qid"]: r["head"] for r in packing.fact_block(facts, q, budget, F.col("question").contains("many"), F.lit(MONDAY)).collect()}
    block = head["q"][head["q"].index("KNOWN FACTS"):]
    assert len(block) <= 0.35 * budget.chars
    assert head["q"].startswith("(Current date: 2023-05-08 Mon)\nCOUNTING")
    assert "- an overview" in head["q"]
    assert "CURRENT" in block
    assert "SUPERSEDED on 2024-05-06" not in block  # current ones first, and they fill the share
    assert head["none"] == "(Current date: 2023-05-08 Mon)"


def test_packed_neighbours_and_ranked_head():
    turn = lambda i, text: {"id": i, "session_id": "s", "role": "user", "ts": "2024-01-01", "content": text}
    hits = [{**turn(5, "the violin is in the attic"), "score": 1.0, "near": [turn(4, "where is it?"), turn(6, "thanks")]}]
    assert [i for i, _ in packing.pack_turns(hits, "violin", packing.Budget())] == [5, 4, 6]
    assert [i for i, _ in packing.pack_turns(hits, "violin", packing.Budget(chars=300))] == [5]
