import itertools

import numpy as np
import pytest

from palimpsest.llm import pii

ROWS = [
    ("My neighbour Leila Finfites has the spare key.", {("name", "Leila Finfites")}), ("Put Fisbamuck, Michael on the guest list, plus one.", {("name", "Fisbamuck, Michael")}),
    ("please ask Dr. E. Jurbobo about the results", {("name", "E. Jurbobo")}), ("It was Rick Tenrelim's idea to go by boat.", {("name", "Rick Tenrelim")}),
    ("The invite went to <viggo+memo [at] home.example.org>.", {("email", "viggo+memo [at] home.example.org")}), ("contact: lhelrumol at example dot com What now", {("email", "lhelrumol at example dot com")}),
    ("they rang twice (+1 212 555 0108) before noon", {("phone", "+1 212 555 0108")}), ("Is (212) 555-0132 still the plumber?", {("phone", "(212) 555-0132")}),
    ("My tax number is 0111 2337 1576, keep it with the papers.", {("id_number", "0111 2337 1576")}), ("Use QQ 96 39 70 B as the citizen number", {("id_number", "QQ 96 39 70 B")}),
    ("Ticket 000123-45 is still open.", set()), ("The serial is 88-QX-4471-0020-3.", set()), ("Lake Juniper froze on the 12th.", set()), ("I ran 1632 metres in 7946 steps.", set()),
    ("The key is kept at 196 Station Ln,\nMarrowgate 53529.", {("address", "196 Station Ln,\nMarrowgate 53529")}), ("address: Flat 29, 197 St. Orrin Ln, Altenfurt It seems", {("address", "Flat 29, 197 St. Orrin Ln, Altenfurt")}),
    ("Is Canalweg 8, 71866 Lindhaven far from the station?", {("address", "Canalweg 8, 71866 Lindhaven")}), ("Jasvabol Software likes the fog.", set()), ("", set()),
]


@pytest.fixture(scope="module")
def learnt(spark):
    # persons and organisations are known from the tables alone, so the tables name those of the texts
    names = ["leila finfites", "kofi ralgara", "uma polmorith", "jasvabol software", "heinrich menziven", "vera pasdurur", "michael fisbamuck", "rick tenrelim", "emma jurbobo"]
    fill = [f"{a} {b} {c}." for a in ("I keep forgetting", "I finally sorted out", "Tell me about") for b in ("the fog", "the plum tree", "my notes") for c in ("today", "after lunch", "again")]
    texts = spark.createDataFrame([(t,) for t, _ in ROWS for _ in range(3)] + [(t,) for t in fill] + [(None,)], "text string")
    return pii.learn(texts, spark.createDataFrame([(n,) for n in names] + [(None,)], "name string"), spark.createDataFrame([("Altenfurt",), ("Altenfurt",), ("Marrowgate",), ("Marrowgate",), ("Lindhaven",), ("Lindhaven",)], "town string"),
                     spark.createDataFrame([("Jasvabol Software",), ("Pebra Software",), (None,)], "organisation string"))


@pytest.mark.parametrize(("text", "want"), ROWS)
def test_spans(learnt, text, want):
    got = pii.spans(*learnt, [text])[0]
    assert {(k, text[s:e]) for s, e, k in got} == want


def test_rows_and_placeholders(spark, learnt):
    df = spark.createDataFrame([("f", 1, "Call me on 512.555.0185 after six, 512.555.0185.", "x"), ("f", 2, None, "x"), ("f", 3, "no details " * 20_000, "x")], "field string, row_id bigint, text string, kind string")
    got = pii.find(df, *learnt).collect()
    assert [(r["row_id"], r["kind"], r["value"]) for r in got] == [(1, "phone", "512.555.0185")]
    red = {r["row_id"]: r["text"] for r in pii.redact(df, *learnt).collect()}
    assert red[1] == "Call me on [PHONE] after six, [PHONE]."
    assert red[2] is None
    assert pii.find(df.filter("false"), *learnt).count() == 0


def test_decoding_uses_the_field_alone(spark, learnt):
    know, model = learnt
    text = "My neighbour Leila Finfites has the spare key."
    outside = 0 * model.weights
    outside[:, 0] = 1.0
    assert pii.spans(know, model, [text])[0]
    assert not pii.spans(know, pii.Model(outside, model.chain, model.skip), [text])[0]  # no pattern finds what the weights do not


def test_skip_edges_join_repeated_rare_words():
    t = pii.Reader(pii.Knowledge()).read(["call 5550147 or write to Finfites, I mean the Finfites of 5550147", "Finfites"])
    joined = {tuple(sorted(t.joined[t.start[i]:t.end[i]] for i in e)) for e in pii.skip_edges(t)}
    assert ("Finfites", "Finfites") in joined
    assert ("5550147", "5550147") in joined
    assert all(t.doc[a] == t.doc[b] for a, b in pii.skip_edges(t))


def test_paths_and_marginals_like_brute_force():
    rng = np.random.default_rng(4)
    S = len(pii.STATES)
    first = np.array([0, 3, 3, 5])
    unary, chain = rng.normal(size=(5, S)), rng.normal(size=(S, S)) + pii._allowed()
    p, _ = pii._expect(unary, chain, first)
    got = pii.viterbi(unary, chain, first)
    for lo, hi in ((0, 3), (3, 5)):
        scores = {y: sum(unary[lo + i, s] for i, s in enumerate(y)) + sum(chain[a, b] for a, b in zip(y, y[1:])) + (pii.FORBIDDEN if y[0] in pii.INSIDE else 0) for y in itertools.product(range(S), repeat=hi - lo)}
        assert tuple(got[lo:hi]) == max(scores, key=scores.get)
        z = np.logaddexp.reduce(list(scores.values()))
        for i in range(hi - lo):
            for s in (0, 1, 2, 9):
                assert abs(p[lo + i, s] - sum(np.exp(v - z) for y, v in scores.items() if y[i] == s)) < 1e-6


def test_messages_are_exact_on_trees():
    rng = np.random.default_rng(2)
    unary = rng.normal(size=(4, 3))
    edges = np.array([[0, 1], [1, 2], [1, 3]])
    pot = rng.normal(size=(3, 3))
    total = np.zeros((4, 3))
    for y in itertools.product(range(3), repeat=4):
        w = np.exp(sum(unary[i, y[i]] for i in range(4)) + sum(pot[y[a], y[b]] for a, b in edges))
        for i in range(4):
            total[i, y[i]] += w
    got = pii.beliefs(unary, [(edges, pot)], rounds=60)
    got = np.exp(got - got.max(1, keepdims=True))
    assert np.allclose(got / got.sum(1, keepdims=True), total / total.sum(1, keepdims=True), atol=1e-4)


def test_skip_edges_make_labels_agree():
    sure, unsure = np.zeros((1, 6)), np.zeros((1, 6))
    sure[0, 5], unsure[0, 0] = 6.0, 0.5
    got = pii.beliefs(np.r_[sure, unsure], [(np.array([[0, 1]]), pii.AGREEMENT * np.eye(6))]).argmax(1)
    assert got.tolist() == [5, 5]
