import itertools

from palimpsest.llm import names as nm


def test_every_accepted_pair_is_a_candidate(spark):
    words = ["patel", "paetl", "smith", "simth", "singh", "sinhg", "khan", "kahn", "polmorit", "plomroit", "polmxrxt", "aabbcc", "ababcc", "abc", "acb", "omar", "mar"]
    want = {(a, b) for a, b in itertools.permutations(words, 2) if a < b and nm.own_similarity(a, b) > 0}
    assert {("paetl", "patel"), ("kahn", "khan"), ("plomroit", "polmorit")} <= want
    assert {(r["a"], r["b"]) for r in nm._slip_pairs(spark.createDataFrame([(w,) for w in words], "t string")).collect()} == want


def test_transposed_surname_is_linked(spark):
    e = spark.createDataFrame([("anthony patel", 1), ("anthony paetl", 2)], "name string, fact_id bigint")
    a, f = spark.createDataFrame([], "alias string, canonical string"), spark.createDataFrame([], "id bigint, subject string")
    assert [(r["name_a"], r["name_b"]) for r in nm.pairs(nm.same_entity(e, a, f)).collect()] == [("anthony paetl", "anthony patel")]
