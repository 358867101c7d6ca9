"""The second hop leaves out no name of the first one's facts."""

from palimpsest.operators import graph


def test_second_hop_of_all_names(spark):
    """before, names behind the twentieth by name were dropped."""
    links = spark.createDataFrame([("me", 1)] + [(f"n{i:02}", f) for i in range(30) for f in (1, 100 + i)], "name string, fact_id bigint")
    names = spark.createDataFrame([("q", "me")], "qid string, name string")
    two = graph.hop_two(names, links, graph.hop_one(names, links), entities=None)
    assert sorted(r["fact_id"] for r in two.collect()) == list(range(100, 130))
    said = spark.createDataFrame([("q", "a " + " ".join(f"w{i}x" for i in range(12)))], "qid string, question string")
    names = spark.createDataFrame([(f"w{i}x",) for i in range(12)], "name string")
    assert graph.contained(said, names, None).count() == 12
