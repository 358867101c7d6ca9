import math

import numpy as np
import pytest

from palimpsest.llm import quality as ql

DOC = "doc_id bigint, text string, lang string, words string"
PROSE = "The notes of the week are in the store, and the search of them is fast. We read them after lunch. "


def docs(spark):
    rows = [(i, PROSE * (1 + i % 3), "en") for i in range(30)] + [(100 + i, "\n".join(f"- item {j} of {i}" for j in range(9)), "EN") for i in range(15)]
    rows += [(200 + i, "\n".join("a,b,c,%d" % (j * i) for j in range(9)), None) for i in range(15)] + [(300 + i, "xqz" * 60 + str(i) * 9, "xx") for i in range(15)]
    rows += [(900, None, None), (901, "", "en"), (902, " ​\n", "en"), (903, "word " * 60_000, "en")]
    return spark.createDataFrame([(*r, "clash") for r in rows], DOC)


def common(spark):
    return spark.createDataFrame([("en", w) for w in "the of and in is we are them".split()] + [("de", "und"), (None, "x")], "lang string, word string")


def test_statistics():
    s, lang = ql.describe("The cat, the dog.\nNo end here", {"en": frozenset({"the", "no"}), "de": frozenset({"der"})})
    got = dict(zip(ql.COLUMNS, s))
    assert lang == "en"
    assert got["words"] == 7
    assert got["punctuated_lines"] == 0.5
    assert got["common_share"] == round(3 / 7, 4)
    assert ql.describe(None, {}) == ql.describe("  \n", {})


def test_tails_like_brute_force(spark):
    stats = ql.statistics(docs(spark), common(spark)).cache()
    pdf = stats.filter("not blank").toPandas()
    got = ql.tails(stats).toPandas()
    assert len(got) == len(pdf) * len(ql.RANKED)
    for r in got.sample(60, random_state=1).itertuples():
        mine = pdf[pdf.lang_group == r.lang_group][r.stat]
        assert math.isclose(r.left, (mine <= r.value).mean(), abs_tol=1e-12)
        assert math.isclose(r.right, (mine >= r.value).mean(), abs_tol=1e-12)


def test_forms(spark):
    d = docs(spark)
    labels = [(i, "prose") for i in range(20)] + [(100 + i, "list") for i in range(10)] + [(200 + i, "table") for i in range(10)] + [(300 + i, "junk") for i in range(10)] + [(5000, "list"), (None, "list"), (1, "other")]
    got = {r["doc_id"]: r["form"] for r in ql.forms(ql.described(d, common(spark)), spark.createDataFrame(labels, "doc_id bigint, form string")).collect()}
    assert {got[i] for i in range(20, 30)} == {"prose"}
    assert {got[i] for i in range(110, 115)} == {"list"}
    assert {got[i] for i in range(210, 215)} == {"table"}
    assert {got[i] for i in range(310, 315)} == {"junk"}
    assert not {900, 901, 902} & set(got)
    assert 903 in got


def test_empty(spark):
    assert ql.scored(docs(spark).filter("false"), common(spark)).count() == 0


def test_ranks_of_the_grid_like_brute_force(spark):
    stats = ql.described(docs(spark), common(spark))
    got = ql.ranks(ql.level_counts(stats)).toPandas()
    pdf = stats.toPandas()
    for r in got.sample(80, random_state=3).itertuples():
        c = ql.COLUMNS[r.stat]
        x = pdf[pdf.lang_group == r.lang_group][c]
        steps = (40 * np.log2(1 + x)).apply(np.floor) if c in ql.COUNTS else (x * (5 if c in ql.LENGTHS else 1000)).round()
        steps = steps.clip(0, ql.LEVELS - 1)
        assert math.isclose(r.left, (steps <= r.value).mean(), abs_tol=1e-9)
        assert math.isclose(r.right, (steps >= r.value).mean(), abs_tol=1e-9)


def test_no_labels_no_forms(spark):
    stats = ql.described(docs(spark), common(spark))
    assert ql.forms(stats, spark.createDataFrame([(None, "list"), (1, "other")], "doc_id bigint, form string")).count() == 0


def test_too_many_languages_are_an_error(spark):
    many = spark.createDataFrame([(f"l{i}", "w") for i in range(ql.MAX_LANGUAGES)], "lang string, word string")
    with pytest.raises(ValueError, match="languages"):
        ql.statistics(docs(spark), many)
