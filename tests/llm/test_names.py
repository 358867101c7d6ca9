import pytest

from palimpsest.llm import names as nm


# what words_of() learns from tables that name these; the code has no lists of them
WORDS = nm.Words(frozenset(("samuel", "rebecca", "rajesh", "heinrich")), ("engineering", "motors", "insurance", "music", "school", "data", "systems", "software"), ("school music", "data systems"))


@pytest.mark.parametrize(("name", "want"), [
    ("hiltukus, j.", ("person", "hiltukus", "j")), ("dr. samuel dilgivam", ("person", "dilgivam", "samuel")), ("rebeccajulgusom", ("person", "julgusom", "rebecca")),
    ("rajesh k. tarsubur", ("person", "tarsubur", "rajesh")), ("tarsbir rajesh", ("person", "tarsbir", "rajesh")), ("heinrich mènziven", ("person", "menziven", "heinrich")),
    ("toldorom school of music", ("organisation", "toldorom", "music school")), ("vamtevock eng.", ("organisation", "vamtevock", "engineering")), ("the nusleno mtrs", ("organisation", "nusleno", "motors")),
    ("findivoth llc", ("organisation", "findivoth", "")), ("motors, zonminu", ("organisation", "zonminu", "motors")), ("tinsudul d.s.", ("organisation", "tinsudul", "data systems")),
    ("visnumulinsurance", ("organisation", "visnumul", "insurance")),
])
def test_reading(name, want):
    assert nm.read(name, WORDS)[:3] == want


def test_edits():
    assert nm.edits("tarsubur", "tarsubir") == 1
    assert nm.edits("ab", "ba") == 1
    assert nm.edits("kitten", "sitting", 3) == 3
    assert nm.edits("abcdef", "uvwxyz", 2) == 3


def test_links(spark):
    rows = ["anthony kalgonur", "Tony  Kalgonur", "kalgonur, a.", "anthony kalgonir", "omar kalgonur", "vera polmorith", "v polmorith", "victoria polmorith", "jurpome software", "jurpome softw.", "jurpome",
            "jurpome press", "lesneter foods", "lesneter", "user", "", None]
    e = spark.createDataFrame([(n, i) for i, n in enumerate(rows)] + [("user", 1)], "name string, fact_id bigint")
    a = spark.createDataFrame([("pasgem clinic", "old mill trust"), (None, "x"), ("omar kalgonur", "omar kalgonur")], "alias string, canonical string")
    f = spark.createDataFrame([(1, "user", 1), (2, None, 1)], "id bigint, subject string, name bigint")
    got = {(r["name_a"], r["name_b"]) for r in nm.pairs(nm.same_entity(e, a, f, spark.createDataFrame([("Jurpome Software",), ("Pebra Press",), ("Lesneter Foods",), ("Pasgem Clinic",), (None,)], "organisation string"))).collect()}
    tony = {"anthony kalgonur", "tony kalgonur", "anthony kalgonir"}
    assert {(x, y) for x in tony for y in tony if x < y} <= got
    assert not any("omar kalgonur" in p for p in got)
    assert not any("v polmorith" in p for p in got)  # two persons fit
    assert ("jurpome softw.", "jurpome software") in got
    assert not any("jurpome" in p for p in got)  # two organisations fit
    assert ("lesneter", "lesneter foods") in got
    assert ("old mill trust", "pasgem clinic") in got
    assert not any("user" in p for p in got)


def test_empty(spark):
    e, a, f = (spark.createDataFrame([], s) for s in ("name string, fact_id bigint", "alias string, canonical string", "id bigint, subject string"))
    assert nm.same_entity(e, a, f).count() == 0


def test_gram_join_loses_no_pair(spark):
    words = ["tarsubir", "tarsubur", "tarsbir", "polmorith", "polmoriht", "kalgonur", "zissegen", "kirsokith", "kirsokit"]

    def grams(w):
        s = f"^{w}$"
        return {s[k:k + 2] for k in range(len(s) - 1)}

    want = {(a, b) for a in words for b in words if a < b and len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= nm.SIMILAR}
    got = {(r["a"], r["b"]) for r in nm._gram_pairs(spark.createDataFrame([(w,) for w in words], "t string")).collect()}
    assert got == want


def test_words_are_learnt_from_the_tables(spark):
    lasts = ["kalgonur", "polmorith", "tarsubur", "menziven", "dilgivam", "julgusom", "lemdumi", "fosgarun", "rorsenur"]
    rows = [f"{f} {x}" for f in ("anthony", "vera") for x in lasts] + ["antony kalgonur", "kalgonur anthony", "jurpome software", "jurpome softw.", "jurpome sw", "jurpome sofware"]
    n = spark.createDataFrame([(r,) for r in rows], "name string")
    o = spark.createDataFrame([(x,) for x in ("Jurpome Software", "Pebra Software", "Lesneter software", "Old School of Music", "New School of Music", "Big School of Music", None)], "organisation string")
    got = nm.words_of(n, o)
    assert got.first == {"anthony", "vera"}  # no slip, no last word in front, no organisation
    assert set(got.kinds) == {"software", "school", "music"}
    assert got.tails == ("school music",)


def test_short_forms_of_several_kinds():
    kinds = ("institute", "insurance", "software")
    assert nm.kind_of("ins", kinds) == "institute|insurance"
    assert nm.kind_similarity("institute|insurance", "insurance") > 0
    assert nm.kind_similarity("institute|insurance", "software") == 0
    assert nm.kind_of("sw", kinds) == "software"
