"""Linking the spellings of one person or organisation.

1. Each spelling is read into parts: a person's first name (or initial) and
   surname, or an organisation's own word and its kind (``school of music``),
   without titles, legal forms and middle initials.
2. The distinctive parts (surnames, own words) are joined with each other where
   they share a word with letters left out, as many as step 3 accepts edits
   (a transposition is one), and by a
   prefix-filtered set-similarity join on their padded q-grams: of each token's
   grams, rarest first, only as many are indexed as any partner above the
   similarity must share one of.
3. Spellings meet where their distinctive parts are similar and their other
   parts could agree, and are verified by a soft weighted similarity: each part
   counts by its rarity (log of all spellings over those with it), and its
   similarity is that of an edit, a short form, an initial or an abbreviation.
4. Links between full spellings, links told by the alias table and links between
   a fact's subject and the similar name entered for the same fact give connected
   components. A spelling that lacks the first name or the kind joins a component
   only if no other fits it; if several do, it stays alone unless it is told.

Empty and null names are no spellings; repeated rows count once. Spellings equal
to one word only, such as roles (``user``), link only if told or by their own
word. A spelling of any length is read whole.

Scale: joins are equi-joins on grams, tokens and (token, initial) keys, so a
common surname is cut by first names; no pairs beyond these are formed. The
components are found by label propagation with pointer jumping on written
tables. Only first names and words of kinds, learnt from the tables, reach the driver.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import materialise
from palimpsest.sources.tables import spelling

Q, SIMILAR, ACCEPT = 2, 0.34, 0.72
MAX_FIRST, MAX_KINDS = 1_000_000, 20_000  # more of these words than any language has are an error
FRONT, TOLD, RARER = 3, 3, 8  # last words that a first name stands before; organisations that tell a kind; how much rarer a slip is than the name
LONG = 24  # letters; words beyond are joined by grams alone
# Short forms of first names and the names they stand for.
SHORT_FORMS = {k: frozenset(v.split("|")) for k, v in (x.split("=") for x in """
alex=alexander sasha=alexander xander=alexander sandy=alexander andy=andrew drew=andrew tony=anthony ben=benjamin benny=benjamin charlie=charlotte lottie=charlotte
chris=christopher|christine kit=christopher|katherine topher=christopher dan=daniel danny=daniel deb=deborah debbie=deborah debby=deborah dima=dmitri mitya=dmitri
ed=edward eddie=edward ned=edward ted=theodore|edward teddy=theodore|edward katya=ekaterina katia=ekaterina liz=elizabeth beth=elizabeth betty=elizabeth eliza=elizabeth lizzie=elizabeth libby=elizabeth
fran=francesca|francisco frankie=francesca|francisco franny=francesca paco=francisco pancho=francisco cisco=francisco fritz=friedrich fred=friedrich gabi=gabriela gaby=gabriela
lupe=guadalupe lupita=guadalupe heinz=heinrich heiner=heinrich nacho=ignacio bella=isabella izzy=isabella isa=isabella jen=jennifer jenny=jennifer jenn=jennifer hans=johannes
jon=jonathan jonny=jonathan johnny=jonathan joe=joseph joey=joseph jo=joseph|johannes kate=katherine|ekaterina kathy=katherine katie=katherine leo=leonard len=leonard lenny=leonard
maggie=margaret meg=margaret peggy=margaret marge=margaret matt=matthew matty=matthew mike=michael mick=michael mickey=michael misha=mikhail nick=nicholas nicky=nicholas nico=nicholas
pat=patricia patty=patricia trish=patricia tricia=patricia pili=pilar priya=priyanka raj=rajesh becca=rebecca becky=rebecca bec=rebecca rick=richard dick=richard rich=richard richie=richard
bob=robert rob=robert bobby=robert robbie=robert sam=samuel sammy=samuel sid=siddharth steph=stephanie steffi=stephanie stevie=stephanie sue=susannah susie=susannah suzy=susannah
theo=theodore tom=thomas tommy=thomas vicky=victoria tori=victoria vic=victoria mina=wilhelmina willa=wilhelmina minnie=wilhelmina bill=william will=william billy=william willy=william
zach=zachary zack=zachary zac=zachary zee=zainab
""".split())}
# Titles, legal forms and small words.
TITLES = frozenset("dr mr mrs ms miss mx prof professor sir madam rev".split())
LEGAL = frozenset("inc gmbh llc ltd pvt co plc corp bv nv sa ag limited company corporation kg oy ab srl".split())
SMALL = frozenset("the of and & for de".split())
_FOLD = str.maketrans({"ø": "o", "ß": "ss", "ł": "l", "đ": "d", "æ": "ae", "œ": "oe", "ı": "i"})


def fold(s: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower().translate(_FOLD)) if not unicodedata.combining(c))


@lru_cache(maxsize=200_000)
def edits(a: str, b: str, most: int = 3) -> int:
    """Edits with transpositions between two words, or ``most`` + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, prev2[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        prev2, prev = prev, row
    return min(prev[-1], most + 1)


@dataclass(frozen=True)
class Words:
    """What the tables tell of names: first names, words of kinds of organisations, and kinds of several words."""

    first: frozenset = frozenset()
    kinds: tuple = ()
    tails: tuple = ()


@lru_cache(maxsize=100_000)
def kind_of(t: str, kinds: tuple) -> str | None:
    """The kind word that a token is, abbreviates or misspells; several that a short form may stand for are joined by ``|``."""
    if t in kinds:
        return t
    if len(t) < 2:
        return None
    bare = not set(t[1:]) & set("aeou")

    def skeleton(w: str) -> bool:
        it = iter(w)
        return t[0] == w[0] and (len(t) == 2 or t[-1] == w[-1]) and all(c in it for c in t)

    ways = [[w for w in kinds if w.startswith(t)]]
    if len(t) >= 4:
        ways.append([w for w in kinds if edits(t, w, 2) <= (2 if len(w) >= 7 else 1)])
    if bare and len(t) <= 8:
        ways.append([w for w in kinds if skeleton(w)])
    return next(("|".join(sorted(found)) for found in ways if found), None)


def read(name: str, words: Words) -> tuple[str, str, str, str]:
    """(``person`` or ``organisation``, distinctive part, other part, spelling without order and marks).

    The other part is a first name, an initial or the sorted kind words; it is
    empty where it is missing.
    """
    first_names, KINDS = words.first, words.kinds
    s = fold(name)
    if "," in s:
        a, _, b = s.partition(",")
        s = f"{b} {a}"
    s = re.sub(r"\b([a-z])\.(?=[a-z]\b\.?(?![a-z]))", r"\1", s)
    raw = [t for t in re.split(r"[^\w&']+|_", s) if t]
    tokens = [t for t in raw if t not in TITLES and t not in SMALL]
    legal = False
    while len(tokens) > 1 and tokens[-1] in LEGAL:
        legal = True
        tokens.pop()
    if not tokens:
        tokens = raw or [s.strip() or name]
    if len(tokens) == 1 and len(tokens[0]) >= 8:
        tokens = _unglue(tokens[0], words)
    known = [t for t in tokens if t in first_names or t in SHORT_FORMS]
    kinds = [kind_of(t, KINDS) for t in tokens]
    if len(tokens) > 1 and not known:
        found = [k for k in kinds[1:] if k]
        own = [t for t, k in zip(tokens[1:], kinds[1:]) if not k]
        if found and (len(tokens) > 2 or tokens[1] in KINDS or len(tokens[1]) > 1) and not (own and len(own) > 1):
            if not own or len("".join(own)) <= 2 or len(found) >= 1:
                return "organisation", tokens[0], " ".join(sorted(set(found))), " ".join(sorted(tokens))
        if kinds[0] and not kinds[-1] and tokens[0] in KINDS:
            return "organisation", tokens[-1], " ".join(sorted({k for k in kinds if k})), " ".join(sorted(tokens))
        if len(tokens) == 2 and len(tokens[1]) == 2 and not set(tokens[1]) & set("aeiou"):
            full = next((c for c in words.tails if "".join(w[0] for w in c.split()) == tokens[1]), None)
            if full:
                return "organisation", tokens[0], " ".join(sorted(full.split())), " ".join(sorted(tokens))
    if len(tokens) == 1 or legal:
        return "organisation", tokens[0], " ".join(sorted({k for k in kinds[1:] if k})), " ".join(sorted(tokens))
    long = [t for t in tokens if len(t) > 1]
    short = [t for t in tokens if len(t) == 1]
    if len(long) == 1:
        return "person", long[0], short[0] if short else "", " ".join(sorted(tokens))
    ends = [long[0], long[-1]]
    at = 0
    if ends[0] not in first_names and ends[0] not in SHORT_FORMS:
        if ends[1] in first_names or ends[1] in SHORT_FORMS:
            at = 1
        elif not _near(ends[0], first_names) and _near(ends[1], first_names):
            at = 1
    return "person", ends[1 - at], ends[at], " ".join(sorted(tokens))


@lru_cache(maxsize=100_000)
def _near(t: str, first_names: frozenset) -> bool:
    return len(t) >= 3 and any(edits(t, f, 1) <= 1 for f in first_names if abs(len(f) - len(t)) <= 1)


def _unglue(t: str, words: Words) -> list[str]:
    for c in sorted((*words.tails, *words.kinds), key=len, reverse=True):
        for tail in (c.replace(" ", ""), c.replace(" ", "of")):
            if t.endswith(tail) and len(t) - len(tail) >= 4:
                return [t[:-len(tail)], *c.split()]
    for n in range(min(12, len(t) - 4), 2, -1):
        if t[:n] in words.first:
            return [t[:n], t[n:]]
    return [t]


def _fulls(f: str) -> frozenset:
    return SHORT_FORMS.get(f, frozenset()) | {f}


def first_similarity(a: str, b: str, first_names: frozenset) -> float:
    """Similarity of two first names or initials; 0 if they cannot be one."""
    if not a or not b:
        return 0.8
    if a == b:
        return 1.0 if len(a) > 1 else 0.9
    if len(a) == 1 or len(b) == 1:
        one, other = (a, b) if len(a) == 1 else (b, a)
        return 0.9 if len(other) > 1 and any(f[0] == one for f in _fulls(other)) else 0.0
    if _fulls(a) & _fulls(b):
        return 0.95
    if (a in first_names or a in SHORT_FORMS) and (b in first_names or b in SHORT_FORMS):
        return 0.0
    best = 0.0
    for x in _fulls(a):
        for y in _fulls(b):
            n = edits(x, y, 2)
            if n <= (1 if min(len(x), len(y)) < 6 else 2):
                best = max(best, 1 - n / max(len(x), len(y)))
    return best


def kind_similarity(a: str, b: str) -> float:
    """Similarity of two sets of kind words; 0 if they name different kinds."""
    if not a or not b:
        return 0.8
    if a == b:
        return 1.0
    x, y = sorted(([set(k.split("|")) for k in o.split()] for o in (a, b)), key=len)
    if not all(any(k & other for other in y) for k in x):
        return 0.0
    return 0.95 if len(x) == len(y) else 0.9


def own_similarity(a: str, b: str) -> float:
    """Similarity of two surnames or own words by edits; 0 beyond what typing explains."""
    n, short = edits(a, b, 2), min(len(a), len(b))
    most = 0 if short < 4 else 1
    if short >= 6 and a[0] == b[0] and a[-1] == b[-1]:
        most = 2  # two slips, one in each spelling; another word seldom keeps both ends
    return 1 - n / max(len(a), len(b)) if n <= most else 0.0


def _gram_pairs(tokens: DataFrame, q: int = Q, least: float = SIMILAR) -> DataFrame:
    """``a, b``: pairs of distinct tokens, a < b, of which the q-gram sets have a Jaccard similarity of at least ``least``."""
    pad = F.concat(F.lit("^"), F.col("t"), F.lit("$"))
    grams = tokens.select("t", F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(pad) - (q - 1)), lambda i: F.substring(pad, i, q))).alias("g"))
    count = grams.select(F.explode("g").alias("x")).groupBy("x").count()
    each = grams.select("t", "g", F.explode("g").alias("x")).join(count, "x")
    ranked = each.groupBy("t").agg(F.first("g").alias("g"), F.array_sort(F.collect_list(F.struct("count", "x"))).alias("o"))
    n = F.size("o")
    keep = n - F.ceil(F.lit(least) * n).cast("int") + 1
    index = ranked.select("t", "g", F.explode(F.slice(F.col("o"), 1, keep)).alias("e")).select("t", "g", F.col("e.x").alias("x"))
    left, right = index.select(F.col("t").alias("a"), F.col("g").alias("ga"), "x"), index.select(F.col("t").alias("b"), F.col("g").alias("gb"), "x")
    sa, sb = F.size("ga"), F.size("gb")
    near = left.join(right, "x").filter((F.col("a") < F.col("b")) & (sa >= F.lit(least) * sb) & (sb >= F.lit(least) * sa))
    shared = F.size(F.array_intersect("ga", "gb"))
    return near.filter(shared >= F.lit(least) * (sa + sb - shared)).select("a", "b").distinct()


def _left_out(t: str) -> set[str]:
    """Keys of which any two words share one if ``own_similarity`` accepts them."""
    one = {t, *(t[:k] + t[k + 1:] for k in range(len(t)))} if len(t) > 3 else set()
    keys = {f"1{x}" for x in one}
    if len(t) > 5:  # two edits, between equal ends
        inner = t[1:-1]
        less = {inner[:k] + inner[k + 1:] for k in range(len(inner))}
        keys |= {f"2{t[0]}{t[-1]}{x}" for x in {inner} | less | {x[:k] + x[k + 1:] for x in less for k in range(len(x))}}
    return keys


def _slip_pairs(tokens: DataFrame) -> DataFrame:
    """``a, b``: pairs of distinct tokens of at most LONG letters, a < b, that ``own_similarity`` accepts."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(t, k) for t in pdf["t"] for k in _left_out(t)]
            if rows:
                yield pd.DataFrame(rows, columns=["t", "k"])

    def accepted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[own_similarity(a, b) > 0 for a, b in zip(pdf["a"], pdf["b"])]]

    each = tokens.filter(F.length("t") <= LONG).mapInPandas(keys, "t string, k string")
    both = each.select(F.col("t").alias("a"), "k").join(each.select(F.col("t").alias("b"), "k"), "k").filter("a < b").select("a", "b").distinct()
    return both.mapInPandas(accepted, "a string, b string")


def components(names: DataFrame, links: DataFrame) -> DataFrame:
    """``name, part``: the least name reachable by links (``a, b``), by propagation and pointer jumping."""
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = materialise(names.select("name", F.col("name").alias("part")))
    while True:
        near = both.join(state.withColumnRenamed("name", "b"), "b").groupBy("a").agg(F.min("part").alias("near"))
        new = state.join(near.withColumnRenamed("a", "name"), "name", "left").select("name", F.col("part").alias("old"), F.least("part", F.coalesce("near", "part")).alias("part"))
        jump = new.select(F.col("name").alias("part"), F.col("part").alias("root"))
        new = materialise(new.join(jump, "part", "left").select("name", "old", F.least("part", F.coalesce("root", "part")).alias("part")))
        changed = new.filter("part != old").limit(1).count()
        state = new.select("name", "part")
        if not changed:
            return state


def _without_slips(fronts: dict[str, int]) -> frozenset:
    """The first names that are not one edit from a much more frequent one."""
    near: dict[str, list[str]] = {}
    for w in fronts:
        for key in {w, *(w[:k] + w[k + 1:] for k in range(len(w)))}:
            near.setdefault(key, []).append(w)
    slips = {w for group in near.values() if len(group) > 1 for w in group for f in group if fronts[f] >= RARER * fronts[w] and edits(w, f, 1) == 1}
    return frozenset(fronts.keys() - slips)


def words_of(names: DataFrame, organisations: DataFrame) -> Words:
    """First names and kinds of organisations, counted over whole tables: ``name`` and ``organisation``.

    A kind is a word behind the first one of organisations' names. A first name stands before several different last words, and
    before more than twice as many as it stands behind; in a small table, before as many as any.
    """
    w = F.filter(F.split(F.lower("organisation"), r"[^\p{L}&']+"), lambda x: (x != "") & ~x.isin(*SMALL, *LEGAL))
    tails = organisations.select(F.slice(w, 2, 9).alias("t"), F.col("organisation")).filter("size(t) > 0").distinct()

    def told(df: DataFrame, most: int) -> list[str]:
        counted = df.groupBy("x").count()
        least = counted.agg(F.least(F.lit(TOLD), F.max("count")).alias("least"))
        got = counted.join(F.broadcast(least)).filter("count >= least").orderBy(F.desc("count"), "x").limit(most + 1).collect()
        if len(got) > most:
            raise ValueError(f"more than {most} words of kinds of organisations")
        return [r["x"] for r in got]

    kinds = told(tails.select(F.explode("t").alias("x")), MAX_KINDS)
    several = told(tails.filter("size(t) > 1").select(F.array_join("t", " ").alias("x")), MAX_KINDS)
    p = F.split("name", " ")
    two = names.filter((F.size(p) == 2) & ~F.col("name").contains(",")).select(p[0].alias("f"), p[1].alias("l")).filter("length(l) > 3")
    # the first word of an organisation stands before many short forms of its kind and is no first name
    owns = organisations.select(w[0].alias("f")).filter("f is not null").unionByName(two.filter(F.rtrim(F.lit("."), F.col("l")).isin(*kinds)).select("f") if kinds else two.filter("false").select("f"))
    two = two.join(owns.distinct(), "f", "left_anti")
    front = two.groupBy("f").agg(F.countDistinct("l").alias("n"))
    behind = two.groupBy(F.col("l").alias("f")).agg(F.countDistinct("f").alias("m"))
    some = front.join(behind, "f", "left").filter("f rlike '^[a-z]{3,20}$' and n > 2 * coalesce(m, 0)")
    least = some.agg(F.least(F.lit(FRONT), F.max("n")).alias("least"))
    got = some.join(F.broadcast(least)).filter("n >= least").limit(MAX_FIRST + 1).collect()
    if len(got) > MAX_FIRST:
        raise ValueError(f"more than {MAX_FIRST} first names")
    fronts = {r["f"]: r["n"] for r in got if r["f"] not in SMALL and r["f"] not in SHORT_FORMS and r["f"] not in TITLES and r["f"] not in kinds}
    return Words(_without_slips(fronts), tuple(kinds), tuple(several))


def link(names: DataFrame, told: DataFrame, together: DataFrame, organisations: DataFrame) -> DataFrame:
    """``name, part`` of each spelling; spellings of one part mean the same.

    names: ``name``; told: ``a, b`` from the alias table; together: ``a, b``, names
    entered for the same fact.
    """
    names = materialise(names.filter("name is not null and name != ''").distinct())
    words = words_of(names, organisations)
    known = words.first

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for n in pdf["name"]:
                kind, own, other, order = read(n, words)
                keys = ["*"] if kind == "organisation" else sorted({"i" + f[0] for f in _fulls(other)} | ({"e" + other[-3:]} if len(other) > 3 else set())) if other else ["i"]
                rows.append((n, kind, own, other, order, keys))
            yield pd.DataFrame(rows, columns=["name", "kind", "own", "other", "order", "keys"])

    read_names = materialise(names.mapInPandas(parts, "name string, kind string, own string, other string, order string, keys array<string>"))
    total = read_names.count()
    own = read_names.groupBy("kind", "own").count().select("kind", "own", F.log(F.lit(float(total + 1)) / F.col("count")).alias("weight"))
    other = read_names.groupBy("kind", "other").count().select("kind", "other", F.log(F.lit(float(total + 1)) / F.col("count")).alias("other_weight"))
    weighted = read_names.join(own, ["kind", "own"]).join(other, ["kind", "other"])
    tokens = read_names.select(F.col("own").alias("t")).distinct()
    near = materialise(_gram_pairs(tokens).unionByName(_slip_pairs(tokens)).distinct())  # read twice below
    same = read_names.select(F.col("own").alias("a"), F.col("own").alias("b")).distinct()
    near = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(same)
    side = weighted.select("name", "kind", "own", "other", "order", "weight", "other_weight", F.explode("keys").alias("key"))
    cols = ("name", "own", "other", "order", "weight", "other_weight")
    a = side.select("kind", "key", *[F.col(c).alias(f"{c}_a") for c in cols]).join(near.withColumnRenamed("a", "own_a"), "own_a")
    b = side.select("kind", "key", *[F.col(c).alias(f"{c}_b") for c in cols])
    pairs = a.join(b, (a.b == b.own_b) & (a.kind == b.kind) & (a.key == b.key)).filter("name_a < name_b").select(a.kind, *[f"{c}_{s}" for s in "ab" for c in cols]).dropDuplicates(["name_a", "name_b"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                person = r.kind == "person"
                x = own_similarity(r.own_a, r.own_b)
                y = first_similarity(r.other_a, r.other_b, known) if person else kind_similarity(r.other_a, r.other_b)
                if x <= 0 or y <= 0:
                    continue
                w, v = min(r.weight_a, r.weight_b), min(r.other_weight_a, r.other_weight_b)
                if (w * x + v * y) / (w + v) >= ACCEPT:
                    lacks = [len(o) < 2 for o in (r.other_a, r.other_b)]
                    out.append((r.name_a, r.name_b, *lacks))
            if out:
                yield pd.DataFrame(out, columns=["a", "b", "lacks_a", "lacks_b"])

    links = materialise(pairs.mapInPandas(verify, "a string, b string, lacks_a boolean, lacks_b boolean"))
    together = together.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct()
    seen = links.join(together, ["a", "b"], "left_semi").select("a", "b")
    sure = links.filter("not lacks_a and not lacks_b").select("a", "b").unionByName(told.filter("a != b").select("a", "b")).unionByName(seen).distinct()
    first = components(read_names, sure)

    # a spelling that lacks a part goes to the one component of full spellings that fits it
    half = links.filter("lacks_a != lacks_b").select(F.when(F.col("lacks_a"), F.col("a")).otherwise(F.col("b")).alias("name"), F.when(F.col("lacks_a"), F.col("b")).otherwise(F.col("a")).alias("full"))
    fits = half.join(first.select(F.col("name").alias("full"), "part"), "full").groupBy("name").agg(F.min("part").alias("part"), F.countDistinct("part").alias("n"))
    told_names = sure.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    joins = fits.filter("n = 1").join(told_names, "name", "left_anti").select("name", "part")
    # spellings that lack a part and fit no full one link with each other; those with the same words always do
    orphans = links.filter("lacks_a and lacks_b").join(fits.select(F.col("name").alias("a")), "a", "left_anti").join(fits.select(F.col("name").alias("b")), "b", "left_anti").select("a", "b")
    alike = read_names.select("name", "order").join(read_names.select(F.col("name").alias("b"), "order"), "order").filter("name < b").select(F.col("name").alias("a"), "b")
    more = joins.select(F.least("name", "part").alias("a"), F.greatest("name", "part").alias("b")).filter("a != b").unionByName(orphans).unionByName(alike)
    return components(read_names, sure.unionByName(more).distinct())


def spellings(entities: DataFrame, aliases: DataFrame, facts: DataFrame) -> DataFrame:
    """``name``: the distinct spellings of the four fields."""
    cols = [entities.select("name"), aliases.select(F.col("alias").alias("name")), aliases.select(F.col("canonical").alias("name")), facts.select(F.col("subject").alias("name"))]
    out = cols[0]
    for c in cols[1:]:
        out = out.unionByName(c)
    return out.select(spelling(F.col("name")).alias("name")).filter("name is not null and name != ''").distinct()


def same_entity(entities: DataFrame, aliases: DataFrame, facts: DataFrame, organisations: DataFrame | None = None) -> DataFrame:
    """``name, part`` of all spellings. facts: ``id, subject``; organisations: ``organisation``, full names from which their kinds are learnt."""
    told = aliases.select(spelling(F.col("alias")).alias("a"), spelling(F.col("canonical")).alias("b")).filter("a != '' and b != ''")
    subject = facts.select(F.col("id").alias("fact_id"), spelling(F.col("subject")).alias("a"))
    entered = entities.select("fact_id", spelling(F.col("name")).alias("b"))
    together = subject.join(entered, "fact_id").filter("a != b").select("a", "b").distinct()
    organisations = entities.sparkSession.createDataFrame([], "organisation string") if organisations is None else organisations
    return link(spellings(entities, aliases, facts), told, together, organisations)


def pairs(parts: DataFrame) -> DataFrame:
    """``name_a, name_b``: all pairs of spellings of one part, the smaller first."""
    a = parts.select("part", F.col("name").alias("name_a"))
    return a.join(parts.select("part", F.col("name").alias("name_b")), "part").filter("name_a < name_b").select("name_a", "name_b")
