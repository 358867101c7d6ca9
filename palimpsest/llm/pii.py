"""Personal details in free text, found by a skip-chain conditional random field.

Every token of a text (word, run of digits or single mark) is a node, whose label
says whether it begins or goes on a detail of one of five kinds, or is outside
(``O``).  Node potentials weigh the token's shape, letters and digits, the words
around it and how often it stands as a person's first or last word, as a town's,
as an organisation's own word or another of its words, and as an ordinary word in the tables.  Chain edges
join neighbouring tokens; skip edges join distant tokens of one text that repeat a
rare word or a number, or nearly so.  Texts without skip edges are decoded
exactly; in the others loopy messages run along both kinds of edges until the
labels of the text agree.  Nothing but the field decides.

Training: a bounded sample (MAX_TRAIN texts by hash, up to three fifths of them texts
with longer numbers or marks of addresses and mails) is labelled by ``Teacher``: names are pairs of
words that the tables know as a person; formats of mails, numbers and addresses are
patterns with cue words.  Tokens of which the teacher is unsure take the label that the field itself gives them so far.
The teacher is not asked when texts are decoded. Of a fifth of the words the field
does not see in training how the tables know them, so that it learns to do without.

Word counts cover all rows of the tables given. They reach the executors as a table of fixed size
(SLOTS hashed words), so that no word is cut off as the tables grow; two words
of one slot share the larger count.

Null and blank texts have no details. Whole texts are read, however long. A value
that stands several times in a row comes out once. Columns beside the named ones
are not read. Without any labelled detail nothing is found.

Scale: no shuffle of texts; a task streams Arrow batches and decodes about
TOKENS tokens at once. Only the sample, the word table and the weights reach the driver.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.sampling import hashed_sample
from palimpsest.session import materialise

LABELS = ("O", "email", "phone", "id_number", "address", "name")
STATES = ("O", *(f"{b}-{k}" for k in LABELS[1:] for b in "BI"))
KIND = np.array([0, *(k for k in range(1, len(LABELS)) for _ in "BI")])  # of each state
BEGIN, INSIDE = np.arange(1, len(STATES), 2), np.arange(2, len(STATES), 2)
MAX_TRAIN, SLOTS, WEIGHTS, TOKENS = 20_000, 1 << 20, 1 << 17, 200_000
ROUNDS, EPOCHS = 16, 6
AGREEMENT = 1.0
FORBIDDEN = -30.0
PLACEHOLDER = {k: f"[{k.upper()}]" for k in LABELS[1:]}
COUNTED = ("first", "last", "town", "organisation", "ordinary", "own")

# Forms of address, and words of streets.
TITLES = frozenset("dr mr mrs ms miss mx prof professor sir madam rev herr frau señor señora mme".split())
STREET = r"(?:street|st|road|rd|lane|ln|avenue|ave|boulevard|blvd|close|terrace|drive|dr|court|ct|way|place|pl|square|sq|row|crescent|gardens|grove|walk|mews|parade|highway|hwy|alley|rise|view)\b\.?"
UNIT = r"(?:flat|apt|apartment|unit|suite|room|no)\.?\s#?\w{1,6}"

EMAIL = re.compile(
    r"(?<![\w.+-])[^\W_](?:[\w.+-]*[\w+-])?(?:\s?@\s?|\s?[\[({]\s?at\s?[\])}]\s?)[\w-]+(?:(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)[\w-]+)+"
    r"|(?<![\w.+-])[^\W_](?:[\w.+-]*[\w+-])?\sat\s[\w-]+(?:\sdot\s[\w-]+)+", re.IGNORECASE)
NUMBER = re.compile(
    r"(?<![\w@.+/-])(?:"
    r"(?P<intl>\+\d{1,3}(?:[\s.-]?\(?\d{1,4}\)?){2,5})"
    r"|(?P<us>\(\d{3}\)\s?\d{3}[-.\s]\d{4}|\d{3}(?P<s>[-. ])\d{3}(?P=s)\d{4})"
    r"|(?P<uk>0\d{2}\s\d{4}\s\d{4}|0\d{4}\s\d{6}|0\d{3}\s\d{3}\s\d{4}|0\d{10}|0\d{9})"
    r"|(?P<ssn>\d{3}(?P<t>[- ])\d{2}(?P=t)\d{4})"
    r"|(?P<ni>[a-z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[a-d])"
    r"|(?P<quads>\d{4}(?P<u>[- ])\d{4}(?P=u)\d{4}(?:(?P=u)\d{4})?)"
    r"|(?P<twelve>\d{12})"
    r"|(?P<letter>[a-z]{1,2}\d{7,9}[a-z]?)"
    r"|(?P<other>[a-z]{0,3}-?\d[\d/-]*(?:[-. /]\d+)*\d{2}(?:-\d+)?)"
    r")(?![\w@]|-\w|\.\d)", re.IGNORECASE)
ADDRESS = re.compile(
    rf"(?<![\w-])(?:(?:{UNIT},?\s)?\d{{1,5}}(?:\s?[a-z])?,?\s(?:st\.\s)?(?:[^\W\d_][\w'’-]*\s){{1,4}}?{STREET}(?:,?\s{UNIT})?,?\s+"
    rf"|[^\W\d_][\w.-]*(?:weg|stra(?:ss|ß)e|str\.|platz|gasse|allee|damm|ufer)\s\d{{1,4}}\s?[a-z]?,\s+(?:\d{{4,5}}\s)?"
    rf"|\d{{1,4}}(?:\s(?:bis|ter))?,?\s(?:rue|avenue|boulevard|place|quai)\s[\w'’-]+(?:\s[\w'’-]+){{0,4}}\s?,\s+(?:\d{{5}}\s)?"
    rf"|(?:calle|avenida|plaza|via|rua)\s(?:[\w'’-]+\s){{1,4}}\d{{1,4}},\s+(?:\d{{4,5}}\s)?)", re.IGNORECASE)
POSTCODE = re.compile(r",?\s(?:\d{5,6}(?:-\d{4})?|[A-Z]{1,2}\d[A-Z\d]?\s\d[A-Z]{2})\b", re.IGNORECASE)
WORD = re.compile(r"[^\W\d_]+(?:['’](?!s\b|S\b)[^\W\d_]+)*")
TOKEN = re.compile(rf"{WORD.pattern}|\d+|[^\w\s]|_")
# How numbers are written (# a digit, @ a letter).
WRITTEN = {
    "phone": ("+# ### ### ####", "+## #### ######", "+###########", "(###) ###-####", "###-###-####", "###.###.####", "0## #### ####", "0#### ######", "0##########"),
    "id_number": ("###-##-####", "### ## ####", "@@ ## ## ## @", "#### #### ####", "############", "@########"),
}
VARIED = 400  # texts to which each kind is brought by writing its numbers in other ways
NUMBER_CUE = re.compile(r"\b(ticket|order|invoice|serial|batch|version|code|score[ds]?|meter|chapter|split|cost|ran)\b\W+(?:\w+\W+){0,3}$")
LASTS = 3  # last words that a first word stands before
COMMON = 6  # level of a word's share from which it counts as ordinary and is told apart by itself
SPREAD = 1 << 16  # a count's level is the logarithm of its share of so many


def slot(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "ignore")) % SLOTS


@dataclass
class Knowledge:
    """How often the tables know a word in each role, by hashed word, as levels from 0 (never)."""

    levels: np.ndarray = field(default_factory=lambda: np.zeros((1, len(COUNTED)), np.uint8))

    def of(self, word: str) -> np.ndarray:
        return self.levels[slot(word) % len(self.levels)]

    def knows(self, word: str, role: str) -> bool:
        return bool(self.of(word)[COUNTED.index(role)])

    def glued(self, word: str) -> bool:
        """A first and a last word of persons written as one."""
        return len(word) > 7 and not self.common(word) and any(self.knows(word[:k], "first") and self.knows(word[k:], "last") for k in range(3, len(word) - 3))

    def common(self, word: str) -> bool:
        """An ordinary word, not merely one that was typed in lower case now and then."""
        return bool(self.of(word)[COUNTED.index("ordinary")] >= COMMON)


def _case(w: str) -> str:
    return "U" if len(w) > 1 and w.isupper() else "C" if w[:1].isupper() else "l"


# ---- labels of the sample -----------------------------------------------------------------

@dataclass
class Node:
    """A span the teacher judges: ``weak`` is its label, None if the teacher is unsure."""

    start: int
    end: int
    shape: str
    weak: int | None


class Finder:
    """The teacher: labels of clear spans of a text of the sample."""

    def __init__(self, k: Knowledge, persons: frozenset = frozenset()):
        self.k, self.persons = k, persons

    def nodes(self, text: str) -> list[Node]:
        out: list[Node] = []

        def put(s: int, e: int, shape: str, weak: int | None) -> None:
            if all(e <= n.start or s >= n.end for n in out):
                out.append(Node(s, e, shape, weak))

        for m in EMAIL.finditer(text):
            put(*m.span(), "email", LABELS.index("email"))
        for m in ADDRESS.finditer(text):
            end = self._town(text, m.end())
            if end:
                put(m.start(), end, "address", LABELS.index("address"))
        for m in NUMBER.finditer(text):
            s, e = m.span()
            if m[0].count(")") > m[0].count("("):  # a bracket around the number, not in it
                e = s + len(m[0].rstrip(") "))
            shape = m.lastgroup if m.lastgroup not in ("s", "t", "u") else next(g for g in ("us", "ssn", "quads") if m[g])
            if sum(map(str.isdigit, m[0])) >= 5:
                other = shape == "other" or NUMBER_CUE.search(text[max(0, s - 40):s].lower())
                put(s, e, shape, 0 if other else LABELS.index("phone" if shape in ("intl", "us", "uk") else "id_number"))
        for known in (True, False):  # what looks like a name gives way to what is one
            for s, e, shape, weak in self._names(text, known):
                put(s, e, shape, weak)
        return sorted(out, key=lambda n: n.start)

    def _town(self, text: str, at: int) -> int | None:
        """The end of a town at a position, with a postcode after it; None without town."""
        ws = []
        for m in WORD.finditer(text, at, at + 60):
            if len(ws) == 2 or (ws and text[ws[-1].end():m.start()] != " ") or (not ws and m.start() != at):
                break
            ws.append(m)
        if not ws:
            return None
        known = [self.k.knows(m[0].lower(), "town") for m in ws]
        if len(ws) == 2 and all(known) and _case(ws[0][0]) == _case(ws[1][0]):
            end = ws[1].end()
        elif known[0] or (_case(ws[0][0]) != "l" and not self.k.common(ws[0][0].lower())):
            end = ws[0].end()
        else:
            return None
        m = POSTCODE.match(text, end)
        return m.end() if m else end

    def _names(self, text: str, known: bool) -> Iterator[tuple[int, int, str, int | None]]:
        """Pairs of words that the tables know as a person, or else pairs and initials that look so; unsure where only the look says so."""
        ws = [(m.start(), m.end(), m[0]) for m in WORD.finditer(text)]
        name, last = LABELS.index("name"), -1
        look = self._known if known else self._alike
        for i in range(len(ws)):
            got = look(text, ws, i, name) if i > last else None
            if got:
                j, end, shape, weak = got
                yield ws[i][0], end, shape, weak
                last = j

    def _known(self, text: str, ws: list, i: int, name: int):
        (_, e, raw), rest = ws[i], len(ws) - i - 1
        if _case(raw) != "l" and self.k.glued(raw.lower()) and not self.k.knows(raw.lower(), "last"):
            return i, e, "glued", name
        if rest > 1 and len(ws[i + 1][2]) == 1 and text[e:ws[i + 1][0]] == " " and text[ws[i + 1][1]:ws[i + 2][0]] in (". ", " ") and self.pair(raw, ws[i + 2][2]):
            return i + 2, ws[i + 2][1], "middle", name
        if not rest or not self.pair(raw, ws[i + 1][2]):
            return None
        j, gap = i + 1, text[e:ws[i + 1][0]]
        end = ws[j][1]
        if gap not in (" ", "  ", ", ", "_", ".", "-") or (gap == ", " and _case(raw) != _case(ws[j][2])):
            return None
        if gap == ", " and rest > 1 and len(ws[j + 1][2]) == 1 and text[end:ws[j + 1][0]] == " " and text[ws[j + 1][1]:ws[j + 1][1] + 1] == ".":
            j, end = j + 1, ws[j + 1][1] + 1
        return j, end, "known", name

    def _alike(self, text: str, ws: list, i: int, name: int):
        if i + 1 == len(ws):
            return None
        (_, e, raw), (s2, end, raw2) = ws[i], ws[i + 1]
        a, b, gap, k = raw.lower(), raw2.lower(), text[e:s2], self.k
        if len(a) == 1 and gap in (". ", " ") and _case(raw) == "C" and self._surname(b) and (gap == ". " or a not in ("a", "i")):
            return i + 1, end, "initial", name
        if len(b) == 1 and gap in (", ", " ") and self._surname(a) and (gap == ", " or b not in ("a", "i")):
            return i + 1, end + (text[end:end + 1] == "."), "initial", name
        if gap != " " or _case(raw) != _case(raw2):
            return None
        if k.knows(a, "first") and not k.common(a) and self._surname(b):
            return i + 1, end, "known words", name
        if not self._looks(raw) or not self._looks(raw2):
            return None
        org = k.knows(b, "organisation") or (k.knows(a, "own") and not k.knows(b, "last")) or (i + 2 < len(ws) and k.knows(ws[i + 2][2].lower(), "organisation"))
        return i + 1, end, "pair", 0 if org else name if self._surname(b) or (k.knows(a, "last") and k.knows(b, "first")) else None

    def _looks(self, w: str) -> bool:
        return _case(w) != "l" and len(w) > 2 and not self.k.common(w.lower()) and w.lower() not in TITLES

    def _surname(self, w: str) -> bool:
        return self.k.knows(w, "last") and not self.k.common(w) and not self.k.knows(w, "town") and not self.k.knows(w, "organisation")

    def pair(self, a: str, b: str) -> bool:
        a, b = a.lower(), b.lower()
        return (a, b) in self.persons or (b, a) in self.persons


# ---- tokens and features --------------------------------------------------------------------

ATTRIBUTES = ("word", "shape", "end2", "end3", "digits", "first", "last", "town", "organisation", "ordinary", "own", "side", "key")
A = {a: k for k, a in enumerate(ATTRIBUTES)}


def _attributes(token: str, k: Knowledge) -> list[int]:
    """Numbers that stand for what a token is, in the order of ATTRIBUTES."""
    low = token.lower()
    h = zlib.crc32(low.encode("utf-8", "ignore"))
    if token.isdigit():
        n = min(len(token), 13)
        return [0, 100 + n, 0, 0, h if n <= 3 else zlib.crc32(low[:2].encode()) + n, 0, 0, 0, 0, 0, 0, 0, zlib.crc32(low[-4:].encode()) | 1 if n >= 4 else 0]
    if not token[0].isalpha():
        return [h | 1, 200 + h % 5000, *[0] * (len(ATTRIBUTES) - 2)]
    first, last, town, organisation, ordinary, own = (int(x) for x in k.levels[h % SLOTS % len(k.levels)])
    case = {"l": 1, "C": 2, "U": 3}[_case(token)] if token[1:] == token[1:].lower() or token.isupper() else 4
    short = len(low) <= 2
    side = (15 if k.glued(low) else 0) if not first and not last else 1 + min(8, max(0, 4 + first - last))
    rare = ordinary < COMMON
    return [0 if rare and not short else h | 1, case * 4 + min(len(low), 4) - 1, zlib.crc32(low[-2:].encode("utf-8", "ignore")), zlib.crc32(low[-3:].encode("utf-8", "ignore")), 0,
            (first + 3) // 4, (last + 3) // 4, (town + 3) // 4, (organisation + 3) // 4, (ordinary + 1) // 2, (own + 3) // 4, side,
            zlib.crc32(low[:5].encode("utf-8", "ignore")) | 1 if rare and len(low) > 4 else 0]


# What the node potentials see: attributes at distances, joined.
TEMPLATES = (
    *((("shape", d),) for d in (-3, -2, -1, 0, 1, 2, 3)), *((("word", d),) for d in (-5, -4, -3, -2, -1, 0, 1, 2, 3)), *((("digits", d),) for d in (-2, -1, 0, 1, 2)),
    (("end2", 0),), (("end3", 0),), (("side", -1),), (("side", 0),), (("side", 1),), (("first", 0),), (("last", 0),), (("town", -1),), (("town", 0),), (("town", 1),),
    (("organisation", 0),), (("organisation", 1),), (("organisation", 2),), (("own", -1),), (("own", 0),), (("own", 0), ("side", 0)), (("own", -1), ("gap", 0), ("side", 0), ("shape", 0)), (("ordinary", -1),), (("ordinary", 0),), (("ordinary", 1),),
    (("shape", -1), ("gap", 0), ("shape", 0)), (("shape", 0), ("gap", 1), ("shape", 1)), (("shape", -2), ("shape", -1), ("gap", 0), ("shape", 0)), (("shape", 0), ("gap", 1), ("shape", 1), ("shape", 2)),
    (("gap", 0), ("shape", 0), ("gap", 1)), (("side", -1), ("gap", 0), ("side", 0), ("shape", 0)), (("side", 0), ("gap", 1), ("side", 1), ("shape", 0)), (("side", 0), ("ordinary", 0), ("shape", 0)),
    (("ordinary", 0), ("shape", 0), ("gap", 1), ("ordinary", 1), ("shape", 1)), (("ordinary", -1), ("shape", -1), ("gap", 0), ("ordinary", 0), ("shape", 0)), (("side", 0), ("organisation", 1)), (("word", -2), ("word", -1)),
    (("word", -1), ("gap", 0), ("shape", 0)), (("shape", 0), ("gap", 1), ("word", 1)), (("digits", 0), ("digits", 1), ("digits", 2)), (("digits", -1), ("digits", 0), ("shape", 1)), (("town", 0), ("gap", 1), ("town", 1)),
    (("word", -1), ("digits", 0)), (("word", -2), ("shape", 0)), (("word", -3), ("shape", 0)), (("word", -4), ("shape", 0)),
)


@dataclass
class Tokens:
    """Tokens of many texts: the joined text, spans in it, the number of each token's text, and where texts begin."""

    joined: str
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # token number at which each text begins, and the number of all tokens
    at: np.ndarray  # place of each text in the joined text
    attributes: np.ndarray
    gap: np.ndarray


class Reader:
    """Cuts texts into tokens and looks up their attributes; a kept word costs one look-up."""

    KEPT = 500_000

    def __init__(self, k: Knowledge):
        self.k = k
        self.number: dict[str, int] = {}
        self.rows: list[list[int]] = []
        self.table = np.zeros((0, len(ATTRIBUTES)), np.int64)

    def read(self, texts: list[str]) -> Tokens:
        joined = "\x1e".join(texts)
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        spans = np.array([m.span() for m in TOKEN.finditer(joined)], np.int64).reshape(-1, 2)
        start, end = spans[:, 0], spans[:, 1]
        if len(self.number) > self.KEPT:
            self.number, self.rows, self.table = {}, [], self.table[:0]
        number = self.number
        types = np.empty(len(start), np.int64)
        for i, (s, e) in enumerate(zip(start.tolist(), end.tolist())):
            t = joined[s:e]
            n = number.get(t)
            if n is None:
                n = number[t] = len(number)
                self.rows.append(_attributes(t, self.k))
            types[i] = n
        if self.rows:
            self.table = np.concatenate([self.table, np.array(self.rows, np.int64)])
            self.rows = []
        doc = np.searchsorted(at, start, side="right") - 1
        gap = np.full(len(start), 3)
        if len(start) > 1:
            chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            room = start[1:] - end[:-1]
            gap[1:] = np.where(doc[1:] != doc[:-1], 3, np.where(room == 0, 0, np.where((room == 1) & (chars[np.minimum(end[:-1], len(chars) - 1)] == 32), 1, 2)))
        return Tokens(joined, start, end, doc, np.searchsorted(doc, np.arange(len(texts) + 1)), at[:-1], self.table[types], gap)


def features(t: Tokens, attributes: np.ndarray | None = None) -> np.ndarray:
    """The weights' row of each token and template."""
    a = t.attributes if attributes is None else attributes
    n = len(a)
    out = np.empty((len(TEMPLATES), n), np.int32)
    far = max(abs(d) for parts in TEMPLATES for _, d in parts)
    padded = {name: np.r_[np.full(far, -1), (t.gap if name == "gap" else a[:, A[name]]), np.full(far, -1)] for name in {x for parts in TEMPLATES for x, _ in parts}}
    docs = np.r_[np.full(far, -1), t.doc, np.full(far, -2)]
    same = {d: docs[far + d:far + d + n] == t.doc for d in range(-far, far + 1)}
    for k, parts in enumerate(TEMPLATES):
        value = np.full(n, k * 0x9E3779B1 + 1, np.uint64)
        for name, d in parts:
            x = np.where(same[d], padded[name][far + d:far + d + n], -1).astype(np.uint64)
            value = (value ^ x) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        out[k] = (value % np.uint64(WEIGHTS)).astype(np.int32)
    return out


def skip_edges(t: Tokens) -> np.ndarray:
    """Pairs of tokens of one text, more than two apart, with one rare word or number, each with the next such one."""
    key = t.attributes[:, A["key"]]
    at = np.flatnonzero(key)
    if not len(at):
        return np.zeros((0, 2), np.int64)
    order = at[np.lexsort((at, key[at], t.doc[at]))]
    same = (t.doc[order[1:]] == t.doc[order[:-1]]) & (key[order[1:]] == key[order[:-1]]) & (order[1:] - order[:-1] > 2)
    return np.c_[order[:-1][same], order[1:][same]]


# ---- the field ------------------------------------------------------------------------------

def _allowed() -> np.ndarray:
    """0 where a state may follow another, FORBIDDEN where a detail would go on that has not begun."""
    out = np.zeros((len(STATES),) * 2)
    for k, i in enumerate(INSIDE):
        out[:, i] = FORBIDDEN
        out[[BEGIN[k], i], i] = 0.0
    return out


@dataclass
class Model:
    """Weights of the features, of state pairs on chain edges and of kinds on skip edges."""

    weights: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def unary(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((rows.shape[1], len(STATES)), np.float32)
        for r in rows:
            out += self.weights[r]
        return out


def _steps(first: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Begin of each text, longest first, and how many texts have a token at each step."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    left = np.sort(lengths)[::-1]
    return first[:-1][order], [int(np.searchsorted(-left, -t, side="left")) for t in range(int(left[0]) if len(left) else 0)]


def viterbi(unary: np.ndarray, chain: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best states of all texts at once, step by step over the texts long enough."""
    out = np.zeros(len(unary), np.int64)
    begin, active = _steps(first)
    score, links = None, []
    start = np.zeros(len(STATES))
    start[INSIDE] = FORBIDDEN
    for t, n in enumerate(active):
        u = unary[begin[:n] + t]
        if t == 0:
            score = u + start
            finals = np.zeros((n, len(STATES)))
        else:
            total = score[:n, :, None] + chain
            links.append(total.argmax(1).astype(np.int8))
            score = total.max(1) + u
        finals[:n] = score
    for t in range(len(active) - 1, -1, -1):
        n, later = active[t], active[t + 1] if t + 1 < len(active) else 0
        state = np.empty(n, np.int64)
        state[later:] = finals[later:n].argmax(1)
        if later:
            state[:later] = np.take_along_axis(links[t][:later], out[begin[:later] + t + 1][:, None], 1)[:, 0]
        out[begin[:n] + t] = state
    return out


def beliefs(unary: np.ndarray, edges: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS) -> np.ndarray:
    """Sum-product messages along all edges at once; log beliefs up to a constant per node.

    edges: groups of node pairs with their log potentials (symmetric in direction
    by transposition). Exact on trees, damped on loops.
    """
    src = np.concatenate([np.r_[e[:, 0], e[:, 1]] for e, _ in edges]) if edges else np.zeros(0, np.int64)
    if not len(src):
        return unary
    dst = np.concatenate([np.r_[e[:, 1], e[:, 0]] for e, _ in edges])
    cuts = np.cumsum([0] + [2 * len(e) for e, _ in edges])
    back = np.concatenate([o + np.r_[np.arange(len(e), 2 * len(e)), np.arange(len(e))] for (e, _), o in zip(edges, cuts)])
    pots = [(slice(o, o + len(e)), p) for (e, p), o in zip(edges, cuts)] + [(slice(o + len(e), o + 2 * len(e)), p.T) for (e, p), o in zip(edges, cuts)]
    msg = np.zeros((len(src), unary.shape[1]))
    for _ in range(rounds):
        total = unary.astype(float)
        np.add.at(total, dst, msg)
        out = total[src] - msg[back]
        top = out.max(1, keepdims=True)
        out = np.exp(out - top)
        new = np.empty_like(msg)
        for part, p in pots:  # a message is a row of weights times the exponentials of the potentials
            new[part] = out[part] @ np.exp(p)
        new = np.log(np.maximum(new, 1e-30))
        new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
        msg = 0.5 * msg + 0.5 * new
    total = unary.astype(float)
    np.add.at(total, dst, msg)
    return total


def decode(model: Model, t: Tokens, rounds: int = ROUNDS) -> np.ndarray:
    """The state of each token."""
    unary = model.unary(features(t)).astype(float)
    skip = skip_edges(t)
    if len(skip):
        docs = np.unique(t.doc[skip[:, 0]])
        inside = np.isin(t.doc, docs)
        place = np.cumsum(inside) - 1
        nodes = np.flatnonzero(inside)
        chain = np.c_[nodes[:-1], nodes[1:]][(np.diff(nodes) == 1) & (t.doc[nodes[1:]] == t.doc[nodes[:-1]])]
        got = beliefs(unary[inside], [(place[chain], model.chain), (place[skip], model.skip[np.ix_(KIND, KIND)])], rounds)
        unary[inside] = got - got.max(1, keepdims=True)
        best = np.zeros(len(unary), np.int64)
        # the messages have told each node what its neighbours say; the path only keeps details well formed
        one = np.r_[np.searchsorted(t.doc[nodes], docs), len(nodes)]
        best[inside] = viterbi(unary[inside], _allowed(), one)
        rest = ~inside
        kept = np.setdiff1d(np.arange(len(t.first) - 1), docs)
        at = np.flatnonzero(rest)
        best[rest] = viterbi(unary[rest], model.chain, np.r_[np.searchsorted(t.doc[at], kept), len(at)])
        return best
    return viterbi(unary, model.chain, t.first)


def _expect(unary: np.ndarray, chain: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the states of each token, and the expected number of each pair of states."""
    begin, active = _steps(first)
    e = np.exp(chain)
    S = len(STATES)
    fwd, bwd = np.empty((len(unary), S)), np.zeros((len(unary), S))
    start = np.zeros(S)
    start[INSIDE] = FORBIDDEN
    for t, n in enumerate(active):
        at = begin[:n] + t
        if t == 0:
            fwd[at] = unary[at] + start
            continue
        a = fwd[at - 1]
        top = a.max(1, keepdims=True)
        fwd[at] = np.log(np.exp(a - top) @ e + 1e-300) + top + unary[at]
    pairs = np.zeros((S, S))
    for t in range(len(active) - 1, 0, -1):
        at = begin[:active[t]] + t
        b = unary[at] + bwd[at]
        top = b.max(1, keepdims=True)
        b = np.exp(b - top)
        bwd[at - 1] = np.log(b @ e.T + 1e-300) + top
        a = fwd[at - 1]
        z = a + bwd[at - 1]
        high = z.max(1, keepdims=True)
        z = np.log(np.exp(z - high).sum(1, keepdims=True)) + high
        pairs += e * (np.exp(a + top - z).T @ b)
    p = fwd + bwd
    p = np.exp(p - p.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True), pairs


def varied(judged: list[tuple[str, list[Node]]]) -> list[tuple[str, list[Node]]]:
    """Further texts for the fit: those with a number of a kind, the number written in the kind's other ways, as a small table shows few of them."""
    out = []
    for kind, ways in WRITTEN.items():
        label = LABELS.index(kind)
        with_one = [(x, n) for x, n in judged if sum(m.weak == label for m in n) == 1]
        for k in range(min(len(ways), -(-VARIED // max(1, len(with_one))))):
            for x, nodes in with_one:
                rng = random.Random(zlib.crc32(x.encode("utf-8", "ignore")) + k)
                at = next(m for m in nodes if m.weak == label)
                new = re.sub("[#@]", lambda m: rng.choice("0123456789") if m[0] == "#" else rng.choice("ABCDEFGHJKLMNPQRSTXYZ"), ways[(k + rng.randrange(len(ways)) * (len(with_one) > VARIED)) % len(ways)])
                more = len(new) - (at.end - at.start)
                moved = [Node(m.start, m.start + len(new), m.shape, m.weak) if m is at else Node(m.start + more, m.end + more, m.shape, m.weak) if m.start > at.start else m for m in nodes]
                out.append((x[:at.start] + new + x[at.end:], moved))
    return out


def fit(texts: list[str], know: Knowledge, teacher: Finder, epochs: int = EPOCHS, rate: float = 0.3, penalty: float = 1e-5, batch: int = 256, hidden: int = 5) -> Model:
    """Weights of the greatest likelihood of the teacher's labels, by batches with per-weight rates."""
    judged = [(x, teacher.nodes(x)) for x in texts]
    judged += varied(judged)
    S = len(STATES)
    w, chain, gw, gc = np.zeros((WEIGHTS, S), np.float32), np.zeros((S, S)), np.full((WEIGHTS, S), 1e-6, np.float32), np.full((S, S), 1e-6)
    allowed = _allowed()
    agree = AGREEMENT * np.eye(len(LABELS))
    details = sum(bool(m.weak) for _, n in judged for m in n)
    if not details:
        w[:, 1:] = FORBIDDEN
        return Model(w, allowed, agree)
    reader, batches = Reader(know), []
    together = np.full((len(LABELS),) * 2, 0.0)
    order = np.argsort([zlib.crc32(x.encode("utf-8", "ignore")) for x, _ in judged], kind="stable")
    for k in range(0, len(order), batch):
        some = [judged[i] for i in order[k:k + batch]]
        t = reader.read([x for x, _ in some])
        y, unsure = np.zeros(len(t.start), np.int64), np.zeros(len(t.start), bool)
        for i, (_, nodes) in enumerate(some):
            lo, hi = t.first[i], t.first[i + 1]
            for m in nodes:
                if m.weak == 0:
                    continue
                a = lo + np.searchsorted(t.end[lo:hi] - t.at[i], m.start, side="right")
                b = lo + np.searchsorted(t.start[lo:hi] - t.at[i], m.end, side="left")
                if m.weak is None:
                    unsure[a:b] = True
                else:
                    y[a:b] = INSIDE[m.weak - 1]
                    y[a] = BEGIN[m.weak - 1]
        attributes = t.attributes.copy()
        unseen = (attributes[:, A["end3"]] + attributes[:, A["end2"]]) % hidden == 0  # by the word, so alike in all texts
        for a in ("first", "last", "side", "own"):
            attributes[unseen, A[a]] = 0
        batches.append((features(t, attributes), t.first, y, t.doc, unsure))
        skip = skip_edges(t)
        np.add.at(together, (KIND[y[skip[:, 0]]], KIND[y[skip[:, 1]]]), 1.0)
    for epoch in range(epochs):
        for rows, first, y, doc, unsure in batches:
            unary = np.zeros((len(y), S))
            for r in rows:
                unary += w[r]
            p, pairs = _expect(unary, chain + allowed, first)
            y = np.where(unsure, p.argmax(1), y)  # the field's own view so far
            p[np.arange(len(y)), y] -= 1.0
            follow = doc[1:] == doc[:-1]
            np.add.at(pairs, (y[:-1][follow], y[1:][follow]), -1.0)
            wrong = np.flatnonzero(np.abs(p).max(1) > 1e-3)
            if len(wrong):
                d = p[wrong].astype(np.float32)
                flat = rows[:, wrong].ravel()
                by = np.argsort(flat, kind="stable")
                cut = np.flatnonzero(np.r_[True, np.diff(flat[by]) != 0])
                at = flat[by][cut]
                g = np.add.reduceat(np.tile(d, (len(rows), 1))[by], cut, axis=0) + penalty * w[at]
                gw[at] += g * g
                w[at] -= rate * g / np.sqrt(gw[at])
            gc += pairs * pairs
            chain -= rate * pairs / np.sqrt(gc)
    # kinds that skip edges join more or less often than by chance, with one edge's worth of agreement as prior
    together = together + together.T
    share = (together + np.eye(len(LABELS)) + 0.5) / (together + np.eye(len(LABELS)) + 0.5).sum()
    odds = np.log(share / np.outer(share.sum(0), share.sum(1)))
    return Model(w, chain + allowed, np.clip(odds, -3, 3) * AGREEMENT)


# ---- what the tables know -------------------------------------------------------------------

_WORDS = r"\p{L}+(?:['’]\p{L}+)*"


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(_WORDS), F.lit(0))


def _level(count: Column, total: Column) -> Column:
    return F.when(count > 0, 1 + F.greatest(F.lit(0), F.least(F.lit(14), F.floor(F.log2(count / total * SPREAD))))).otherwise(0)


def kinds_and_owns(names: DataFrame, organisations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``w`` twice: the words of organisations behind the first, and the first words of organisations and of names with such a word."""
    w = _words(F.col("organisation"))
    kinds = organisations.select(F.explode(F.slice(w, 2, 9)).alias("w"))
    n = _words(F.col("name"))
    named = names.select(n[0].alias("own"), F.explode(F.slice(n, 2, 9)).alias("w")).join(kinds.distinct(), "w", "left_semi").select(F.col("own").alias("w"))
    return kinds, organisations.select(w[0].alias("w")).unionByName(named).filter("w is not null")


def knowledge(texts: DataFrame, persons: DataFrame, towns: DataFrame, kinds: DataFrame, owns: DataFrame) -> Knowledge:
    """Levels of all words: ``texts`` (text), ``persons`` (a, b), ``towns`` (town), ``kinds`` and ``owns`` (w)."""
    lower = F.regexp_extract_all(F.col("text"), F.lit(r"(?<![\p{L}'’])\p{Ll}+(?![\p{L}'’])"), F.lit(0))
    roles = [
        persons.select(F.col("a").alias("w"), F.lit(0).alias("role")), persons.select(F.col("b").alias("w"), F.lit(1).alias("role")),
        towns.select(F.explode(_words(F.col("town"))).alias("w"), F.lit(2).alias("role")),
        kinds.select("w", F.lit(3).alias("role")),
        texts.select(F.explode(lower).alias("w"), F.lit(4).alias("role")),
        owns.select("w", F.lit(5).alias("role")),
    ]
    each = roles[0]
    for r in roles[1:]:
        each = each.unionByName(r)
    counted = each.groupBy("role", "w").count()
    total = counted.groupBy("role").agg(F.sum("count").alias("total"))
    levels = counted.join(F.broadcast(total), "role").select((F.crc32("w") % SLOTS).alias("slot"), "role", _level(F.col("count"), F.col("total")).alias("level"))
    out = np.zeros((SLOTS, len(COUNTED)), np.uint8)
    got = levels.groupBy("slot", "role").agg(F.max("level").cast("int").alias("level")).toPandas()  # at most SLOTS rows a role
    out[got["slot"], got["role"]] = got["level"]
    return Knowledge(out)


def persons_of(names: DataFrame, towns: DataFrame, kinds: DataFrame, owns: DataFrame) -> DataFrame:
    """``a, b``: first and last word of each name of two words that is no town's and has no organisation's word."""
    w = _words(F.col("name"))
    reverse = F.col("name").rlike(r"^\s*[^,]+,\s*[^,]+$")
    two = names.select(F.filter(w, lambda x: F.length(x) > 1).alias("w"), reverse.alias("reverse")).filter("size(w) = 2")
    two = two.select(F.when(F.col("reverse"), F.col("w")[1]).otherwise(F.col("w")[0]).alias("a"), F.when(F.col("reverse"), F.col("w")[0]).otherwise(F.col("w")[1]).alias("b")).distinct()
    places = towns.select(_words(F.col("town")).alias("w")).filter("size(w) = 2").select(F.col("w")[0].alias("a"), F.col("w")[1].alias("b")).distinct()
    none = kinds.distinct().withColumnRenamed("w", "b")
    two = two.join(none, "b", "left_anti").join(kinds.unionByName(owns).distinct().withColumnRenamed("w", "a"), "a", "left_anti").join(places, ["a", "b"], "left_anti").select("a", "b")
    # a first name stands before several last ones (in a small table, before as many as any), the first word of an organisation typed in a short form does not
    each = two.groupBy("a").count()
    most = each.agg(F.least(F.lit(LASTS), F.max("count")).alias("most"))
    return two.join(each.join(F.broadcast(most)).filter("count >= most").select("a"), "a", "left_semi").select("a", "b")


def learn(texts: DataFrame, names: DataFrame, towns: DataFrame, organisations: DataFrame | None = None, max_train: int = MAX_TRAIN) -> tuple[Knowledge, Model]:
    """What the tables know, and weights. texts: ``text``; names: ``name`` (as typed); towns: ``town``; organisations: ``organisation``."""
    spark = texts.sparkSession
    organisations = spark.createDataFrame([], "organisation string") if organisations is None else organisations
    texts = texts.filter("text is not null").select("text")
    # each is read several times below; written once, they also keep the plans small
    names, towns = materialise(names.select(F.trim(F.lower("name")).alias("name")).filter("name != ''").distinct()), materialise(towns.select(F.trim(F.lower("town")).alias("town")).groupBy("town").count())
    towns = towns.filter("count > 1").select("town")
    kinds, owns = (materialise(x) for x in kinds_and_owns(names, organisations))
    persons = materialise(persons_of(names, towns, kinds, owns))
    know = knowledge(texts, persons, towns, kinds, owns)
    marked = F.col("text").rlike(r"\d{3}|\b\d{1,4}\s?[a-zA-Z]?,? (?:[\p{L}.'’-]+ ){1,4}?[\p{L}.]+(?: \w+ \d+)?,\s|@|\b(?i:at)\b.*\b(?i:dot)\b")
    distinct = texts.groupBy("text").agg(F.first(marked).alias("marked"))
    rows = {r["marked"]: r["count"] for r in distinct.groupBy("marked").count().collect()}
    share = min(rows.get(True, 0), max_train * 3 // 5)
    sample = [r["text"] for m, n in ((True, share), (False, max_train - share)) for r in hashed_sample(distinct.filter(F.col("marked") == m).select("text"), n, "text", rows=rows.get(m, 0)).collect()]
    near = set()
    for t in sample:
        ws = [w.lower() for w in WORD.findall(t)]
        near |= {*zip(ws, ws[1:]), *((a, b) for a, m, b in zip(ws, ws[1:], ws[2:]) if len(m) == 1)}
    known: set[tuple[str, str]] = set()
    if near:  # of the sample's pairs of words, those that are persons
        asked = spark.createDataFrame(pd.DataFrame(sorted(near), columns=["a", "b"]))
        both = persons.unionByName(persons.select(F.col("b").alias("a"), F.col("a").alias("b")))
        known = {(r["a"], r["b"]) for r in asked.join(both.distinct(), ["a", "b"]).collect()}
    return know, fit(sample, know, Finder(know, frozenset(known)))


# ---- use ------------------------------------------------------------------------------------

def spans(know: Knowledge, model: Model, texts: list[str | None], reader: Reader | None = None) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of the details of each text."""
    reader = reader or Reader(know)
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    at = [i for i, t in enumerate(texts) if t]
    k = 0
    while k < len(at):
        size, j = 0, k
        while j < len(at) and (j == k or size + len(texts[at[j]]) < 4 * TOKENS):
            size += len(texts[at[j]])
            j += 1
        t = reader.read([texts[i] for i in at[k:j]])
        if len(t.start):
            state = decode(model, t)
            begins = np.flatnonzero(np.isin(state, BEGIN))
            goes_on = np.isin(state, INSIDE)
            ends = np.flatnonzero(~np.r_[goes_on, False])  # tokens after which a detail cannot go on
            last = ends[np.searchsorted(ends, begins + 1)] - 1
            for b, e in zip(begins.tolist(), last.tolist()):
                d = t.doc[b]
                if t.joined[t.start[e]] in ",;:":  # no detail ends so
                    continue
                out[at[k + d]].append((int(t.start[b] - t.at[d]), int(t.end[e] - t.at[d]), LABELS[KIND[state[b]]]))
        k = j
    return out


def find(texts: DataFrame, know: Knowledge, model: Model) -> DataFrame:
    """``field, row_id, kind, value`` of the details in ``texts`` (field, row_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(know)
        for b in batches:
            fields, ids, old = (b.column(k).to_pylist() for k in range(3))
            rows = [x for f, i, t, got in zip(fields, ids, old, spans(know, model, old, reader)) for x in dict.fromkeys((f, i, kind, t[s:e]) for s, e, kind in got)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.string()))], names=["field", "row_id", "kind", "value"])

    return texts.filter("text is not null").select("field", "row_id", "text").mapInArrow(run, "field string, row_id bigint, kind string, value string")


def redact(texts: DataFrame, know: Knowledge, model: Model) -> DataFrame:
    """``field, row_id, text`` with each detail replaced by the placeholder of its kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(know)
        for b in batches:
            old = b.column(2).to_pylist()
            new = []
            for t, got in zip(old, spans(know, model, old, reader)):
                for s, e, kind in reversed(got):
                    t = t[:s] + PLACEHOLDER[kind] + t[e:]
                new.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(new, pa.string())], names=["field", "row_id", "text"])

    return texts.select("field", "row_id", "text").mapInArrow(run, "field string, row_id bigint, text string")
