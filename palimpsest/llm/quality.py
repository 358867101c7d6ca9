"""Statistics of each document's text, their ranks within the language, and the form of the text.

``statistics`` reads each text once.  ``ranks`` turns statistics into exact
empirical tail probabilities per language: equal values are counted where they
are, the distinct values are sorted by ranges, and each range's counts are offset
by those of the ranges before it.  ``outliers`` combines the tails: for each
document the sums of -log of the left, of the right and of the rarer tails, of
which the largest is its score.  ``forms`` gives each form its own outlier score,
the weighted sum of both tails of all statistics, and a text the form whose score
is the largest.  Only the weights and each language's threshold are
learnt from the labelled sample (at most MAX_LABELS labels, by hash).

For the forms, values are brought to a grid of LEVELS steps (a thousandth of a
share, a fortieth of a doubling of a count), so that all ranks together are a table of bounded
size, which is sent to the executors; the documents themselves are never
joined or shuffled for it.

Null and blank texts get zeros, no tails and no form. A text's language is the
one whose common words make up the most, and at least a tenth, of its words; else
the one given for it, or if that is null or unknown, the group ``und``. Very long
texts are read whole. Each row counts once per ``doc_id``; columns with clashing
names are not read. Without labels no document has a form. More than MAX_COMMON common words or
MAX_LANGUAGES languages are an error, as their number is part of the bound.

Scale: counting shuffles one row per distinct value and task; only the common
words (a fixed list), the labels and the ranks (all bounded) reach the driver. ``tails``, which
joins ranks of values without a grid, spreads the values 0 and 1, which hold most
rows, over SALTS keys.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import materialise, wide_partitions

MAX_COMMON, MAX_LANGUAGES, MAX_LABELS, SALTS, LEVELS = 100_000, 64, 20_000, 32, 1024
NATIVE = 0.1  # least share of common words that tells a language
RANKED = ("words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_share")
FORMS = ("prose", "list", "table", "junk")
# Marks that end a sentence in the five languages, with closing quotes and brackets after them.
SENTENCE_END = re.compile(r"[.!?…।॥。！？:;][\"'”’»)\]]*$")
_BULLET = re.compile(r"(?:[-*+•·–—▪◦‣o]|\[[ xX]?\])\s+")
_NUMBER = re.compile(r"\(?(?:\d{1,6}|[A-Za-z]|[ivxlcIVXLC]{1,6})[.):]\s*(?=\S)")
_KEYED = re.compile(r"([^\s:]{1,32}?)(\d*)\s*[:=)]\s*\S")
_COLUMNS = re.compile(r"\S(?: {2,}|\t)(?=\S)")
_TIGHT = re.compile(r"[,;](?=\S|$)|\"[,;]\"")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*", re.UNICODE)
_HEX = re.compile(r"\b(?:0x)?(?=[0-9a-f]*\d)[0-9a-fA-F]{6,}\b")
_DIGITS = re.compile(r"\d+")
_MARKS = re.compile("[\u0900-\u0903\u093a-\u094f\u0951-\u0957\u0962\u0963]+")  # marks that carry vowels, which are no symbols
_VOWELS = frozenset("aeiouyáàâäéèêëíìîïóòôöúùûüœæ")
_RULE = frozenset("+-|= :")
_STOPS = tuple(m + e for m in ".!?।…" for e in " \n")
_MOJIBAKE = re.compile("[\x80-\x9f]|[ÃÂâà][\x80-¿]|�")
COLUMNS = (
    "words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_share", "digit_ratio", "letter_ratio", "lines", "bullet_share",
    "number_share", "keyed_share", "keyed_distinct", "pipe_share", "column_share", "tight_share", "short_share", "prose_share", "distinct_lines",
    "distinct_words", "squeeze", "mojibake_ratio", "comma_run", "vowelless", "hex_share", "sentence_words", "space_ratio", "longest_word",
    "delimiter_even", "brace_share", "top_word_share", "listed", "listed_short", "cells", "list_over_prose", "short_over_prose",
)
# How a statistic comes to its grid: counts by doublings, lengths by fifths, shares by thousandths.
COUNTS, LENGTHS = {"words", "lines"}, {"mean_word_length", "comma_run", "sentence_words", "longest_word"}


def _share(x: float, total: float) -> float:
    return x / total if total else 0.0


def describe(text: str | None, common: dict[str, frozenset]) -> tuple:
    """The statistics of a text in the order of COLUMNS, and the language it looks like (or None)."""
    if not text or not text.strip("﻿​‌‍⁠ \t\r\n\xa0"):
        return (0.0,) * len(COLUMNS), None
    n, low = len(text), text.lower()
    tokens = low.split()
    words = _WORD.findall(low)
    counted = Counter(words)
    hits = {lang: sum(map(counted.__getitem__, c & counted.keys())) for lang, c in common.items()}
    best = max(hits, key=lambda k: (hits[k], k), default=None)
    letters = sum(map(len, words))
    digits = n - len(_DIGITS.sub("", text))
    spaces = n - len("".join(tokens)) if len(low) == n else n - sum(map(len, text.split()))
    ascii_only = text.isascii()
    marks = 0 if ascii_only else sum(map(len, _MARKS.findall(text)))
    symbols = max(0, n - letters - digits - spaces - marks)
    body = punctuated = bullets = numbers = keyed = pipes = columns = tight = short = prose = hexed = braces = 0
    keys, lines, cells = set(), [], {}
    is_common = (common[best] if best and hits[best] else frozenset()).__contains__
    for line in low.splitlines():
        s = line.strip()
        if not s:
            continue
        lines.append(s)
        m = len(s)
        body += m
        ended = SENTENCE_END.search(s[-6:]) is not None
        punctuated += ended
        ws = s.split()
        bullet = _BULLET.match(s)
        mark = bullet or _NUMBER.match(s)
        if bullet:
            bullets += m
        elif mark:
            numbers += m
        k = None if mark else _KEYED.match(s)
        if k:
            keyed += m
            keys.add(k[1])
        bars, tabs = s.count("|"), s.count("\t")
        pipes += m if bars >= 2 or set(s) <= _RULE else 0
        cols = (len(_COLUMNS.findall(s)) if tabs or "  " in s else 0) + tabs
        columns += m if cols else 0
        semicolons = s.count(";")
        t = len(_TIGHT.findall(s)) if semicolons or "," in s else 0
        tight += m if t >= 2 and t >= len(ws) - 2 else 0
        d = max(bars, tabs, semicolons, t)
        cells[d] = cells.get(d, 0) + 1
        if not mark and bars < 2 and not cols:
            if len(ws) <= 8 and not ended:
                short += m
            if not k and (ended or len(ws) > 12) and sum(map(is_common, ws)) >= 0.12 * len(ws):
                prose += m
        if digits:
            hexed += sum(map(len, _HEX.findall(s)))
        braces += m if s[0] in "{[<" and s[-1] in "}]>" and m > 6 else 0
    commas = text.count(",") + text.count("،")
    sentences = sum(map(text.count, _STOPS)) + text.endswith(tuple(".!?।…"))
    long_words = [(w, c) for w, c in counted.items() if len(w) > 2 and w.isascii()]
    raw = text.encode("utf-8", "ignore")
    share_of = lambda x: x / body if body else 0.0
    listed, cell, prosed = share_of(bullets + numbers), share_of(pipes + columns + tight), share_of(prose)
    shorter = listed + share_of(short) + share_of(keyed)
    stats = (
        float(len(tokens)), round(_share(n - spaces, len(tokens)), 4), round(_share(symbols, n), 4), round(_share(punctuated, len(lines)), 4),
        round(_share(max(hits.values(), default=0), max(len(words), 1)), 4), _share(digits, n), _share(letters, n), float(len(lines)), share_of(bullets),
        share_of(numbers), share_of(keyed), _share(len(keys), len(lines)), share_of(pipes), share_of(columns), share_of(tight),
        share_of(short), prosed, _share(len(set(lines)), len(lines)), _share(len(counted), len(words)), len(zlib.compress(raw, 1)) / max(1, len(raw)),
        0.0 if ascii_only else _share(len(_MOJIBAKE.findall(text)), n), min(200.0, _share(len(words), commas + 1)),
        _share(sum(c for w, c in long_words if _VOWELS.isdisjoint(w)), sum(c for _, c in long_words)), share_of(hexed), min(200.0, _share(len(tokens), sentences + 1)), _share(spaces, n),
        float(min(200, max(map(len, tokens), default=0))), _share(max((c for k, c in cells.items() if k), default=0), len(lines)), share_of(braces), _share(max(counted.values(), default=0), len(words)),
        listed, listed + share_of(short), cell, (listed + 0.001) / (listed + prosed + 0.002), (shorter + 0.001) / (shorter + prosed + 0.002),
    )
    return stats, best if best and hits[best] and stats[4] >= NATIVE else None


def statistics(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """``doc_id, lang_group, blank`` and COLUMNS of each document."""
    common: dict[str, set] = {}
    for r in common_words.select("lang", "word").filter("lang is not null and word is not null").limit(MAX_COMMON + 1).collect():
        common.setdefault(r["lang"].strip().lower(), set()).add(r["word"].strip().lower())
    if len(common) >= MAX_LANGUAGES or sum(map(len, common.values())) > MAX_COMMON:
        raise ValueError(f"more than {MAX_COMMON} common words or {MAX_LANGUAGES - 1} languages")
    lists = {k: frozenset(v) for k, v in common.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [describe(t, lists) for t in b.column(2).to_pylist()]
            said = [(x or "").strip().lower() for x in b.column(1).to_pylist()]
            lang = [g or (s if s in lists else "und") for (_, g), s in zip(got, said)]
            cols = list(zip(*(s for s, _ in got))) if got else [()] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lang, pa.string()), pa.array([s[0] == 0.0 for s, _ in got], pa.bool_()), *[pa.array(c, pa.float64()) for c in cols]],
                names=["doc_id", "lang_group", "blank", *COLUMNS])

    schema = "doc_id bigint, lang_group string, blank boolean, " + ", ".join(f"{c} double" for c in COLUMNS)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text").mapInArrow(run, schema)


def ranks(counts: DataFrame) -> DataFrame:
    """``stat, lang_group, value, left, right`` of ``stat, lang_group, value, count``: shares of the language's texts at or below, and at or above."""
    group = ["stat", "lang_group"]
    ranges = counts.repartitionByRange(wide_partitions(counts.sparkSession), *group, "value").sortWithinPartitions(*group, "value")
    ranges = materialise(ranges.withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part", *group).orderBy("value")
    sums = ranges.groupBy("part", *group).agg(F.sum("count").alias("n"))
    over = Window.partitionBy(*group).orderBy("part")
    whole = Window.partitionBy(*group)
    offsets = sums.select("part", *group, F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.sum("n").over(whole).alias("total"))
    upto = F.col("offset") + F.col("upto")
    return ranges.withColumn("upto", F.sum("count").over(inside)).join(offsets, ["part", *group]).select(
        *group, "value", (upto / F.col("total")).alias("left"), ((F.col("total") - upto + F.col("count")) / F.col("total")).alias("right"))


def tails(stats: DataFrame, ranked: tuple[str, ...] = RANKED) -> DataFrame:
    """``doc_id, lang_group, stat, value, left, right``: the ranks of each document's values."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).alias("value")) for c in ranked]))
    flat = stats.filter("not blank").select("doc_id", "lang_group", pairs.alias("p")).select("doc_id", "lang_group", "p.*")
    group = ["stat", "lang_group"]
    found = ranks(flat.groupBy(*group, "value").count())
    heavy = F.col("value").isin(0.0, 1.0)
    salted = flat.withColumn("salt", F.when(heavy, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    spread = found.withColumn("salt", F.explode(F.when(heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(spread, [*group, "value", "salt"]).select("doc_id", "lang_group", "stat", "value", "left", "right")


def outliers(tail: DataFrame) -> DataFrame:
    """``doc_id, score``: the largest of the summed left, right and rarer-side tail terms."""
    lo, hi = -F.log("left"), -F.log("right")
    sums = tail.groupBy("doc_id").agg(F.sum(lo).alias("lo"), F.sum(hi).alias("hi"), F.sum(F.greatest(lo, hi)).alias("either"))
    return sums.select("doc_id", F.greatest("lo", "hi", "either").alias("score"))


def _grid(batch: pa.RecordBatch) -> np.ndarray:
    """Steps of the grid, a row per statistic of COLUMNS."""
    out = np.empty((len(COLUMNS), batch.num_rows), np.int64)
    for k, c in enumerate(COLUMNS):
        x = batch.column(c).to_numpy(zero_copy_only=False)
        out[k] = np.floor(40 * np.log2(1 + x)) if c in COUNTS else np.rint((5 if c in LENGTHS else 1000) * x)
    return np.clip(out, 0, LEVELS - 1)


def level_counts(stats: DataFrame) -> DataFrame:
    """``stat, lang_group, value, count`` of the grid's steps; a task counts into an array of fixed size and gives its filled places out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            lang, steps = np.array(b.column("lang_group").to_pylist(), dtype=object), _grid(b)
            for g in set(lang):
                here = steps[:, lang == g] + LEVELS * np.arange(len(COLUMNS))[:, None]
                seen[g] = seen.get(g, 0) + np.bincount(here.ravel(), minlength=LEVELS * len(COLUMNS))
        for g, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at // LEVELS), pa.array([g] * len(at)), pa.array(at % LEVELS), pa.array(n[at])], names=["stat", "lang_group", "value", "count"])

    each = stats.select("lang_group", *COLUMNS).mapInArrow(run, "stat bigint, lang_group string, value bigint, count bigint")
    return each.groupBy("stat", "lang_group", "value").agg(F.sum("count").alias("count"))


class Scores:
    """Outlier scores of the forms: weights of the tails, and one threshold for each language."""

    RARE = (1.2, 5.0)  # a tail counts up to these, so that a common and a rare excess weigh apart

    def __init__(self, found: list):
        self.groups = sorted({r["lang_group"] for r in found})
        place = {g: k for k, g in enumerate(self.groups)}
        self.logs = np.zeros((len(self.groups), len(COLUMNS), LEVELS, 2), np.float32)
        for r in found:
            self.logs[place[r["lang_group"]], r["stat"], r["value"]] = -np.log(r["left"]), -np.log(r["right"])
        self.weights = self.spread = None

    def terms(self, batch: pa.RecordBatch) -> np.ndarray:
        """The tail terms and languages of each document."""
        place = {g: k for k, g in enumerate(self.groups)}
        lang = np.array([place[g] for g in batch.column("lang_group").to_pylist()], np.int64)
        logs = self.logs[lang, np.arange(len(COLUMNS))[:, None], _grid(batch)]  # statistic, document, side
        logs = logs.transpose(1, 0, 2).reshape(len(lang), -1)
        return np.concatenate([np.minimum(logs, most) for most in self.RARE] + [np.eye(len(self.groups), dtype=np.float32)[lang]], 1)

    def fit(self, batch: pa.RecordBatch, label: np.ndarray, rounds: int = 800, penalty: float = 1e-3, rate: float = 0.5) -> None:
        """Weights of the greatest likelihood of the labels, with a penalty on their squares."""
        x = self.terms(batch)
        self.spread = x.std(0) + 1e-6
        self.spread[self.spread < 1e-5] = np.inf  # a term alike in all texts says nothing
        x = np.c_[x / self.spread, np.ones(len(x))]
        y = np.eye(len(FORMS))[label]
        w = np.zeros((x.shape[1], len(FORMS)))
        past = np.full_like(w, 1e-8)
        for _ in range(rounds):
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            g = x.T @ (p / p.sum(1, keepdims=True) - y) / len(x) + penalty * w
            past += g * g
            w -= rate * g / np.sqrt(past)
        self.weights = w

    def of(self, batch: pa.RecordBatch) -> np.ndarray:
        x = self.terms(batch)
        return (x / self.spread) @ self.weights[:-1] + self.weights[-1]


def forms(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, form`` of the rows of ``stats`` (see ``statistics``) that are not blank; ``labels``: doc_id, form."""
    stats = stats.filter("not blank")
    at = F.array_position(F.array(*map(F.lit, FORMS)), F.col("form")) - 1
    known = labels.select("doc_id", at.cast("int").alias("label")).filter("label >= 0").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id")).limit(MAX_LABELS)
    train = stats.select("doc_id", "lang_group", *COLUMNS).join(F.broadcast(known), "doc_id").toArrow().combine_chunks()
    if not train.num_rows:
        return stats.select("doc_id", F.lit("prose").alias("form")).filter("false")
    scores = Scores(ranks(level_counts(stats)).collect())
    batch = train.to_batches()[0]
    scores.fit(batch, batch.column("label").to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                said = scores.of(b).argmax(1)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([FORMS[k] for k in said])], names=["doc_id", "form"])

    return stats.select("doc_id", "lang_group", *COLUMNS).mapInArrow(run, "doc_id bigint, form string")


def described(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """Statistics of all texts that are not blank, once per document, written once."""
    return materialise(statistics(docs, common_words).filter("not blank").dropDuplicates(["doc_id"]))


def scored(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """Statistics of all texts that are not blank, with the outlier score."""
    stats = described(docs, common_words)
    return stats.join(outliers(tails(stats)), "doc_id")


def math_tail(values: list[float], x: float) -> tuple[float, float]:
    """Brute-force tails of one value, for tests."""
    n = len(values)
    return sum(v <= x for v in values) / n, sum(v >= x for v in values) / n
