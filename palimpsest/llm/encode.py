"""Encoding texts with a public byte-level BPE vocabulary.

Words of many texts are laid out in one flat array of symbols.  In each round
all neighbouring pairs are looked up at once by binary search over the sorted
pair keys, every word's lowest rank is taken by a segmented minimum, and all
occurrences of that pair in its word are merged (left to right where they
overlap), which is what merging one pair at a time gives.  Words without a pair
left leave the array.  Words met before come from a cache of bounded size.

Null and empty texts give ``empty_ids``, by default an empty list; strings that
look like special tokens are ordinary text. Rows are independent, so texts of
one row and repeated rows encode alike; other columns are passed by.

Scale: no shuffle; each task streams Arrow batches, in slices of bounded text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
VOCABULARIES = {"byte_bpe_50k": DEFAULT_VOCABULARY}  # files of the tokenizers by name, a setting
# Fixed value: the splitting pattern published with this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_WORDS = 400_000
SLICE_CHARS = 2_000_000
NONE = np.int64(1) << 40


def byte_symbols() -> list[str]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in, extra = {}, 256
    for b in range(256):
        if b in plain:
            stand_in[b] = chr(b)
        else:
            stand_in[b] = chr(extra)
            extra += 1
    return [stand_in[b] for b in range(256)]


class Encoder:
    """A vocabulary of merges with a cache of encoded words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.first = np.array([vocab[s] for s in byte_symbols()], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.split = regex.compile(PATTERN).findall
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.pool, self.starts, self.lens, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def merge_rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and each word's count of ids. Words are not empty."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lens)
        done_sym, done_word = [], []
        while len(sym):
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            rank = np.full(len(sym), NONE)
            inside = np.flatnonzero(word[1:] == word[:-1])
            key = (sym[inside] << 32) | sym[inside + 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            rank[inside[known]] = self.rank[at[known]]
            least = np.minimum.reduceat(rank, start)
            counts = np.diff(np.r_[start, len(sym)])
            least_of = np.repeat(least, counts)
            over = least_of == NONE
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                keep = ~over
                sym, word, rank, least_of = sym[keep], word[keep], rank[keep], least_of[keep]
                if not len(sym):
                    break
            hit = rank == least_of
            place = np.arange(len(sym))
            opens = hit & ~np.r_[False, hit[:-1]]
            run = np.maximum.accumulate(np.where(opens, place, 0))
            hit &= (place - run) % 2 == 0
            sym[hit] = self.merged[rank[hit]]
            keep = np.r_[True, ~hit[:-1]]
            sym, word = sym[keep], word[keep]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.int32), np.bincount(word, minlength=len(words))

    def _learn(self, words: list[str]) -> None:
        ids, lens = self.merge_rounds([w.encode("utf-8", "surrogatepass") for w in words])
        n = len(self.index)
        self.index.update((w, n + k) for k, w in enumerate(words))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.r_[self.pool, np.zeros_like(self.pool)]
        while n + len(words) > len(self.starts):
            self.starts, self.lens = np.r_[self.starts, np.zeros_like(self.starts)], np.r_[self.lens, np.zeros_like(self.lens)]
        self.pool[self.used:self.used + len(ids)] = ids
        ends = np.cumsum(lens)
        self.starts[n:n + len(words)] = self.used + ends - lens
        self.lens[n:n + len(words)] = lens
        self.used += len(ids)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and each text's count of ids."""
        if len(self.index) > CACHE_WORDS:
            self.clear()
        split = [self.split(t) if t else [] for t in texts]
        fresh = list(dict.fromkeys(w for ws in split for w in ws if w not in self.index))
        if fresh:
            self._learn(fresh)
        index = self.index
        n = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter((index[w] for ws in split for w in ws), np.int64, int(n.sum()))
        lens = self.lens[at]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(self.starts[at] - (ends - lens), lens) + np.arange(total)] if total else np.zeros(0, np.int32)
        at_text = np.r_[0, ends][np.r_[0, np.cumsum(n)]]
        return ids, np.diff(at_text)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Cuts of a batch of about SLICE_CHARS characters; a text is never cut."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= SLICE_CHARS:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = DEFAULT_VOCABULARY, empty_ids: tuple[int, ...] = ()) -> DataFrame:
    """``key, ids`` of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in _slices(texts):
                ids, n = enc.encode(texts[i:j])
                if empty_ids:
                    parts = np.split(ids, np.cumsum(n)[:-1])
                    parts = [p if t else np.array(empty_ids, np.int32) for p, t in zip(parts, texts[i:j])]
                    ids, n = np.concatenate(parts), np.array([len(p) for p in parts])
                offsets = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(offsets, pa.array(ids))], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the count of ids of each row's text."""
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            n = np.concatenate([enc.encode(texts[i:j])[1] for i, j in _slices(texts)] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(n, pa.int64())], names=[*keep, "tokens"])

    return docs.select(*keep, text).mapInArrow(run, f"{kinds}, tokens bigint")
