"""Encoding with a public byte-level tokenizer (problem 6), by one walk over a trie of the distinct words.

A byte-pair encoding has this property: the encoding of any prefix of a word is the encoding of a shorter prefix and one
last token, and exactly one token fits as the last. So a node of the trie needs only its last token, found from states
further up, and words that share a prefix share all the work done on it. Sorting the distinct words puts them into the
trie's depth-first order; the states along the current branch are a list indexed by depth.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quarry.llm import arrow_text as A

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern that splits text before the merges of the rank files.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A worker forgets its encoded words beyond so many, which bounds its memory; they are encoded again when they come back.
KNOWN_WORDS = 400_000
KNOWN_FITS = 1_000_000


class WordTrie:
    """Encodes distinct words with the ranks of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {i: t for t, i in self.rank.items()}
        self.heads = {t[:k]: -1 for t in self.rank for k in range(1, len(t))} | self.rank  # every beginning of a token
        self._halves: dict[int, tuple[int, int]] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(WORDS).findall
        self._forget()

    def _forget(self) -> None:
        """No word known: no place for any, and no ids in the pool that a word's place points into."""
        self.place: dict[str, int] = {}
        self.first, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _parts(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes a token, found by merging its bytes in rank order until two are left."""
        if token not in self._halves:
            parts = [bytes([b]) for b in self.bytes_of[token]]
            while len(parts) > 2:
                k = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], 1 << 30))
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self._halves[token] = (self.rank[parts[0]], self.rank[parts[1]])
        return self._halves[token]

    def _edge(self, token: int, side: int) -> list[int]:
        """The tokens that stood at one edge of a token while it was merged, the single byte first."""
        edge = [token]
        while len(self.bytes_of[edge[-1]]) > 1:
            edge.append(self._parts(edge[-1])[side])
        return edge[::-1]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their joined bytes are encoded.

        Both sides are replayed merge by merge: at each moment one token of the left side's edge touches one of the right
        side's. The boundary falls if those two merge before either is merged away on its own side; of merges of one
        rank the leftmost comes first.
        """
        known = self._fits.get((left, right))
        if known is not None:
            return known
        a, b = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        never = 1 << 30
        while True:
            next_a = a[i + 1] if i + 1 < len(a) else never
            next_b = b[j + 1] if j + 1 < len(b) else never
            joined = self.rank.get(self.bytes_of[a[i]] + self.bytes_of[b[j]], never)
            if joined < next_a and joined <= next_b and joined < never:
                answer = False
                break
            if next_a == next_b == never:
                answer = True
                break
            if next_a <= next_b:
                i += 1
            else:
                j += 1
        if len(self._fits) >= KNOWN_FITS:
            self._fits.clear()
        self._fits[left, right] = answer
        return answer

    def lengths(self, raws: list[bytes]) -> list[int]:
        """The number of ids of each of these words, sorted by their bytes: the walk of :meth:`learn` with nothing but counts kept."""
        heads, fits, rank = self.heads, self._fits, self.rank
        fit = self.fits
        last: list[int] = [0]
        live: list[list[int]] = [[]]
        many: list[int] = [0]  # by depth: the number of ids of the prefix of that length
        before, out = b"", []
        for raw in raws:
            n, shared = len(raw), 0
            for x, y in zip(raw, before):
                if x != y:
                    break
                shared += 1
            if raw in rank and n > shared + 4:  # a token itself, and long: no walk, as if it weren't there
                out.append(1)
                continue
            del last[shared + 1 :], live[shared + 1 :], many[shared + 1 :]
            for end in range(shared + 1, n + 1):
                still, token = [], -1
                for start in (*live[-1], end - 1):
                    known = heads.get(raw[start:end])
                    if known is not None:
                        still.append(start)
                        if token < 0 <= known:
                            if start == 0:
                                token, count = known, 1
                            else:
                                ok = fits.get((last[start], known))
                                if ok is None:
                                    ok = fit(last[start], known)
                                if ok:
                                    token, count = known, many[start] + 1
                last.append(token)
                live.append(still)
                many.append(count)
            before = raw
            out.append(many[n])
        return out

    def learn(self, words: Iterable[str]) -> None:
        """Encodes words that are not known yet, in the depth-first order of their trie."""
        new = sorted((w.encode("utf-8", "replace"), w) for w in words if w not in self.place)
        if not new:
            return
        made: list[tuple[int, ...] | list[int]] = []
        heads, known_fits, fits, bytes_of, rank = self.heads, self._fits, self.fits, self.bytes_of, self.rank
        last: list[int] = [0]  # by depth: the last token of the prefix of that length
        live: list[list[int]] = [[]]  # by depth: the starts from which some token may still grow
        before = b""
        for raw, _ in new:
            n, shared = len(raw), 0
            for x, y in zip(raw, before):
                if x != y:
                    break
                shared += 1
            if raw in rank and n > shared + 4:  # a token itself, and long: no walk, as if it weren't there
                made.append((rank[raw],))
                continue
            del last[shared + 1 :], live[shared + 1 :]
            for end in range(shared + 1, n + 1):
                still, token = [], -1
                for start in (*live[-1], end - 1):
                    known = heads.get(raw[start:end])
                    if known is not None:
                        still.append(start)
                        if token < 0 <= known:
                            if start == 0:
                                token = known
                            else:
                                ok = known_fits.get((last[start], known))
                                if ok is None:
                                    ok = fits(last[start], known)
                                if ok:
                                    token = known
                last.append(token)
                live.append(still)
            before, out, end = raw, [], n
            while end > 0:
                out.append(last[end])
                end -= len(bytes_of[last[end]])
            made.append(out[::-1])
        size = np.fromiter(map(len, made), np.int64, len(made))
        self.place.update((w, k) for k, (_, w) in enumerate(new, len(self.place)))
        self.first = np.concatenate((self.first, len(self.pool) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.pool = np.concatenate((self.pool, np.fromiter(chain.from_iterable(made), np.int32, int(size.sum()))))

    def encode(self, texts: list[str | None]) -> pa.Array:
        """List<int32> of the texts' ids; empty for an empty and for a null text."""
        found = [self.split(t) if t else [] for t in texts]
        if len(self.place) > KNOWN_WORDS:
            self._forget()
        self.learn(set().union(*found))
        words = np.concatenate(([0], np.cumsum([len(f) for f in found], dtype=np.int64)))
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(found)), np.int64, int(words[-1]))
        size = self.size[at]
        ends = np.concatenate(([0], np.cumsum(size)))
        ids = self.pool[np.repeat(self.first[at] - ends[:-1], size) + np.arange(ends[-1])]
        return pa.ListArray.from_arrays(pa.array(ends[words], pa.int32()), pa.array(ids))


class WordCounts:
    """Counts the ids of texts under several vocabularies, which share the splitting, the words and their order."""

    def __init__(self, tries: list[WordTrie]) -> None:
        self.tries, self.split = tries, tries[0].split
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.size = np.zeros((len(self.tries), 1 << 16), np.int32)

    def counts(self, texts: list[str | None]) -> list[np.ndarray]:
        """The number of ids of each text, for each vocabulary; 0 for null and empty texts."""
        if len(self.place) > KNOWN_WORDS:
            self._forget()
        found = [self.split(t) if t else [] for t in texts]
        place = self.place
        new = sorted((w.encode("utf-8", "replace"), w) for w in set().union(*found) if w not in place)
        if new:
            first, end = len(place), len(place) + len(new)
            if end > self.size.shape[1]:
                self.size = np.concatenate((self.size, np.zeros((len(self.tries), max(end, self.size.shape[1])), np.int32)), 1)
            raws = [r for r, _ in new]
            for row, own in zip(self.size, self.tries):
                row[first:end] = own.lengths(raws)
            place.update((w, k) for k, (_, w) in enumerate(new, first))
        ends = np.concatenate(([0], np.cumsum([len(f) for f in found], dtype=np.int64)))
        at = np.fromiter(map(place.__getitem__, chain.from_iterable(found)), np.int64, int(ends[-1]))
        sums = []
        for row in self.size:
            total = np.concatenate(([0], np.cumsum(row[at], dtype=np.int64)))
            sums.append(total[ends[1:]] - total[ends[:-1]])
        return sums


@lru_cache(maxsize=4)
def trie(tokenizer: str, folder: str = TOKENIZERS) -> WordTrie:
    """The trie of a tokenizer, kept by the worker from batch to batch."""
    return WordTrie(os.path.join(folder, f"{tokenizer}.tiktoken"))


@lru_cache(maxsize=4)
def word_counts(tokenizers: tuple[str, ...], folder: str = TOKENIZERS) -> WordCounts:
    """The counter of some tokenizers, kept by the worker from batch to batch."""
    return WordCounts([trie(t, folder) for t in tokenizers])


def encoded(df: DataFrame, text: str = "text", ids: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``df`` with its text column replaced by ``ids``, the list of token ids; no special tokens, whose strings are ordinary text.

    The ids of an empty and of a null text are the empty list; a blank text has ids. Needs no shuffle: every task walks
    the trie of its own distinct words. A column that already bears the name ``ids`` is an error.
    """
    others = [c for c in df.columns if c != text]
    if ids in others:
        raise ValueError(f"{ids} is a column already")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trie(tokenizer, folder)
        for batch in A.runs(batches, text):
            column = own.encode(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), column], names=[*others, ids])

    from pyspark.sql import types as T

    return df.mapInArrow(work, T.StructType([*(df.schema[c] for c in others), T.StructField(ids, T.ArrayType(T.IntegerType()))]))
