"""Evaluation passages in training text, by a generalised suffix automaton over words."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Consecutive words that make a leak.
MIN_WORDS = 13
#: Item words of one automaton: the bound of what is broadcast. More items are matched in further passes.
BLOCK_WORDS = 500_000

_WORD = re.compile(r"[^\W_]+")
_CHUNK = re.compile(r"\S+")


def words_of(text: str) -> list[str]:
    """Longest runs of letters or digits after NFKC and lower-casing."""
    return _WORD.findall(unicodedata.normalize("NFKC", text).lower())


class Automaton:
    """Suffix automaton of all items; a state knows which items hold its shortest string of at least ``least`` words."""

    def __init__(self, items: Iterable[tuple[int, list[str]]], least: int):
        self.least, self.words = least, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        kept = []
        for item, words in items:
            ids = [self.words.setdefault(w, len(self.words)) for w in words]
            last = 0
            for w in ids:
                last = self._extend(last, w)
            kept.append((item, ids))
        self.top = [self._top(s) for s in range(len(self.link))]
        self.items: dict[int, set[int]] = {}
        for item, ids in kept:
            for _, state, _ in self.walk(ids):
                self.items.setdefault(state, set()).add(item)

    def _extend(self, last: int, w: int) -> int:
        at = self.next[last].get(w)
        if at is not None and self.length[at] == self.length[last] + 1:
            return at
        if at is not None:
            return self._split(last, w, at)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _state(self, length: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _top(self, s: int) -> int:
        while s > 0 and self.length[self.link[s]] >= self.least:
            s = self.link[s]
        return s

    def walk(self, ids: list[int]) -> Iterator[tuple[int, int, int]]:
        """(position, state, length) wherever the longest match that ends there has at least ``least`` words."""
        state = length = 0
        for i, w in enumerate(ids):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state, length = self.next[state][w], length + 1
            if length >= self.least:
                yield i, self.top[state], length

    def spans(self, words: list[str]) -> list[tuple[int, int, set[int]]]:
        """Longest stretches of matched words: first word, last word, items found in it. Words no item has end every match."""
        ids = np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).view(np.int8), [0]])))
        out: list[tuple[int, int, set[int]]] = []
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a < self.least:
                continue
            for i, state, length in self.walk(ids[a:b].tolist()):
                first, last = a + i - length + 1, a + i
                if out and first <= out[-1][1] + 1:
                    out[-1] = (min(first, out[-1][0]), last, out[-1][2] | self.items[state])
                else:
                    out.append((first, last, set(self.items[state])))
        return out


def _blocks(items: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, list[str]]]]:
    """The stated items in blocks of bounded size, read one after the other."""
    block, size = [], 0
    for row in items.where(F.col(text).isNotNull()).select(item, text).toLocalIterator():
        words = words_of(row[1])
        if len(words) < MIN_WORDS:
            continue
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row[0], words))
        size += len(words)
    if block:
        yield block


def leaked_spans(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Every stretch of a document in which each 13 consecutive words stand in some item.

    Items are a stated query set: blocks of at most 500,000 words become one automaton each, which is broadcast, and the
    corpus streams past it once per block, whole texts, one document in memory.

    Result: doc, first_word, last_word (0-based), items (sorted array of ids). Null and empty texts and texts or
    items of less than 13 words have none; repeated items are all reported; no items: no rows.
    """
    spark = docs.sparkSession
    out = None
    for block in _blocks(items, item, item_text):
        shared = spark.sparkContext.broadcast(Automaton(block, MIN_WORDS))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            automaton = shared.value
            for batch in batches:
                rows = [(d, int(a), int(b), sorted(found)) for d, t in zip(batch["d"], batch["t"]) if t for a, b, found in automaton.spans(words_of(t))]
                yield pd.DataFrame(rows, columns=["d", "first_word", "last_word", "items"])

        found = docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("d"), F.col(text).alias("t")).mapInPandas(scan, "d long, first_word long, last_word long, items array<long>")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "d long, first_word long, last_word long, items array<long>")
    return out.withColumnRenamed("d", doc)


def without_leaks(docs: DataFrame, spans: DataFrame, doc: str = "doc_id", text: str = "text", max_span: int = MIN_WORDS, max_coverage: float = 0.5) -> DataFrame:
    """Documents with leaked stretches of at least ``max_span`` words removed, emptied if more than ``max_coverage`` of their words leaked.

    Result: doc, clean_text, n_removed (words), coverage. Words are removed with the white-space-delimited chunks that
    hold them. Documents without leaks keep their text unchanged (null stays null).
    """
    marks = spans.where(F.col("last_word") - F.col("first_word") + 1 >= max_span).groupBy(doc).agg(F.collect_set(F.struct("first_word", "last_word")).alias("marks"))

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d, t, marks in zip(batch["d"], batch["t"], batch["marks"]):
                if marks is None or t is None:
                    rows.append((d, t, 0, 0.0))
                    continue
                chunks = [(m.start(), m.end(), len(words_of(m.group()))) for m in _CHUNK.finditer(t)]
                total = sum(n for _, _, n in chunks)
                bad = np.zeros(total, bool)
                for m in marks:
                    bad[m["first_word"] : m["last_word"] + 1] = True
                out, at, word = [], 0, 0
                for a, b, n in chunks:
                    if n and bad[word : word + n].any():
                        out.append(t[at:a])
                        at = b
                    word += n
                share = float(bad.mean()) if total else 0.0
                rows.append((d, "" if share > max_coverage else "".join(out) + t[at:], int(bad.sum()), share))
            yield pd.DataFrame(rows, columns=["d", "clean_text", "n_removed", "coverage"])

    joined = docs.select(doc, text).join(marks, doc, "left").select(F.col(doc).alias("d"), F.col(text).alias("t"), "marks")
    return joined.mapInPandas(strip, "d long, clean_text string, n_removed long, coverage double").withColumnRenamed("d", doc)
