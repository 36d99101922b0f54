"""Periodic runs: maximal stretches of words that repeat with a period, from maximal pairs of an LCP-interval tree.

A run of period q is a pair of places q apart whose words agree for length - q words, where neither the words before the
two places nor those behind agree: a maximal pair. So no found place needs to be extended. Suffixes of a text are sorted;
the tree of intervals of their common prefixes is walked bottom-up, and where an interval joins two nodes, places of
different classes (the word to the left) are paired. Length constraints say which pairs count: a run of at least PERIODS
periods and LEAST words has a common prefix of at least (PERIODS - 1) periods, and of LEAST * (PERIODS - 1) / PERIODS
words. So

* only suffixes that share their first words to that number with another take part (most texts have none), and
* a place is paired only with the nearest ones of its node in the order of the text. Places at most half their common
  prefix apart are evenly spaced, all but the first of them behind the same word, and neighbours are one smallest period
  apart; pairs further apart would give multiples of that period. A node whose places are all of one class skips even that.

A node's places are lists in order of the text, and the smaller is put into the larger one, so a text of n words takes
n log n steps (sorting n log^2 n in numpy), however often it repeats itself. Texts are independent: no shuffle.

Edge cases: a null text has no words; equal texts and repeated rows are each searched; null ids are only carried; very
long texts are searched whole, in about 200 bytes for a word of a text that repeats itself; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablemill.llm.common import fresh, schema

#: A run has at least so many words, and so many periods.
LEAST, PERIODS = 24, 3
WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
#: Texts in a batch of results.
BLOCK_ROWS = 500
RUN = schema("start long, length long, period long")
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
_RUNS = pa.list_(pa.struct([(c, pa.int64()) for c in RUN.names]))
#: For hashes that only say which windows can't be equal.
_MIX = np.uint64(0x9E3779B97F4A7C15)


def numbered(words: list[str]) -> np.ndarray:
    """Words as numbers, equal words alike."""
    number: dict[str, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


def _may_repeat(ids: np.ndarray, size: int) -> bool:
    """Whether two windows of so many words may be equal: false only if none are."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    have = 1
    while have < size:
        step = min(have, size - have)
        h = (h[:-step] * np.uint64(31) + (h[step:] ^ (h[step:] >> np.uint64(29)))) * _MIX
        have += step
    h = np.sort(h)
    return bool((h[1:] == h[:-1]).any())


def sorted_suffixes(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, lcp): the suffixes that share at least `least` words with another, in their order, and how many words each
    shares with the one before it (less than `least`: 0)."""
    n, width = len(ids), 1
    ranks = [np.unique(ids, return_inverse=True)[1].astype(np.int32)]
    # Ranks of prefixes of twice the width, until all differ; behind the end there is less than any word.
    while width < n and int(ranks[-1].max()) < n - 1:
        behind = np.zeros(n, dtype=np.int64)
        behind[: n - width] = ranks[-1][width:] + np.int64(1)
        ranks.append(np.unique(ranks[-1] * np.int64(n + 1) + behind, return_inverse=True)[1].astype(np.int32))
        width *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(ranks) - 1, -1, -1):
        inside = (a + (1 << k) <= n) & (b + (1 << k) <= n)
        step = np.zeros(len(a), dtype=np.int64)
        step[inside] = (ranks[k][a[inside]] == ranks[k][b[inside]]) << k
        a, b = a + step, b + step
    lcp = np.concatenate([[0], a - order[:-1], [0]])
    lcp[lcp < least] = 0
    part = (lcp[:-1] > 0) | (lcp[1:] > 0)
    return order[part], lcp[:-1][part]


def maximal_pairs(ids: np.ndarray, places: np.ndarray, lcp: np.ndarray, periods: int) -> Iterator[tuple[int, int, int]]:
    """(i, j, words in common) of maximal pairs i < j that are at most words / (periods - 1) apart and nearest in a node.

    A node is (its places in order, the one class that all of them have or None). The class of a place is the word left
    of it; at the start of the text there is none, which is a class of its own.
    """
    left = np.concatenate([[-1], ids[:-1]]).tolist()
    stack: list[tuple[int, list[int], int | None]] = []  # (words in common with the node below, places, class)

    def join(shared: int, a: list[int], class_a: int | None, b: list[int], class_b: int | None):
        """b put into a, the larger one; pairs of neighbours of different classes."""
        pairs = []
        if class_a is None or class_a != class_b:
            far = shared // (periods - 1)
            for x in b:
                k = bisect_left(a, x)
                for y in a[max(k - 1, 0) : k + 1]:
                    if abs(x - y) <= far and left[x] != left[y]:
                        pairs.append((min(x, y), max(x, y), shared))
        if len(b) * 8 < len(a):
            for x in b:
                a.insert(bisect_left(a, x), x)
        else:
            a = sorted(a + b)
        return pairs, a, class_a if class_a == class_b else None

    def closed(down_to: int, node: list[int], own: int | None):
        """Nodes deeper than that, joined from the top."""
        pairs = []
        while stack and stack[-1][0] > down_to:
            shared, below, kind = stack.pop()
            small, large = sorted(((node, own), (below, kind)), key=lambda x: len(x[0]))
            more, node, own = join(shared, *large, *small)
            pairs += more
        return pairs, node, own

    node, own = [], None
    for place, shared in zip(places.tolist(), lcp.tolist(), strict=True):
        if node:
            pairs, node, own = closed(shared, node, own)
            yield from pairs
            if shared:
                stack.append((shared, node, own))
            else:
                stack.clear()
        node, own = [place], left[place]
    if node:
        yield from closed(0, node, own)[0]


def runs_of(ids: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run of at least `least` words and `periods` periods, by start and period."""
    window = max(1, -(-least * (periods - 1) // periods))
    if len(ids) < least or not _may_repeat(ids, window):
        return []
    places, lcp = sorted_suffixes(ids, window)
    found: dict[tuple[int, int], int] = {}
    for i, j, shared in maximal_pairs(ids, places, lcp, periods):
        length, period = shared + j - i, j - i
        if length >= least and length >= periods * period:
            key = (i, length)
            found[key] = min(period, found.get(key, period))  # multiples of the period pair the same stretch
    return sorted((start, length, period) for (start, length), period in found.items())


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words any run holds after its first period."""
    edges = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) > 0


def with_runs(docs: DataFrame, least: int = LEAST, periods: int = PERIODS, name: str = "periodic") -> tuple[DataFrame, str]:
    """docs (with a column text) with one struct column more (its name is returned): n_words, runs, and collapsed, the
    text's words without what repeats a run's first period, joined by spaces."""
    name = fresh(docs, name)
    out = T.StructType([*docs.schema.fields, T.StructField(name, FOUND)])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(k, BLOCK_ROWS)
                sizes, found, collapsed = [], [], []
                for text in part.column(at):
                    words = WORDS(text.as_py() or "")
                    runs = runs_of(numbered(words), least, periods) if len(words) >= least else []
                    sizes.append(len(words))
                    found.append([dict(zip(RUN.names, r, strict=True)) for r in runs])
                    collapsed.append(" ".join(itertools.compress(words, (~dropped(len(words), runs)).tolist()) if runs else words))
                said = pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(found, _RUNS), pa.array(collapsed, pa.string())], names=FOUND.names)
                yield pa.RecordBatch.from_arrays([*part.columns, said], names=out.names)

    return docs.mapInArrow(run, out), name
