"""Passages that repeat across documents, by sparse suffix arrays.

Of all suffixes only those at minimisers are kept: the least hash of GRAM words in each window of WINDOW positions, so
equal passages keep suffixes at equal places. The suffixes are sorted over range partitions by their first PREFIX words,
as two symbols: the hashes of the first half and of the rest. Neighbours are compared for the symbols that they have in
common; a suffix that has both in common with a neighbour from another document is a seed. Stretches of seeds that the
same documents share are extended left and right, word by word: each word with which a passage may begin or end gives a
hashed window of MIN_WORDS words, which must occur in another document.

A passage isn't extended against the sorted neighbour itself. That one has the longest match to the right; another
document may share less to the right and more to the left, and only with it the passage may be long enough.

Every passage of MIN_WORDS words holds a minimiser whose PREFIX words lie in the passage, so none is missed. A task holds
a batch of sorted suffixes, or all those of its range that begin alike: ranges end within a run that is too long.

Words are runs of letters and digits, compared in lower case. Edge cases: null text is empty; rows that agree in id and
text count as one document; shorter texts have no passages; repeats within one document alone don't count; null ids are
kept; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemill.llm.common import schema, stored

MIN_WORDS, GRAM, WINDOW = 50, 8, 20
PREFIX = MIN_WORDS - WINDOW + 1
WORD = re.compile(r"[^\W_]+")
_RANDOM = np.random.default_rng(31)
_A, _B = (_RANDOM.integers(0, 2**64, MIN_WORDS, dtype=np.uint64) | np.uint64(1) for _ in range(2))

SEEDS = schema("k0 long, k1 long, rk long, pos int")
FLAGGED = schema("rk long, pos int, sign long")
WINDOWS = schema("h0 long, h1 long, rk long, doc_id long, start int, start_char int, end_char int")


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.lower().encode())
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _hash_at(w: np.ndarray, at: np.ndarray, first: int, size: int, by: np.ndarray) -> np.ndarray:
    """Hashes of the words first..first+size after each position in at."""
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        h += w[at + (first + k)] * by[k]
    return _mix(h)


def minimisers(w: np.ndarray) -> np.ndarray:
    """Positions of the least GRAM-word hash in each window of WINDOW positions (the leftmost, if several)."""
    n = len(w) - GRAM + 1
    if n < 1:
        return np.empty(0, np.int64)
    grams = _hash_at(w, np.arange(n), 0, GRAM, _A)
    if n <= WINDOW:
        return np.array([int(grams.argmin())])
    out = []
    for k in range(0, n - WINDOW + 1, 100_000):
        part = np.lib.stride_tricks.sliding_window_view(grams[k : k + 100_000 + WINDOW - 1], WINDOW)
        out.append(np.unique(part.argmin(axis=1) + np.arange(k, k + len(part))))
    return np.unique(np.concatenate(out))


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    kinds = pa.schema([("k0", pa.int64()), ("k1", pa.int64()), ("rk", pa.int64()), ("pos", pa.int32())])
    half = PREFIX // 2
    for batch in batches:
        held, size = [], 0
        for rk, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = WORD.findall(text.as_py() or "")
            if len(words) < MIN_WORDS:
                continue
            w = np.array([hashes[x] for x in words], dtype=np.uint64)
            at = minimisers(w)
            at = at[at + PREFIX <= len(w)]
            held.append((_hash_at(w, at, 0, half, _A).view(np.int64), _hash_at(w, at, half, PREFIX - half, _B).view(np.int64), np.full(len(at), rk), at.astype(np.int32)))
            size += len(at)
            if size > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], schema=kinds)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], schema=kinds)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted suffixes the seeds (rk, pos, sign): those that begin like a neighbour from another document.

    sign is a fingerprint of the documents in the run of suffixes that begin alike. A partition's first and last run
    may go on elsewhere: their rows all count as seeds, each with a sign of its own, and false ones are found out later.
    """
    held: list[list[np.ndarray]] = []  # parts of the last run, which may go on in the next batch
    first = True
    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in range(4)]
        if not len(columns[0]):
            continue
        new = np.flatnonzero((columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])) + 1
        if not len(new) and (not held or (held[-1][0][-1], held[-1][1][-1]) == (columns[0][0], columns[1][0])):
            held.append(columns)
            continue
        whole = [np.concatenate(c) for c in zip(*held, columns, strict=True)]
        starts = np.flatnonzero((whole[0][1:] != whole[0][:-1]) | (whole[1][1:] != whole[1][:-1])) + 1
        yield from _runs([c[: starts[-1]] for c in whole], np.concatenate([[0], starts[:-1]]), first)
        held, first = [[c[starts[-1] :] for c in whole]], False
    if held:
        yield from _runs([np.concatenate(c) for c in zip(*held, strict=True)], np.zeros(1, np.int64), True)


def _runs(columns: list[np.ndarray], starts: np.ndarray, edge: bool) -> Iterator[pa.RecordBatch]:
    k0, _, rk, pos = columns
    sizes = np.diff(np.append(starts, len(rk)))
    other = np.ones(len(rk), dtype=bool)
    other[1:] = rk[1:] != rk[:-1]
    other[starts] = True
    signs = np.bitwise_xor.reduceat(np.where(other, _mix(rk.view(np.uint64) * _A[0]), np.uint64(0)), starts)
    several = np.add.reduceat(other.astype(np.int64), starts) > 1
    seed, sign = np.repeat(several, sizes), np.repeat(signs, sizes)
    if edge:
        seed[: sizes[0]] = True
        sign[: sizes[0]] = _mix(k0[: sizes[0]].view(np.uint64) + pos[: sizes[0]].astype(np.uint64))
    if seed.any():
        kinds = pa.schema([("rk", pa.int64()), ("pos", pa.int32()), ("sign", pa.int64())])
        yield pa.RecordBatch.from_arrays([pa.array(rk[seed]), pa.array(pos[seed]), pa.array(sign[seed].view(np.int64))], schema=kinds)


def window_starts(pos: np.ndarray, sign: np.ndarray, n: int) -> np.ndarray:
    """Starts of the windows to verify: at each seed, and around the ends of each stretch of seeds with the same
    documents, at every word with which a passage there may begin or end."""
    order = np.argsort(pos, kind="stable")
    pos, sign = pos[order], sign[order]
    breaks = np.flatnonzero((np.diff(pos) > WINDOW) | (sign[1:] != sign[:-1]))
    a = pos[np.concatenate([[0], breaks + 1])]
    b = pos[np.concatenate([breaks, [len(pos) - 1]])] + PREFIX - MIN_WORDS
    near = np.arange(WINDOW)
    starts = np.unique(np.concatenate([pos, (a[:, None] - near).ravel(), (b[:, None] + near).ravel()]))
    return starts[(starts >= 0) & (starts + MIN_WORDS <= n)]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    kinds = pa.schema([("h0", pa.int64()), ("h1", pa.int64()), ("rk", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32())])
    last = None
    for batch in batches:
        for rk, doc_id, text, seeds in zip(*(batch.column(k) for k in range(4)), strict=True):
            if (now := rk.as_py()) == last:
                continue  # rows that agree in id and text stand side by side
            last = now
            found = list(WORD.finditer(text.as_py() or ""))
            w = np.array([hashes[m[0]] for m in found], dtype=np.uint64)
            own = seeds.values
            at = window_starts(own.field("pos").to_numpy().astype(np.int64), own.field("sign").to_numpy(), len(w))
            if not len(at):
                continue
            columns = [
                _hash_at(w, at, 0, MIN_WORDS, _A).view(np.int64), _hash_at(w, at, 0, MIN_WORDS, _B).view(np.int64), np.full(len(at), rk.as_py()),
                pa.array([doc_id.as_py()] * len(at), pa.int64()), at.astype(np.int32),
                np.array([found[k].start() for k in at], np.int32), np.array([found[k + MIN_WORDS - 1].end() for k in at], np.int32),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=kinds)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, start_char, end_char): each maximal span of docs (doc_id long, text) that
    is covered by passages of MIN_WORDS words which occur in another document too. Offsets are in words and code points,
    ends exclusive. Documents without one have no row."""
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("rk"), "doc_id", "text")
    seeds = stored(keyed.select("rk", "text").mapInArrow(_seeds, SEEDS))
    # Sorting by all columns spreads a passage that very many documents share over several partitions.
    order = ["k0", "k1", "rk", "pos"]
    flagged = seeds.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, FLAGGED)
    by_doc = flagged.groupBy("rk").agg(F.collect_set(F.struct("pos", "sign")).alias("seeds"))  # once for rows that agree
    windows = stored(keyed.join(by_doc.hint("merge"), "rk").select("rk", "doc_id", "text", "seeds").mapInArrow(_windows, WINDOWS))
    # Counts are pre-aggregated; stored, so that the join shuffles on its own and Spark can split a hot window's rows.
    shared = stored(windows.groupBy("h0", "h1").agg(F.min("rk").alias("a"), F.max("rk").alias("b")).where("a <> b").select("h0", "h1"))
    hits = windows.join(shared, ["h0", "h1"], "left_semi")
    own = Window.partitionBy("rk").orderBy("start")
    fresh_span = F.col("start") > F.coalesce(F.lag("start").over(own), F.lit(-10 * MIN_WORDS)) + MIN_WORDS
    spans = hits.withColumn("new", fresh_span.cast("int")).withColumn("span", F.sum("new").over(own))
    return spans.groupBy("rk", "span").agg(
        F.min("doc_id").alias("doc_id"), F.min("start").cast("long").alias("start_word"), (F.max("start") + MIN_WORDS).cast("long").alias("end_word"),
        (F.max("start") - F.min("start") + MIN_WORDS).cast("long").alias("n_words"), F.min("start_char").cast("long").alias("start_char"), F.max("end_char").cast("long").alias("end_char"),
    ).drop("rk", "span")
