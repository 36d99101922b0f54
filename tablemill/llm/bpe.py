"""Byte-level BPE over a global shuffle of distinct words.

Texts are cut into pre-tokens once. Rows of a few thousand texts form a chunk, which becomes two kinds of rows: its
distinct pre-tokens, packed by the hash of the word, and the positions of its documents as word numbers. One shuffle
deals both: words to the part of their hash, so that equal words of all chunks meet in one task and each is encoded
once; positions to the task that will put the chunk together. The ids of a chunk's words are joined back to it, and
documents are reassembled by position. Decoding looks the ids up in the token-byte table, a broadcast of as many rows
as the vocabulary has.

Packed, a word costs a few bytes each way however often its chunk uses it; exploded rows of (document, position, word)
would shuffle many times the input. A task holds the distinct words of one part at a time, so
``spark.sql.shuffle.partitions`` sets what it needs: with more partitions there are more parts.

Both kinds of rows come from the same shuffle. Where Spark repeats a task of it after a loss, the same rows of the
input must come in the same order, as they do from files; rows that don't are found by the chunk's mark, and raise.

Edge cases: a null text is empty and has no ids; special tokens' strings are ordinary text; repeated rows are encoded
one by one; documents are found again by the order within their chunk, so null and repeated ids do no harm; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.llm.common import schema

#: Characters of text in a chunk: bounds what one task holds at a time. A longer document is a chunk of its own.
CHUNK_CHARS = 6_000_000
#: Word parts, at least: each chunk sends one packed row to each. With more shuffle partitions there are as many.
LEAST_PARTS = 48
#: Tokens that are hashed at a time.
BLOCK_TOKENS = 1_000_000

#: dest is where a row goes: -1 - part for words, the chunk for positions (part -1). It is never null, so a join on it
#: needs no filter, and both uses of the shuffle stay the same plan.
PIECES = T.StructType([T.StructField("dest", T.LongType(), False), *schema("chunk long, part int, mark long, doc_ids longs, sizes ints, packed binary")])
_PIECES = pa.schema([pa.field("dest", pa.int64(), nullable=False), ("chunk", pa.int64()), ("part", pa.int32()), ("mark", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("packed", pa.binary())])
IDS = T.StructType([T.StructField("home", T.LongType(), False), *schema("part int, mark long, packed_ids binary")])
_IDS = pa.schema([pa.field("home", pa.int64(), nullable=False), ("part", pa.int32()), ("mark", pa.int64()), ("packed_ids", pa.binary())])
ENCODED = schema("doc_id long, n_tokens long, ids ints, ids_sha256 string, decoded_sha256 string")


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def cutter(pattern: str) -> Callable[[str], list[str]]:
    """Cuts a text into pre-tokens. ASCII texts go through the same expression over ASCII classes, which is faster."""
    cut = regex.compile(pattern).findall
    ascii_classes, inside = [], False
    for c in re.findall(r"\\p\{[LN]\}|\\.|.", pattern, re.S):
        inside = c == "[" or inside and c != "]"
        known = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": r"\t-\r "}.get(c)
        if c == r"\S":
            known = None if inside else "^\\t-\\r "
        if c[0] == "\\" and known is None:
            return cut  # an expression with other classes
        ascii_classes.append(c if known is None else known if inside else f"[{known}]")
    plain = re.compile("".join(ascii_classes)).findall
    return lambda text: plain(text) if text.isascii() else cut(text)


def _pack(numbers: np.ndarray, rest: bytes = b"") -> bytes:
    """Whole numbers below 2^32, their bytes of equal weight together, and what follows them."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(np.uint32(len(numbers)).tobytes() + planes.tobytes() + rest)


def _unpack(packed: bytes) -> tuple[np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    planes = np.frombuffer(raw, np.uint8, 4 * n, 4).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(n), raw[4 + 4 * n :]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(doc ids, texts) of rows in their order."""
    ids, texts, chars = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            if texts and chars + len(text) > CHUNK_CHARS:
                yield ids, texts
                ids, texts, chars = [], [], 0
            ids.append(doc_id)
            texts.append(text)
            chars += len(text)
    if texts:
        yield ids, texts


def n_parts(df: DataFrame) -> int:
    return max(LEAST_PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def cut_and_number(docs: DataFrame, pattern: str, parts: int) -> DataFrame:
    """Rows of PIECES. A word's number is its place among the chunk's words in order of their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cutter(pattern)
        first = TaskContext.get().partitionId() << 32
        for chunk, (ids, texts) in enumerate(_chunks(batches), start=first):
            number: dict[str, int] = defaultdict(itertools.count().__next__)
            found = []
            for text in texts:
                pieces = cut(text)
                found.append(np.fromiter(map(number.__getitem__, pieces), np.uint32, len(pieces)))
            words = [w.encode() for w in number]
            part = np.fromiter((zlib.crc32(w) % parts for w in words), np.int64, len(words))
            order = np.argsort(part, kind="stable")
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)
            numbers = place[np.concatenate(found)]
            packed = _pack(numbers)
            mark = hashlib.blake2b(packed, digest_size=8)
            rows = []
            ends = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
            for p, (a, b) in enumerate(itertools.pairwise(ends)):
                if a < b or not len(words) and not p:  # a chunk without words sends an empty row
                    own = [words[k] for k in order[a:b].tolist()]
                    rows.append({"dest": -1 - p, "chunk": chunk, "part": p, "packed": _pack(np.fromiter(map(len, own), np.uint32, len(own)), b"".join(own))})
                    mark.update(rows[-1]["packed"])
            rows.append({"dest": chunk, "chunk": chunk, "part": -1, "doc_ids": ids, "sizes": [len(x) for x in found], "packed": packed})
            sign = int.from_bytes(mark.digest(), "little", signed=True)
            yield pa.RecordBatch.from_pylist([r | {"mark": sign} for r in rows], schema=_PIECES)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


class _Ids(dict):
    """The ids of each distinct word, encoded when it is first asked for."""

    def __init__(self, encode: Callable[[str], list[int]]) -> None:
        self.encode = encode

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        ids = self[word] = tuple(self.encode(word.decode()))
        return ids


_encoders: dict[tuple[int, str], Callable[[str], list[int]]] = {}


def _encoder(ranks: dict[bytes, int], pattern: str) -> Callable[[str], list[int]]:
    """The encoding of one word, made once for a worker."""
    if (key := (id(ranks), pattern)) not in _encoders:
        _encoders.clear()
        _encoders[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return _encoders[key]


def encode_words(pieces: DataFrame, ranks, pattern: str) -> DataFrame:
    """Rows of IDS: the ids of the packed words, in their order. pieces: dealt by dest, so that a part is in one task.

    ranks: a broadcast of the rank table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            columns = [batch.column(k) for k in (1, 2, 3, 6)]
            for chunk, part, mark, packed in zip(*columns, strict=True):
                if (part := part.as_py()) < 0:
                    continue
                if part != last:
                    last, known = part, _Ids(_encoder(ranks.value, pattern))
                sizes, raw = _unpack(packed.as_py())
                ends = np.cumsum(sizes, dtype=np.int64).tolist()
                ids = [known[raw[a:b]] for a, b in itertools.pairwise([0, *ends])]
                lengths = np.fromiter(map(len, ids), np.uint32, len(ids))
                flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lengths.sum()))
                row = {"home": chunk.as_py(), "part": part, "mark": mark.as_py(), "packed_ids": _pack(np.concatenate([lengths, flat]), np.uint32(len(ids)).tobytes())}
                yield pa.RecordBatch.from_pylist([row], schema=_IDS)

    return pieces.sortWithinPartitions("part", "chunk").mapInArrow(run, IDS)


def _sha256(table: pa.Array, ids: np.ndarray, drop: int = 0) -> str:
    """SHA-256 of the concatenated entries of the table, without the last drop bytes."""
    said = hashlib.sha256()
    for k in range(0, len(ids), BLOCK_TOKENS):
        part = table.take(pa.array(ids[k : k + BLOCK_TOKENS]))
        start, end = np.frombuffer(part.buffers()[1], np.int64, len(part) + 1)[[0, -1]] if len(part) else (0, 0)
        said.update(memoryview(part.buffers()[2])[start : end - (drop if k + BLOCK_TOKENS >= len(ids) else 0)])
    return said.hexdigest()


def encode(docs: DataFrame, rank_file: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) for each row of docs (doc_id long, text).

    with_ids=False leaves ids null where only the digests are wanted.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_file))  # one row per token of the vocabulary
    # One shuffle with two uses, which Spark runs once. Its rows are few, large and even.
    pieces = cut_and_number(docs, pattern, n_parts(docs)).repartition("dest")
    ids = encode_words(pieces, ranks, pattern)
    # At most one row for each part of a chunk.
    by_chunk = ids.groupBy("home").agg(F.collect_list(F.struct("part", "mark", "packed_ids")).alias("found"))
    # Words have a negative dest and find no partner; nothing may be filtered before the shuffle, or it would run twice.
    both = pieces.join(by_chunk, F.col("dest") == F.col("home")).select("chunk", "part", "mark", "doc_ids", "sizes", "packed", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = {rank: token for token, rank in ranks.value.items()}
        tokens = pa.array([by_id.get(k, b"") for k in range(max(by_id) + 1)], pa.large_binary())
        numerals = pa.array([b"%d " % k for k in range(max(by_id) + 1)], pa.large_binary())
        for batch in batches:
            for k in range(len(batch)):
                row = {c: batch.column(c)[k] for c in ("mark", "doc_ids", "sizes", "packed", "found")}
                yield from _together(row, tokens, numerals, with_ids)

    return both.mapInArrow(run, ENCODED)


def _together(row: dict[str, pa.Scalar], tokens: pa.Array, numerals: pa.Array, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """The documents of one chunk."""
    found = sorted(row["found"].as_py(), key=lambda x: x["part"])
    lengths, flat = [], []
    for x in found:
        if x["mark"] != row["mark"].as_py():
            raise RuntimeError("words and positions of a chunk come from different runs over the input: store it first")
        numbers, rest = _unpack(x["packed_ids"])
        n = int(np.frombuffer(rest, "<u4", 1)[0])
        lengths.append(numbers[:n])
        flat.append(numbers[n:])
    lengths, flat = np.concatenate(lengths).astype(np.int64), np.concatenate(flat)
    starts = np.cumsum(lengths) - lengths
    numbers, _ = _unpack(row["packed"].as_py())
    if len(lengths) != (int(numbers.max()) + 1 if len(numbers) else 0):  # the last word is used, as all are
        raise RuntimeError("ids of some words of a chunk are missing")
    at, out = 0, []
    for size in row["sizes"].as_py():
        own = numbers[at : at + size]
        at += size
        sizes = lengths[own]
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if size else 0
        ids = flat[np.repeat(starts[own] - (ends - sizes), sizes) + np.arange(n)]
        out.append((n, ids if with_ids else None, _sha256(numerals, ids, drop=1), _sha256(tokens, ids)))
    doc_ids = pa.array(row["doc_ids"].as_py(), pa.int64())
    for k in range(0, len(out), 500):
        part = out[k : k + 500]
        ids = pa.nulls(len(part), pa.list_(pa.int32()))
        if with_ids:
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[x[0] for x in part]]), pa.int32()), pa.array(np.concatenate([x[1] for x in part]).astype(np.int32)))
        columns = [doc_ids[k : k + 500], pa.array([x[0] for x in part], pa.int64()), ids, pa.array([x[2] for x in part]), pa.array([x[3] for x in part])]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])


def decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """(doc_id, decoded binary) from rows (doc_id, ids): a lookup in the token-byte table, which is broadcast."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(rank_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_bytes = {rank: token for token, rank in ranks.value.items()}
        for batch in batches:
            raw = [b"".join(map(token_bytes.__getitem__, ids.as_py() or ())) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, schema("doc_id long, decoded binary"))
