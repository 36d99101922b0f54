"""SentencePiece encoding and decoding with merge-type vocabularies: an agenda of adjacent symbol pairs in order of score.

A text gets a leading mark, and spaces become marks. It is cut before every mark that follows another character: no
piece of the vocabulary holds these two side by side, so no merge crosses the cut. (Where a vocabulary has such pieces,
texts stay whole.) A word's characters are its first symbols. Pairs of neighbours that make a piece stand in an agenda,
the best score first, and of equal scores the leftmost; taking a pair merges it and puts the pairs with its new
neighbours in. Entries whose symbols have changed since are passed over. A symbol that is no piece becomes its bytes.

Words that a worker has met recently keep their ids, and every Arrow batch's new words are also given to the
sentencepiece library: ids that differ raise. Decoding joins the bytes of the ids from a table of the vocabulary.

Edge cases: a null text is empty and has the end id alone; texts that spell control pieces or bytes are ordinary text;
repeated rows are encoded one by one, and null or repeated ids are only carried; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import itertools
import math
import re
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor

from tablemill.llm.common import schema

MARK = "▁"
#: Words of at most so many characters are remembered, and so many at a time, twice (those lately met, and those before).
KEPT_CHARS, KEPT_WORDS = 48, 250_000
#: Words of at most so many symbols have their agenda in a list; longer ones in a heap.
SHORT, NEVER = 64, math.inf
#: Tokens that are hashed at a time, and documents in a batch of results.
BLOCK_TOKENS, BLOCK_ROWS = 1_000_000, 500
ENCODED = schema("doc_id long, n_tokens long, ids ints, ids_sha256 string, decoded_sha256 string")


class Vocabulary:
    """Pieces with their scores and ids, and the bytes that each id stands for."""

    def __init__(self, model: bytes) -> None:
        self.library = SentencePieceProcessor(model_proto=model)
        n = self.library.vocab_size()
        pieces = [self.library.id_to_piece(k) for k in range(n)]
        said = [k for k in range(n) if self.library.is_byte(k)]
        if len(said) != 256:
            raise ValueError("the vocabulary has no piece for each byte")
        self.byte_ids = {int(pieces[k][1:-1], 16): k for k in said}
        plain = [k for k in range(n) if not (self.library.is_byte(k) or self.library.is_control(k) or self.library.is_unknown(k) or self.library.is_unused(k))]
        self.ids = {pieces[k]: k for k in plain}
        self.costs = {pieces[k]: -self.library.get_score(k) for k in plain}
        self.end = self.library.eos_id()
        self.cut = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        plain_ids, byte_of = set(plain), {k: bytes([b]) for b, k in self.byte_ids.items()}
        self.marked = frozenset(k for k in plain if pieces[k].startswith(MARK))
        self.bytes = [pieces[k].replace(MARK, " ").encode() if k in plain_ids else byte_of.get(k, b"") for k in range(n)]

    def encode_word(self, word: str) -> tuple[int, ...]:
        out: list[int] = []
        for piece in merged(word, self.costs):
            found = self.ids.get(piece)
            out += [found] if found is not None else [self.byte_ids[b] for b in piece.encode()]
        return tuple(out)


def merged(word: str, costs: dict[str, float]) -> list[str]:
    """The symbols that are left when no two neighbours make a piece. costs: a piece's negative score."""
    return _merged_in_list(word, costs) if len(word) <= SHORT else _merged_in_heap(word, costs)


def _merged_in_list(word: str, costs: dict[str, float]) -> list[str]:
    """The agenda as a list by position, of which the least cost is looked for: fastest where it is short."""
    cost, symbols = costs.get, list(word)
    agenda = [cost(a + b, NEVER) for a, b in itertools.pairwise(symbols)]
    while agenda and (least := min(agenda)) < NEVER:
        k = agenda.index(least)  # the leftmost
        symbols[k] += symbols.pop(k + 1)
        del agenda[k]
        if k < len(agenda):
            agenda[k] = cost(symbols[k] + symbols[k + 1], NEVER)
        if k:
            agenda[k - 1] = cost(symbols[k - 1] + symbols[k], NEVER)
    return symbols


def _merged_in_heap(word: str, costs: dict[str, float]) -> list[str]:
    n = len(word)
    agenda = [(costs[pair], k, pair) for k, pair in enumerate(map(str.__add__, word, word[1:])) if pair in costs]
    heapify(agenda)
    symbols: list[str] = list(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while agenda:
        _, left, pair = heappop(agenda)
        right = after[left]
        if right >= n or len(symbols[left]) + len(symbols[right]) != len(pair) or not symbols[left]:
            continue  # one of the two has grown, or gone
        symbols[left], symbols[right] = pair, ""
        after[left] = right = after[right]
        if right < n:
            before[right] = left
            if (new := pair + symbols[right]) in costs:
                heappush(agenda, (costs[new], left, new))
        if (k := before[left]) >= 0 and (new := symbols[k] + pair) in costs:
            heappush(agenda, (costs[new], k, new))
    return [s for s in symbols if s]


class _Known(dict):
    """The ids of words (without their first mark), encoded when first asked for; of words not met for long none are kept."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.older, self.new = vocabulary, {}, []

    def __missing__(self, word: str) -> tuple[int, ...]:
        if (ids := self.older.get(word)) is None:
            ids = self.vocabulary.encode_word(MARK + word)
            self.new.append((word, ids))
        if len(word) <= KEPT_CHARS:
            self[word] = ids
        return ids

    def settle(self) -> None:
        """After a batch: new words against the library, and what was met lately becomes older."""
        words = [w for w, _ in self.new if w]
        for word, ids in zip(words, self.vocabulary.library.encode(words, num_threads=1), strict=True):
            if tuple(ids) != (self.get(word) or self.vocabulary.encode_word(MARK + word)):
                raise RuntimeError(f"the library encodes {word[:80]!r} otherwise")
        self.new = []
        if len(self) > KEPT_WORDS:
            self.older = dict(self)
            self.clear()


_knowns: dict[bytes, _Known] = {}


def _known(model: bytes) -> _Known:
    """What a worker remembers, kept from task to task."""
    digest = hashlib.blake2b(model, digest_size=16).digest()
    if digest not in _knowns:
        _knowns.clear()
        _knowns[digest] = _Known(Vocabulary(model))
    return _knowns[digest]


_cut = re.compile(f"{MARK}+[^{MARK}]*").findall


def words_of(text: str, cut: bool = True) -> list[str]:
    """The words of a text, each without its first mark. An empty text has none."""
    if not text:
        return []
    if not cut:
        return [text.replace(" ", MARK)]
    if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
        return [w[1:] for w in _cut(MARK + text.replace(" ", MARK))]
    return text.split(" ")


def _sha256(table: pa.Array, ids: np.ndarray, skip: int = 0, drop: int = 0) -> str:
    """SHA-256 of the joined entries of the table, without the first skip and the last drop bytes."""
    said = hashlib.sha256()
    for k in range(0, len(ids), BLOCK_TOKENS):
        part = table.take(pa.array(ids[k : k + BLOCK_TOKENS]))
        start, end = np.frombuffer(part.buffers()[1], np.int64, len(part) + 1)[[0, -1]]
        last = k + BLOCK_TOKENS >= len(ids)
        said.update(memoryview(part.buffers()[2] or b"")[start + (0 if k else skip) : end - (drop if last else 0)])
    return said.hexdigest()


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, model_file: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) for each row of docs (doc_id long, text), with an end id.

    decoded_sha256 is of the text that the ids decode to. with_ids=False leaves ids null where only digests are wanted.
    No shuffle; a task holds a batch of texts and the words it remembers.
    """
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_file))  # as large as a vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(model.value)
        vocabulary = known.vocabulary
        tokens = pa.array(vocabulary.bytes, pa.large_binary())
        numerals = pa.array([b"%d " % k for k in range(len(vocabulary.bytes))], pa.large_binary())
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                rows = []
                for text in part.column(1):
                    found = [known[w] for w in words_of(text.as_py() or "", vocabulary.cut)]
                    ids = np.fromiter(itertools.chain(itertools.chain.from_iterable(found), (vocabulary.end,)), np.int32)
                    spaced = int(ids[0]) in vocabulary.marked  # by the mark before the text
                    rows.append((len(ids), ids if with_ids else None, _sha256(numerals, ids, drop=1), _sha256(tokens, ids, skip=int(spaced))))
                known.settle()
                lists = pa.nulls(len(rows), pa.list_(pa.int32()))
                if with_ids:
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[r[0] for r in rows]]), pa.int32()), pa.array(np.concatenate([r[1] for r in rows])))
                columns = [part.column(0), pa.array([r[0] for r in rows], pa.int64()), lists, pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows])]
                yield pa.RecordBatch.from_arrays(columns, names=ENCODED.names)

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED)


#: As the library does: each byte that is no UTF-8 becomes one replacement mark.
codecs.register_error("tablemill-each-byte", lambda error: ("\ufffd", error.start + 1))


def decoder(table: list[bytes], marked: frozenset[int]) -> Callable[[list[int] | None], str]:
    """Ids to text, without the mark before it. table: the bytes of each id; marked: ids of pieces that begin with a mark."""

    def run(ids: list[int] | None) -> str:
        said = b"".join(map(table.__getitem__, ids or ()))
        spaced = next((k for k in ids or () if table[k]), None) in marked
        return said[int(spaced) :].decode("utf-8", "tablemill-each-byte")

    return run


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, decoded string) from rows (doc_id, ids): a lookup in the table of the vocabulary, which is broadcast."""
    vocabulary = Vocabulary(read_model(model_file))
    table = encoded.sparkSession.sparkContext.broadcast((vocabulary.bytes, vocabulary.marked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = decoder(*table.value)
        for batch in batches:
            texts = [said(ids.as_py()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, schema("doc_id long, decoded string"))
