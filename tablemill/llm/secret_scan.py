"""Secret scans: fixed patterns, and password guess cost by dynamic programming for values in credential contexts.

Patterns find the spans of known shape. Beyond them, each value that stands where a credential stands (``pwd = ...``,
``client secret: ...``) is cut into the cheapest sequence of dictionary words, dates, repeats, keyboard walks and
brute-force stretches; the log10 of guesses of that sequence decides. A value like ``changeme2020`` is cheap to guess
and left alone, ``x8#Kq0vLw2`` is dear and is reported as a span of kind ``guess``.

Words cost their rank in public vocabularies, of which two are of many languages, or, if that is less, how rare they are
in the corpus: one of n documents, of all that have the word outside credential contexts, so that a secret doesn't become
a word by being copied. Only words of values that seem dear are counted, over all documents. A name of code, such as
``config.settings.API_KEY`` or ``get_token(request)``, refers to a value, and a quoted sentence describes one: they cost
no more than the dearest of their words.

Edge cases: null text is empty; overlapping spans of different kinds all stay; of each kind spans don't overlap;
repeated rows are scanned one by one; very long values cost linear time, because no segment is longer than REACH, and
mostly less, because their judgement is clear before their end.
Spans are in code points, end exclusive, and cover the whole match (key and value for ``assign``, the value alone for
``guess``).
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator, Mapping
from itertools import islice
from pathlib import Path
from types import MappingProxyType

import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor

from tablemill.llm.common import BROADCAST_ROWS, fresh, schema, stored

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Only a long run can be a hex secret; a cheap test before the pattern above, which stops at every a-f and digit.
HEX_LONG = re.compile(r"[0-9a-f]{24}")
#: A quoted value goes up to its closing quote on the line, any other up to white space or a mark.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|bearer|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth)["']?\x20*(?::|=>?)\x20*(?:(["'`])((?:\\.|(?!\1)[^\\\n])+)\1|["'`]?([^\s"'`,;<>]+))""",
    re.I | re.A,
)
CONTEXT_HINT = re.compile(r"pass|pwd|secret|token|credential|bearer|key|auth", re.I | re.A)
KINDS = ("assign", "access", "hex", "guess")
BASE_KINDS = KINDS[:3]

#: A value is a secret from so many guesses (log10) and so many characters on.
GUESSES, MIN_VALUE = 10.0, 8
MAX_SEGMENT = 40
#: Common words of passwords, the most common first.
COMMON = """
password qwerty admin welcome login letmein monkey dragon master sunshine princess football baseball shadow michael
superman batman hello freedom whatever trust secret access change changeme default root user guest test example sample
demo temp temporary system server database service account private public token key api value string null none true
false your here insert replace placeholder dummy foo bar baz love money summer winter spring autumn flower computer
internet office company home world orange apple banana cookie coffee cheese pepper ginger soccer hockey tiger eagle
horse puppy kitty angel baby star magic happy lucky sweet black white green blue red purple silver golden diamond
hunter ranger killer thunder storm fire water earth light dark night morning january february march april june july
august september october november december monday tuesday wednesday thursday friday saturday sunday google amazon
facebook twitter github docker linux ubuntu windows android apache mysql postgres oracle redis prod production dev
development staging release version config environment variable iloveyou trustno thequickbrownfox correcthorsebatterystaple
""".split()  # fmt: skip


def words_of_ranks(path: str) -> list[str]:
    """Entries of a rank file, which has them by how common they are."""
    return [base64.b64decode(line.split()[0]).decode("utf-8", "ignore").strip() for line in Path(path).read_bytes().splitlines() if line]


def words_of_pieces(path: str) -> list[str]:
    """Whole words among the pieces of a sentencepiece model, likewise."""
    model = SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(k) for k in range(model.vocab_size()))
    return [p[1:] for p in pieces if p.startswith("\u2581")]


def ranked(*vocabularies: list[str]) -> dict[str, int]:
    """Words by their best rank: those of passwords, and words of running text."""
    ranks = {w: k for k, w in enumerate(COMMON, start=1)}
    for said in vocabularies:
        for k, w in enumerate(dict.fromkeys(w for x in said if 3 <= len(w := x.lower()) <= 24 and w.isalpha()), start=1):
            ranks[w] = min(k, ranks.get(w, k))
    return ranks


#: A word costs its rank.
WORDS = ranked(*[words_of_ranks(public_tokenizers.path(n)) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")], words_of_pieces(public_tokenizers.path("piece_bpe_32k.model")))
WORD_MAX = max(map(len, WORDS))
#: Words of the corpus that are counted: letters alone, from so many to so many, in so many documents at least.
CORPUS_WORD = re.compile(r"[^\W\d_]{4,40}")
LEAST_DOCUMENTS = 3
#: The longest segment.
REACH = max(MAX_SEGMENT, WORD_MAX, 40)
LEET = str.maketrans("01345$@7", "oleassat")
#: Rows of keys, each half a key to the right of the one above, and the alphabet as a row of its own.
BOARDS = (("1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./"), ("abcdefghijklmnopqrstuvwxyz",))
#: Of each board the direction from a key to each key beside it: on its row, or on the next one, to either side.
STEPS = [
    {(a, b): (y, x) for r, row in enumerate(board) for i, a in enumerate(row) for y, x in ((0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1))
     if 0 <= r + y < len(board) and 0 <= i + x < len(board[r + y]) for b in board[r + y][i + x]}
    for board in BOARDS
]
#: Guesses of a walk: a start and a direction, its length, and at each turn another direction.
WALKS, TURNS = 180, 5
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")


def _class(c: str) -> str:
    return "digit" if c.isdigit() else "other" if not c.isascii() else "upper" if c.isupper() else "lower" if c.isalpha() else "symbol"


CLASS_SIZE = {"digit": 10, "lower": 26, "upper": 26, "symbol": 33, "other": 100}


def guess_cost(value: str, enough: float = math.inf, learned: Mapping[str, float] = MappingProxyType({})) -> float:
    """log10 of the guesses for value: the least over all segmentations, each further segment doubles the guesses.

    Costs only grow along a segmentation, and none steps over REACH places: once so many places in a row cost enough, so
    does the whole value, and a lower bound of its cost is returned. learned: words of the corpus, with their guesses.
    """
    longest = max([WORD_MAX, *map(len, learned)])
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    # Brute force: any character may come from any class that the value uses.
    each = math.log10(sum(CLASS_SIZE[k] for k in {_class(c) for c in value}) or 1)
    step = math.log10(2)
    best = [0.0] + [math.inf] * n
    repeat = 1
    walks, turns = [1] * len(STEPS), [[0] * (n + 1) for _ in STEPS]
    dear = 0
    for j in range(1, n + 1):
        if (dear := dear + 1 if best[j - 1] >= enough else 0) >= REACH:
            return min(best[j - REACH : j])
        best[j] = best[j - 1] + each
        same = j > 1 and value[j - 1] == value[j - 2]
        repeat = repeat + 1 if same else 1
        for size in range(3, min(repeat, MAX_SEGMENT) + 1):
            best[j] = min(best[j], best[j - size] + step + math.log10(CLASS_SIZE[_class(value[j - 1])] * size))
        for b, steps in enumerate(STEPS):
            way = steps.get((low[j - 2], low[j - 1])) if j > 1 else None
            turned = way and walks[b] > 1 and steps[low[j - 3], low[j - 2]] != way
            walks[b] = walks[b] + 1 if way else 1
            turns[b][j] = turns[b][j - 1] + bool(turned)
            for size in range(3, min(walks[b], MAX_SEGMENT) + 1):
                own = turns[b][j] - turns[b][j - size + 2]
                best[j] = min(best[j], best[j - size] + step + math.log10(WALKS * size) + own * math.log10(TURNS))
        for size in range(3, min(j, longest) + 1):
            for said, extra in ((low[j - size : j], 1), (plain[j - size : j], 4)):
                if rank := min(WORDS.get(said, 0) or math.inf, learned.get(said, math.inf)) if learned else WORDS.get(said):
                    if rank == math.inf:
                        continue
                    shape = value[j - size : j]
                    best[j] = min(best[j], best[j - size] + step + math.log10(rank * extra * (1 if shape.islower() else 3)))
        for size in (4, 6, 7, 8, 10):
            if size <= j and DATE.fullmatch(value, j - size, j):
                best[j] = min(best[j], best[j - size] + step + math.log10(365 * 120 if size > 4 else 120))
    return best[n]


#: A name of code that is looked into, called, or has parts: not a value itself.
NAME = re.compile(r"[A-Za-z_$][\w$]*(?:(?:\.|->|::)[A-Za-z_$][\w$]*)*")


def parts_of(value: str) -> list[str]:
    """What a value is judged by: its words if it is a sentence or a name of code with parts, else all of it."""
    if len(words := value.split()) > 1:
        return words
    name = NAME.match(value)
    rest = value[name.end() :] if name else ""
    if name and (rest[:1] in "([" if rest else re.search(r"\.|->|::", name[0])):
        return [w for w in re.split(r"[^A-Za-z0-9]+", value) if w]
    return [value]


def is_guarded(value: str, learned: Mapping[str, float] = MappingProxyType({})) -> bool:
    """Whether the value is dear enough to guess; its least cost alone decides, or that of its dearest part."""
    return len(value) >= MIN_VALUE and any(len(p) >= MIN_VALUE and guess_cost(p, GUESSES, learned) >= GUESSES for p in parts_of(value))


def context_values(text: str) -> Iterator[tuple[int, str]]:
    """(start, value) where credentials stand."""
    for m in CONTEXT.finditer(text):
        yield (m.start(2), m[2]) if m[2] else (m.start(3), m[3].rstrip(".!?)]}"))


def scan(text: str | None, learned: Mapping[str, float] = MappingProxyType({})) -> list[tuple[int, int, int]]:
    """(start, kind as an index of KINDS, end), sorted."""
    text = text or ""
    found = []
    hinted = CONTEXT_HINT.search(text)
    if hinted:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    at = 0
    while m := HEX_LONG.search(text, at):  # the run's start: no shorter failing match can reach into it
        whole = HEX.match(text, m.start())
        found.append((whole.start(), 2, whole.end()))
        at = whole.end()
    if hinted:
        found += [(start, 3, start + len(value)) for start, value in context_values(text) if is_guarded(value, learned)]
    return sorted(found)


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCANNED = schema("n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, redacted string")


def _scanned(text: str | None, learned: Mapping[str, float]) -> tuple:
    spans = scan(text, learned)
    base = [s for s in spans if s[1] < len(BASE_KINDS)]
    counts = [sum(s[1] == k for s in spans) for k in range(len(KINDS))]
    return (*counts, hashlib.sha256(_said(base).encode()).hexdigest(), _said(spans), redact(text, spans) if spans else None)


def _scanner(learned: Mapping[str, float]):
    @F.pandas_udf(SCANNED)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([_scanned(text, learned) for text in batch], columns=SCANNED.names)

    return run


@F.pandas_udf(SCANNED)
def _scanner_of_own(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Each text with the learned words that it may hold, and their guesses."""
    for texts, words, guesses in batches:
        rows = [_scanned(t, {} if w is None else dict(zip(w, g, strict=True))) for t, w, g in zip(texts, words, guesses, strict=True)]
        yield pd.DataFrame(rows, columns=SCANNED.names)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _doubtful(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Words of values that seem dear."""
    for batch in texts:
        found = ({w.lower() for _, v in context_values(t) if is_guarded(v) for w in CORPUS_WORD.findall(v)} if t and CONTEXT_HINT.search(t) else () for t in batch)
        yield pd.Series([sorted(x) for x in found])


def _met(words: frozenset[str] | None):
    """Of a text the distinct words outside credential contexts; of these words alone, if they are given."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out = []
            for text in batch:
                text = text or ""
                if CONTEXT_HINT.search(text):
                    text = CONTEXT.sub(" ", text)
                found = set(CORPUS_WORD.findall(text.lower()))
                out.append(sorted(found if words is None else found & words))
            yield pd.Series(out)

    return run


def learned_words(docs: DataFrame, text: str = "text") -> DataFrame | None:
    """(word, guesses): words of dear values that running text of the corpus has, with documents for each that has them.

    Two passes over the texts. The words are few, as dear values are; where they aren't, they are counted by a join.
    None: there are no dear values.
    """
    doubtful = stored(docs.select(F.explode(_doubtful(text)).alias("word")).distinct())
    few = [r["word"] for r in doubtful.limit(BROADCAST_ROWS + 1).collect()]
    if not few:
        return None
    small = len(few) <= BROADCAST_ROWS
    met = docs.select(F.explode(_met(frozenset(few) if small else None)(text)).alias("word"))
    met = met if small else met.join(doubtful, "word", "left_semi")
    found = met.groupBy("word").count().where(F.col("count") >= LEAST_DOCUMENTS)
    return stored(found.select("word", (F.lit(docs.count()).cast("double") / F.col("count")).alias("guesses")))


def _few(found: DataFrame) -> dict[str, float] | None:
    """Words and guesses of learned_words(); None if they are more than a broadcast may hold."""
    rows = found.limit(BROADCAST_ROWS + 1).collect()
    return {r["word"]: r["guesses"] for r in rows} if len(rows) <= BROADCAST_ROWS else None


def learn(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """All of learned_words(), as scan() takes them. Raises if they are more than a broadcast may hold; with_secrets()
    takes any number."""
    found = learned_words(docs, text)
    words = {} if found is None else _few(found)
    if words is None:
        raise ValueError(f"more than {BROADCAST_ROWS} learned words: with_secrets() joins them")
    return words


SOUGHT = "text_key string, word string"
LETTERS = re.compile(r"[^\W\d_]{4,}")
SOUGHT_ROWS = 50_000


def sought_words(text: str | None) -> Iterator[str]:
    """All that could be a word of the corpus in values that seem dear: stretches of letters as guess_cost() looks them up."""
    if not text or not CONTEXT_HINT.search(text):
        return
    for part in {p for _, v in context_values(text) if is_guarded(v) for p in parts_of(v) if len(p) >= MIN_VALUE}:
        low = part.lower()
        for run in {r for said in (low, low.translate(LEET)) for r in LETTERS.findall(said)}:
            yield from (run[a : a + size] for a in range(len(run) - 3) for size in range(4, min(40, len(run) - a) + 1))


def _sought(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_key, text) to SOUGHT, some rows at a time however long a value is."""
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = sought_words(text)
            while some := list(islice(words, SOUGHT_ROWS)):
                yield pa.RecordBatch.from_pydict({"text_key": pa.array([key] * len(some), pa.string()), "word": pa.array(some, pa.string())})


def _with_own_words(docs: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """docs scanned with all words found, too many for a broadcast: each text is joined with those that its values hold.
    Words that a value doesn't hold can't change its cost."""
    key, own = fresh(docs, "text_key"), fresh(docs, "own_words")
    said = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    sought = docs.select(said.alias("text_key"), "text").mapInArrow(_sought, SOUGHT).distinct()
    per = sought.join(found, "word").groupBy(F.col("text_key").alias(key)).agg(F.collect_list(F.struct("word", "guesses")).alias(own))  # a text's own words
    joined = docs.withColumn(key, said).join(stored(per), key, "left")
    return joined.withColumn(name, _scanner_of_own("text", F.col(f"{own}.word"), F.col(f"{own}.guesses"))).drop(key, own)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """text with each run of overlapping spans replaced by the mark."""
    out, at = [], 0
    for a, _, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def with_secrets(docs: DataFrame, name: str = "secrets") -> tuple[DataFrame, str]:
    """docs with a struct column more (its name is returned): counts, spans, and the redacted text where there are spans.
    The corpus is read twice before, to learn its words."""
    name = fresh(docs, name)
    found = learned_words(docs)
    few = {} if found is None else _few(found)
    if few is None:
        return _with_own_words(docs, found, name), name
    return docs.withColumn(name, _scanner(few)("text")), name


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every secret in text replaced by a mark, and n_chars, if there is one, counted again."""
    out, s = with_secrets(docs)
    text: Column = F.coalesce(F.col(s)["redacted"], F.col("text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(s)["redacted"].isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long"))
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
