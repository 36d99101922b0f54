"""Periodic runs, SentencePiece and the filter audit: brute force, the library, and awkward rows."""

import collections
import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tablemill.llm import filter_audit, periodic_runs, queries, sentencepiece_bpe
from tests.llm.helpers import awkward, docs

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Periodic runs


def brute_runs(w, least=24, periods=3):
    """Every period at every place, by definition."""
    out, n = {}, len(w)
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, periods * q):
                out.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, length, q) for (s, length), q in out.items())


def fibonacci(n):
    a, b = [0], [1]
    while len(a) < n:
        a, b = a + b, a
    return a[:n]


def periodic(rnd, n):
    block = [rnd.randrange(3) for _ in range(rnd.randint(1, 9))]
    made = []
    while len(made) < n:
        made += block * rnd.randint(1, 8) + [rnd.randrange(50)] * rnd.randint(0, 2)
    return made


def tail(rnd, n):
    base = [rnd.randrange(40) for _ in range(n)]
    a, p = rnd.randint(0, n), rnd.randint(1, 20)
    return base[:a] + [base[a + i % p] if a + i % p < n else 0 for i in range(n - a)]


@pytest.mark.parametrize("least, periods", [(24, 3), (8, 2), (6, 3), (10, 4), (1, 2)])
def test_runs_by_brute_force(least, periods):
    rnd, found = random.Random(least), 0
    for _ in range(250):
        n = rnd.randint(0, 140)
        for w in ([rnd.randrange(2) for _ in range(n)], [0] * n, fibonacci(n), periodic(rnd, n), tail(rnd, n)):
            want = brute_runs(w, least, periods)
            assert periodic_runs.runs_of(np.array(w, dtype=np.int64), least, periods) == want
            found += len(want)
    assert found > 200


def test_runs_of_long_texts_take_little_time():
    """One word, one long tail, Fibonacci words, a passage behind a thousand different words: no step is quadratic."""
    rnd = random.Random(3)
    passage = sum(([rnd.randrange(10**6)] + list(range(20)) for _ in range(4000)), [])
    texts = {1: [0] * 100_000, 1.5: [rnd.randrange(10**6) for _ in range(20_000)] * 5, None: fibonacci(100_000), 0: passage}
    for n, w in texts.items():
        began = time.perf_counter()
        runs = periodic_runs.runs_of(np.array(w, dtype=np.int64))
        assert time.perf_counter() - began < 20
        if n is not None:
            assert len(runs) == (n > 0)
        for start, length, q in runs[:50]:
            assert w[start : start + length - q] == w[start + q : start + length]


def planted(doc_id, text):
    words = WORDS.findall(text or "")
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def digests(doc_id, text):
    words = planted(doc_id, text)
    runs = brute_runs(words)
    gone = {k for start, length, q in runs for k in range(start + q, start + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    tops = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *tops, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_runs_of_given_texts(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in rows if len(r["text"] or "") < 9000]  # brute force is quadratic
    found = {r["doc_id"]: tuple(r) for r in queries.op11_periodic_runs(spark, small).collect()}
    assert len(found) == len(rows) and len(short) > 180
    for r in short:
        assert found[r["doc_id"]] == digests(r["doc_id"], r["text"])
    assert sum(r[1] > 0 for r in found.values()) > 10


def test_runs_of_awkward_rows(spark, tmp_path):
    rows = awkward(spark)
    out, name = periodic_runs.with_runs(rows.withColumn("periodic", F.lit(1)))
    assert name == "periodic_" and out.columns[:-1] == [*rows.columns, "periodic"]
    found = collections.Counter((r["doc_id"], r["text"], r[name]["n_words"], r[name]["collapsed"], tuple(map(tuple, r[name]["runs"]))) for r in out.collect())
    want = collections.Counter()
    for r in rows.collect():
        words = WORDS.findall(r["text"] or "")
        runs = brute_runs(words) if len(words) < 2000 else ()
        gone = {k for start, length, q in runs for k in range(start + q, start + length)}
        want[r["doc_id"], r["text"], len(words), " ".join(w for k, w in enumerate(words) if k not in gone), tuple(runs)] += 1
    assert found == want and any(k[4] for k in want)
    assert periodic_runs.with_runs(rows.limit(0))[0].count() == 0
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect() if (r["doc_id"] or 0) != 8} == {digests(r["doc_id"], r["text"]) for r in rows.collect() if (r["doc_id"] or 0) != 8}


# SentencePiece


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepiece_bpe.Vocabulary(sentencepiece_bpe.read_model(queries.PIECE_MODEL))


ODD = "a b  ▁ é①ﬁ<s>0x\n\t\0日本語ü🙂</>ing thеtion　\xa0�"


def test_agenda_is_the_librarys(vocabulary):
    rnd = random.Random(1)
    library, said = vocabulary.library, sentencepiece_bpe.decoder(vocabulary.bytes, vocabulary.marked)
    for _ in range(5000):
        text = "".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 16)))
        for cut in (True, False):
            ids = [k for w in sentencepiece_bpe.words_of(text, cut) for k in vocabulary.encode_word("▁" + w)] + [vocabulary.end]
            assert ids == library.encode(text, add_eos=True), text
        assert said(ids) == library.decode(ids)


def test_list_and_heap_agree(vocabulary):
    rnd = random.Random(2)
    for n in (0, 1, 2, 30, 64, 65, 500, 6000):
        for letters in ("thesingabc", "▁▁▁", "▁a", "aé日🙂t"):
            word = "".join(rnd.choice(letters) for _ in range(n))
            made = sentencepiece_bpe._merged_in_list(word, vocabulary.costs)
            assert made == sentencepiece_bpe._merged_in_heap(word, vocabulary.costs) and "".join(made) == word


def test_decoding_any_ids(vocabulary):
    rnd, said = random.Random(4), sentencepiece_bpe.decoder(vocabulary.bytes, vocabulary.marked)
    unknown = vocabulary.library.unk_id()
    for _ in range(5000):
        ids = [rnd.choice([rnd.randrange(len(vocabulary.bytes)), rnd.randrange(1, 260)]) for _ in range(rnd.randint(0, 7))]
        ids = [k for k in ids if k != unknown]  # encoding never gives it
        assert said(ids) == vocabulary.library.decode(ids), ids


def test_a_long_word_takes_little_time(vocabulary):
    began = time.perf_counter()
    word = "▁" + "thesingabc" * 20_000
    assert list(vocabulary.encode_word(word)) == vocabulary.library.encode(word[1:]) and time.perf_counter() - began < 20


def test_remembered_words_are_few(vocabulary, monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "KEPT_WORDS", 10)
    known = sentencepiece_bpe._Known(vocabulary)
    for k in range(100):
        assert known[f"word{k}"] == known[f"word{k}"] == vocabulary.encode_word(f"▁word{k}")
        assert known["x" * 100] and "x" * 100 not in known
        known.settle()
        assert len(known) + len(known.older) <= 22


def test_another_answer_of_the_library_raises(vocabulary):
    known = sentencepiece_bpe._Known(vocabulary)
    known["word"] = known["word"][:-1] + (5,)
    with pytest.raises(RuntimeError, match="word"):
        known.settle()


def library_row(library, doc_id, text):
    ids = library.encode(text or "", add_eos=True)
    return doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))


@pytest.mark.parametrize("given", [True, False])
def test_rows_are_the_librarys(spark, small, tmp_path, given):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    if not given:
        small = str(tmp_path)
        awkward(spark).union(docs(spark, [(20, "<s> </s> <0x41> ▁▁a  b "), (21, " lead"), (22, "trail "), (23, "\0"), (24, " "), (25, "  x"), (26, "▁")])).write.parquet(f"{small}/documents.parquet")
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    want = collections.Counter(library_row(library, r["doc_id"], r["text"]) for r in rows.collect())
    assert collections.Counter(map(tuple, queries.op12_sentencepiece(spark, small).collect())) == want


def test_ids_and_their_texts(spark):
    rows = awkward(spark)
    out = sentencepiece_bpe.encode(rows, queries.PIECE_MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    assert all(r["n_tokens"] == len(r["ids"]) and sha(library.decode(r["ids"])) == r["decoded_sha256"] for r in out.collect())
    back = collections.Counter((r["doc_id"], r["decoded"]) for r in sentencepiece_bpe.decode(out, queries.PIECE_MODEL).collect())
    assert back == collections.Counter((r["doc_id"], r["text"] or "") for r in rows.collect())
    assert sentencepiece_bpe.encode(rows.limit(0), queries.PIECE_MODEL).count() == 0


# Filter audit


def brute_audit(rows, labels):
    """Every order applied to every document, one by one."""
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    quality, toxic = ({k for k, *v in labels if v[at] == 1 and k is not None} for at in (0, 1))

    def fails(doc_id, text):
        w = WORDS.findall(text)
        said = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text))]
        return "".join(c for c, x in zip("ABCDE", [*said, doc_id is not None and doc_id > least[text]], strict=True) if x)

    parts = collections.defaultdict(list)
    for doc_id, text, lang in rows:
        parts[lang or ""].append((doc_id, fails(doc_id, text or "")))
    out, shapley = {}, collections.Counter()
    for part, judged in parts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = judged
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[1]]
                before = [d for d in judged if letter in d[1] and set(d[1]) & set(order[: step - 1])]
                left = [d for d in left if letter not in d[1]]
                out[part, order, step] = (len(left), len(gone), len(before), sum(d[1] == letter for d in judged), sum(d[0] in quality for d in gone), sum(d[0] in toxic for d in gone))
                shapley[part, letter] += len(gone)
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(df):
    return [tuple(r) for r in df.select("part", "filter_order", "step", *filter_audit.METRICS, "shapley").collect()]


def test_audit_by_brute_force(spark):
    rnd = random.Random(6)
    long = " ".join(f"w{k}" for k in range(250))
    texts = [long, long + " #", "word " * 300, "SHOUT " * 220, "short", "", None, long + " Aa" * 200, "A" * 30 + " $"]
    rows = [(rnd.choice([None, *range(60)]), rnd.choice(texts), rnd.choice(["en", "de", "", None])) for _ in range(300)]
    labels = [(k, rnd.randrange(2), rnd.randrange(2)) for k in range(0, 90, 2)] + [(None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, mask int, part string")
    labelled = spark.createDataFrame(labels + labels[:5], "doc_id long, quality int, toxic int")
    found = audited(filter_audit.audit(docs, labelled))
    assert len(found) == 3 * 600 and set(found) == brute_audit(rows, labels)
    alone = audited(filter_audit.audit(docs))
    assert {(*r[:7], r[9]) for r in alone} == {(*r[:7], r[9]) for r in found} and all(r[7] == r[8] == 0 for r in alone)


def test_audit_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_audit_of_many_parts(spark):
    """More rows of recursion than Spark's default limit, and the limit as it was afterwards."""
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "1000")
    try:
        docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("few words").alias("text"), F.col("id").cast("string").alias("lang"))
        out = filter_audit.audit(docs)
        assert out.count() == 40 * 600 and spark.conf.get(limit) == "1000"
    finally:
        spark.conf.set(limit, before)
