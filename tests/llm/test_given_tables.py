"""Registered queries and pipeline stages over a given table, against brute force over the same rows."""

import collections
import hashlib
import html
import re
import zlib

import numpy as np
import pytest
import tiktoken

import corpus_pipeline
from tablemill.llm import bpe, queries, secret_scan
from tablemill.scratch import stored
from tests.llm.test_group_operators import brute_links, brute_passages, collected, shingle_set, water_fill


@pytest.fixture(scope="module")
def given(spark, small):
    return collected(spark.read.parquet(f"{small}/documents.parquet"))


LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def more(spark):
    return collected(spark.read.parquet(f"{LARGER}/documents.parquet"))


@pytest.fixture(scope="module")
def tokenizer():
    return tiktoken.Encoding("test", pat_str=queries.PATTERN, mergeable_ranks=bpe.read_ranks(queries.RANK_FILE), special_tokens={})


def test_main_text_is_the_article(spark, small):
    pages = {r["page_id"]: r for r in collected(spark.read.parquet(f"{small}/pages.parquet"))}
    found = collected(queries.op3_html_extraction(spark, small))
    assert len(found) == len(pages)
    for r in found:
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]]["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1|article|div|ul|li)\b[^>]*>", article))
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_near_vectors(spark, small):
    rows = collected(spark.read.parquet(f"{small}/embeddings.parquet"))
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r["label"] for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    links, root = near.sum(axis=1), [r["vec_id"] for r in rows]
    for _ in rows:
        root = [min([root[k], *(root[j] for j in np.flatnonzero(near[k]))]) for k in range(len(rows))]
    want = {r["vec_id"]: (links[k], root[k], root[k] == r["vec_id"]) for k, r in enumerate(rows)}
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in collected(queries.op4_embedding_dedup(spark, small))} == want


def near_groups(rows):
    """(links, root as a position) of each row."""
    sets = [shingle_set(r["text"]) for r in rows]
    return brute_links(sets, lambda a, b: bool(a) and 10 * len(a & b) >= 8 * len(a | b))


def test_near_documents(spark, small, given):
    links, root = near_groups(given)
    least = collections.defaultdict(list)
    for r, k in zip(given, root, strict=True):
        least[k].append(r["doc_id"])
    want = sorted((r["doc_id"], n, min(least[k]), r["doc_id"] == min(least[k])) for r, n, k in zip(given, links, root, strict=True))
    assert sum(links) > 0
    assert sorted((r["doc_id"], r["n_links"], r["component_id"], r["kept"]) for r in collected(queries.op5_ngram_join(spark, small))) == want


def test_shards(spark, small, given):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in given}
    found = collected(queries.op6_resharding(spark, small))
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in found} == {k: (len(t) + 8, zlib.crc32(t)) for k, t in texts.items()} and len(found) == len(given)
    slots, shards = collections.defaultdict(list), collections.defaultdict(set)
    for r in found:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 24
        slots[r["shard"]].append(r["slot"])
        shards[texts[r["doc_id"]]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shards.values())


def test_tokens(spark, small, given, tokenizer):
    want = {}
    for r in given:
        ids = tokenizer.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in collected(queries.op7_bpe(spark, small))} == want


def test_passages(spark, small, given):
    want = sorted((given[k]["doc_id"], a, b) for k, a, b in brute_passages([r["text"] for r in given], ids=[r["doc_id"] for r in given]))
    assert want
    assert sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in collected(queries.op9_suffix_dedup(spark, small))) == want


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_secrets(spark, small, more):
    found = {r["doc_id"]: r for r in collected(queries.op10_secret_scan(spark, LARGER))}
    assert len(found) == len(more)
    for r in more:
        spans, said = base_spans(r["text"] or ""), found[r["doc_id"]]
        assert (said["n_assign"], said["n_access"], said["n_hex"]) == tuple(sum(k == kind for _, k, _ in spans) for kind in range(3))
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        assert said["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(said["spans"].split(","))
    assert sum(r["n_assign"] + r["n_access"] + r["n_hex"] for r in found.values()) > 0


# Pipeline: each stage on all that its predecessor kept


def good(text):
    """The default policy, counted anew."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {k + i for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for i in range(3)}
    n, chars = len(words), sum(map(len, words))
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return n >= 50 and 100 * len(repeated) <= 50 * n and 10 * symbols <= 3 * n and 100 * (len(lines) - len(set(lines))) <= 40 * len(lines) and 2 * n <= chars <= 15 * n


def mixed(rows):
    """How often the mix takes each row."""
    place = lambda r: int(hashlib.md5(f"{r['doc_id']}:{r['text']}".encode()).hexdigest()[:15], 16)
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    of = collections.defaultdict(list)
    for r in rows:
        of[r["source"]].append((place(r), size(r), r["doc_id"]))
    sums = {s: sum(x[1] for x in own) for s, own in of.items()}
    out = collections.Counter()
    for s, target in water_fill(sums).items():
        rounds, at = min(2, int(target // sums[s])), 0
        for _, n, doc_id in sorted(of[s]):
            at += n
            out[doc_id] += min(2, rounds + (at - n / 2 <= target - rounds * sums[s]))
    return +out


def test_pipeline_against_brute_force(spark, small, more, tokenizer):
    rows = spark.read.parquet(f"{LARGER}/documents.parquet")
    outs = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stored(stage(spark, rows, LARGER))
        outs.append(sorted(collected(rows), key=lambda r: r["doc_id"]))
    by_id = sorted(more, key=lambda r: r["doc_id"])
    want = [r for r in by_id if good(r["text"])]
    assert outs[0] == want and 0 < len(want) < len(more)

    root = near_groups(want)[1]
    want = [r for k, r in enumerate(want) if root[k] == k]  # rows are in order of their ids
    assert outs[1] == want and len(want) < len(root)

    redacted = []
    for r in want:
        spans = sorted({*base_spans(r["text"]), *(s for s in secret_scan.scan(r["text"]) if s[1] == 3)})
        hidden, text, at = set(), "", 0
        for a, _, b in spans:
            hidden |= set(range(a, b))
        for k, c in enumerate(r["text"]):
            if k in hidden:
                text += "[SECRET]" * (k - 1 not in hidden or any(a == k for a, _, _ in spans) and not any(a < k < b for a, _, b in spans))
            else:
                text += c
        redacted.append(r | {"text": text, "n_chars": r["n_chars"] if text == r["text"] else len(text)})
    assert outs[2] == redacted and sum(a != b for a, b in zip(redacted, want, strict=True)) > 0

    copies = mixed(redacted)
    assert collections.Counter(r["doc_id"] for r in outs[3]) == copies and max(copies.values()) == 2
    source = {r["doc_id"]: r for r in redacted}
    assert all(r == source[r["doc_id"]] for r in outs[3])

    found = collections.Counter((r["doc_id"], tuple(r["ids"]), r["ids_sha256"], r["decoded_sha256"]) for r in collected(corpus_pipeline.run(spark, LARGER)))
    tokens = collections.Counter()
    for r in outs[3]:
        ids = tokenizer.encode_ordinary(r["text"])
        tokens[r["doc_id"], tuple(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()] += 1
    assert found == tokens
