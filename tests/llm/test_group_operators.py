"""Operators that shuffle: mixing, sharding, tokens, joins by similarity, repeated passages, the pipeline."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import regex
import tiktoken
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tablemill.llm import bpe, components, embedding_dedup, mixing, ngram_join, queries, resharding, suffix_dedup
from tablemill.scratch import stored
from tests.llm.helpers import SCHEMA, awkward, docs, prose


def collected(df):
    return [r.asDict() for r in df.collect()]


# Components


def test_components_brute_force(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 540)]
    root = {k: k for e in edges for k in e}
    for _ in range(600):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: v for k, v in root.items() if any(a != b and k in (a, b) for a, b in edges)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Mixing


def water_fill(sizes: dict) -> dict:
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
            free.discard(s)


def test_mix_targets_and_taken(spark):
    rnd = random.Random(3)
    sources = ["b", "a", "é", "z", None, "a b"]
    rows = [(k, prose(k, rnd.randint(0, 60)), rnd.choices(sources, [60, 3, 5, 2, 4, 1])[0]) for k in range(600)]
    out, m = mixing.mix(docs(spark, rows))
    found = [r.asDict(True) for r in out.select("doc_id", "source", F.col(m).alias("m")).collect()]
    sizes = collections.Counter()
    for r in found:
        sizes[r["source"]] += r["m"]["size"]
    want = water_fill(dict(sizes))
    taken, largest = collections.Counter(), max(r["m"]["size"] for r in found)
    for r in found:
        assert r["m"]["size"] == len(rows[r["doc_id"]][1].split()) and r["m"]["source_size"] == sizes[r["source"]]
        assert r["m"]["target"] == pytest.approx(want[r["source"]]) and r["m"]["taken"] <= 2 * r["m"]["size"]
        taken[r["source"]] += r["m"]["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest / 2 + 1e-6
    again, m2 = mixing.mix(docs(spark, rows).repartition(7))
    key = lambda df, name: sorted(map(tuple, df.select("doc_id", F.col(name)["taken"]).collect()))
    assert key(again, m2) == key(out, m)
    copies = collections.Counter(r["doc_id"] for r in mixing.mixed_rows(docs(spark, rows)).collect())
    assert copies == {r["doc_id"]: r["m"]["copies"] for r in found if r["m"]["copies"]}


def test_targets_of_many_sources(spark):
    """As many sources as there may be hosts: ranks and sums over ranges give what one pass over all of them gives."""
    rnd = random.Random(8)
    sizes = {f"host{k}": rnd.choice([0, 1, 5, 1000, 10**9]) for k in range(3000)}
    found = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = water_fill(sizes)
    assert len(found) == len(sizes) and all(r["target"] == pytest.approx(want[r["source"]]) for r in found)


def test_mix_awkward(spark):
    rows = awkward(spark)
    out, m = mixing.mix(rows)
    assert out.count() == rows.count() and out.columns == [*rows.columns, m]
    assert mixing.mix(rows.limit(0))[0].count() == 0
    assert mixing.mixed_rows(rows).columns == rows.columns


# Resharding


def brute_least_moves(supply, capacity):
    return sum(max(0, s - c) for s, c in itertools.zip_longest(supply, capacity, fillvalue=0))


def test_min_cost_flow_moves_the_fewest():
    rnd = random.Random(5)
    for _ in range(40):
        n, m = rnd.randint(1, 6), rnd.randint(1, 6)
        supply = [rnd.randint(0, 50) for _ in range(n)]
        capacity = [rnd.randint(0, 50) for _ in range(m)]
        capacity[0] += max(0, sum(supply) - sum(capacity))
        flow = resharding.min_cost_flow(supply, capacity)
        assert [sum(w for (a, _), w in flow.items() if a == i) for i in range(n)] == supply
        assert all(sum(w for (_, b), w in flow.items() if b == j) <= capacity[j] for j in range(m)) and min(flow.values(), default=1) > 0
        assert sum(w for (i, j), w in flow.items() if i != j) == brute_least_moves(supply, capacity)
        assert len(flow) <= 2 * (n + m)


def test_min_cost_flow_of_many_shards():
    flow = resharding.min_cost_flow([k % 7 for k in range(50_000)], [3] * 50_000)
    assert sum(flow.values()) == sum(k % 7 for k in range(50_000)) and len(flow) <= 200_000


def test_reshard(spark, tmp_path):
    rows = docs(spark, [(k, prose(k % 150, 10 + k % 40)) for k in range(900)] + [(None, None), (None, ""), (7, "dup"), (7, "dup")])
    out, name = resharding.reshard(rows, F.floor(F.sqrt(F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(36)))), 6)
    found = collected(out.select("doc_id", "text", f"{name}.*"))
    shards = collections.defaultdict(list)
    for r in found:
        raw = (r["text"] or "").encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw)
        shards[r["shard"]].append(r)
    assert len(found) == rows.count() and set(shards) <= set(range(6))
    for own in shards.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    sizes = [sum(r["size"] for r in own) for own in shards.values()]
    assert len(sizes) == 6 and max(sizes) - min(sizes) < 0.03 * sum(sizes) / 6
    old = collections.Counter()
    for r in found:
        old[r["old_shard"]] += r["size"]
    moved = sum(r["size"] for r in found if r["old_shard"] != r["shard"])
    assert moved < brute_least_moves([old[k] for k in range(6)], [sum(sizes) / 6] * 6) + 0.03 * sum(sizes)
    assert all(len({r["shard"] for r in g}) == 1 for _, g in itertools.groupby(sorted(found, key=lambda r: r["text"] or ""), key=lambda r: r["text"] or ""))
    written = resharding.rewrite_affected(out, name, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == sum(len(shards.get(k, ())) for k in written)


def test_reshard_awkward_and_hot(spark):
    rows = awkward(spark)
    out, name = resharding.reshard(rows, F.lit(0), 3)
    assert out.count() == rows.count() and out.columns == [*rows.columns, name]
    assert resharding.reshard(rows.limit(0), F.lit(0), 3)[0].count() == 0
    hot = docs(spark, [(k, "the same text of all") for k in range(600)])
    out, name = resharding.reshard(hot, F.lit(1), [1, 1, 2])
    counts = {r["shard"]: r["count"] for r in out.groupBy(F.col(name)["shard"].alias("shard")).count().collect()}
    assert len(counts) == 3 and abs(counts[2] - 300) < 60  # one text fills several shards: its rows are split


def test_reshard_parts_only_texts_that_no_shard_can_hold(spark):
    """A text of a third of the rows fills more than a shard; the pairs around it stay together, and so does one of half a shard."""
    texts = ["the hot text " * 3] * 3000 + [f"half a shard {'x' * 100}"] * 350 + [f"pair {k // 2} of small texts" for k in range(6000)]
    rows = docs(spark, list(enumerate(texts)))
    for old in (F.lit(0), F.pmod(F.xxhash64("text"), F.lit(4))):
        out, name = resharding.reshard(rows, old, 6)
        found = collected(out.select("text", f"{name}.*"))
        where = collections.defaultdict(set)
        sizes = collections.Counter()
        for r in found:
            where[r["text"]].add(r["shard"])
            sizes[r["shard"]] += r["size"]
        assert len(found) == len(texts) and {t for t, s in where.items() if len(s) > 1} == {texts[0]}
        assert max(sizes.values()) - min(sizes.values()) < 0.1 * sum(sizes.values()) / 6
        slots = collections.defaultdict(list)
        for r in found:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_reshard_numbers_hot_blocks_in_parts(spark, monkeypatch):
    """A short text of very many rows stays in its shard, and is numbered in parts."""
    monkeypatch.setattr(resharding, "BLOCK_ROWS", 100)
    texts = [""] * 900 + [prose(k, 60) for k in range(300)]
    out, name = resharding.reshard(docs(spark, list(enumerate(texts))), F.lit(0), 4)
    found = collected(out.select("text", f"{name}.*"))
    assert len({r["shard"] for r in found if not r["text"]}) == 1
    for _, own in itertools.groupby(sorted(found, key=lambda r: r["shard"]), key=lambda r: r["shard"]):
        own = [r["slot"] for r in own]
        assert sorted(own) == list(range(len(own)))


@pytest.mark.parametrize(("before", "after"), [(4, 3), (3, 5), (4, 4)])
def test_rewrite_reads_back_every_row_once(spark, tmp_path, before, after):
    path = f"{tmp_path}/shards"
    rows = docs(spark, [(k, prose(k % 700, 8)) for k in range(900)]).select("doc_id", "text")
    rows.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(before)).cast("int")).write.partitionBy("shard").parquet(path)
    out, name = resharding.reshard(spark.read.parquet(path), F.col("shard"), after)
    want = sorted(tuple(r) for r in out.select("doc_id", "text", f"{name}.shard", f"{name}.slot").collect())
    written = resharding.rewrite_affected(out.drop("shard"), name, path)
    back = spark.read.parquet(path)
    assert sorted((r["doc_id"], r["text"], r["shard"]) for r in back.collect()) == [w[:3] for w in want]
    assert {w[2] for w in want} == set(range(after)) and set(written) <= set(range(max(before, after)))
    slots = {w[:1]: w[3] for w in want}
    assert all(r["slot"] is None or r["slot"] == slots[r["doc_id"],] for r in spark.read.option("mergeSchema", True).parquet(path).collect())


# Byte-level BPE


@pytest.fixture(scope="module")
def tokenizer():
    return tiktoken.Encoding("test", pat_str=queries.PATTERN, mergeable_ranks=bpe.read_ranks(queries.RANK_FILE), special_tokens={})


def test_bpe_against_tiktoken(spark, tokenizer, monkeypatch):
    texts = [None, "", " ", "  two  spaces \n\n\n x", "don't we'll 's", "émoji 🙂🙂 ünïcode", "<|endoftext|> <|x|>", "\t\x00\x1f tabs", "a" * 5000, "日本語 テキスト", "1234567 89", prose(1, 500), "x y　z ", prose(1, 500)]
    rows = docs(spark, [(k if k % 5 else None, t) for k, t in enumerate(texts)])
    want = collections.Counter()
    for k, t in enumerate(texts):
        ids = tokenizer.encode_ordinary(t or "")
        want[k if k % 5 else None, tuple(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    found = bpe.encode(rows, queries.RANK_FILE, queries.PATTERN)
    assert collections.Counter((r["doc_id"], tuple(r["ids"]), r["ids_sha256"], r["decoded_sha256"]) for r in found.collect()) == want
    decoded = collections.Counter(bytes(r["decoded"]).decode() for r in bpe.decode(found, queries.RANK_FILE).collect())
    assert decoded == collections.Counter(t or "" for t in texts)
    assert bpe.encode(rows.limit(0), queries.RANK_FILE, queries.PATTERN).count() == 0


def test_bpe_words_and_positions_of_different_runs_raise(spark, monkeypatch):
    """Rows that came in another order for the words than for the positions: no result rather than a wrong one."""
    rows = docs(spark, [(k, prose(k, 40)) for k in range(20)])
    plain = bpe.encode_words
    monkeypatch.setattr(bpe, "encode_words", lambda pieces, ranks, pattern: plain(bpe.cut_and_number(rows.orderBy(F.desc("doc_id")).coalesce(1), pattern, 48).repartition("dest"), ranks, pattern))
    with pytest.raises(Exception, match="different runs"):
        bpe.encode(rows.coalesce(1), queries.RANK_FILE, queries.PATTERN).collect()


def test_bpe_words_cross_chunks_and_parts(spark, tokenizer, monkeypatch):
    """Many chunks, more parts than words, chunks without words; the cut runs once for both uses of its shuffle."""
    texts = ["", None, *[prose(k % 7, 30) for k in range(60)], "", "x"]
    found = bpe.encode(docs(spark, list(enumerate(texts))).repartition(9), queries.RANK_FILE, queries.PATTERN)
    assert {r["doc_id"]: r["ids"] for r in found.collect()} == {k: tokenizer.encode_ordinary(t or "") for k, t in enumerate(texts)}
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


@given(st.text(alphabet=st.characters(max_codepoint=127)))
def test_ascii_cut_is_the_same(text):
    assert bpe.cutter(queries.PATTERN)(text) == regex.findall(queries.PATTERN, text)
    assert bpe.cutter(r"[^\S\p{N}]+|\S")(text) == regex.findall(r"[^\S\p{N}]+|\S", text)


@given(st.lists(st.integers(0, 2**32 - 1)), st.binary())
def test_packed_numbers_come_back(numbers, rest):
    found, left = bpe._unpack(bpe._pack(np.array(numbers, dtype=np.uint32), rest))
    assert found.tolist() == numbers and left == rest


def test_chunks_cut_by_size(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "CHUNK_CHARS", 10)
    batch = pa.RecordBatch.from_pylist([{"d": k, "t": "x" * k} for k in range(8)])
    chunks = list(bpe._chunks(iter([batch, batch])))
    assert [i for ids, _ in chunks for i in ids] == [*range(8)] * 2
    assert all(len(t) == 1 or sum(map(len, t)) <= 10 for _, t in chunks) and len(chunks) > 5


# N-gram join


def shingle_set(text):
    words = [w for w in re.sub(r"[\W_]+", " ", (text or "").lower()).split(" ") if w]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_links(sets, similar):
    n = len(sets)
    links, root = [0] * n, list(range(n))
    for a in range(n):
        for b in range(a):
            if similar(sets[a], sets[b]):
                links[a] += 1
                links[b] += 1
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    return links, root


def near_copies(seed, n, words=120):
    rnd = random.Random(seed)
    base = prose(seed, words).split()
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rnd.randint(0, 5)):
            own[rnd.randrange(len(own))] = f"new{rnd.randrange(9)}"
        out.append(" ".join(own))
    return out


def test_join_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 1500)  # groups fall into several blocks
    texts = [prose(k, 50) for k in range(40)] + near_copies(1001, 60) + near_copies(1002, 25) + [prose(3, 50)] * 4 + ["A b!", "a  B", "a b c", "", None, "?!"]
    rows = docs(spark, list(enumerate(texts)))
    sets = [shingle_set(t) for t in texts]
    links, root = brute_links(sets, lambda a, b: bool(a) and 10 * len(a & b) >= 8 * len(a | b))
    found = sorted(collected(ngram_join.join(rows)), key=lambda r: r["doc_id"])
    assert [r["n_links"] for r in found] == links and [r["component_id"] for r in found] == root
    kept = ngram_join.keep_one(rows)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({k for k in root}) and kept.columns == rows.columns


def test_bands_reach_the_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= ngram_join.MAX_HASHES
    with pytest.raises(ValueError):
        ngram_join.choose_bands(0.1, 0.9999, 8)


def test_join_awkward(spark):
    rows = awkward(spark)
    found = collected(ngram_join.join(rows))
    assert len(found) == rows.count()
    five = [r for r in found if r["doc_id"] in (5, 6)]
    assert all(r["n_links"] == 3 and r["component_id"] == 5 for r in five)  # two equal rows, one equal text, one near copy
    kept = collections.Counter(r["doc_id"] for r in ngram_join.keep_one(rows).collect())
    assert kept[5] == 1 and kept[6] == kept[11] == 0 and kept[1] == kept[4] == 1 and kept[None] == 2
    same = [(1, "One two three.", "b"), (1, "one, two THREE", "a"), (1, "one two three", "c"), (2, "one two three", "d")]
    stays = {tuple((r["doc_id"], r["text"], r["source"]) for r in ngram_join.keep_one(docs(spark, order).coalesce(1)).collect()) for order in (same, same[::-1], same[2:] + same[:2])}
    assert len(stays) == 1 and len(next(iter(stays))) == 1  # whatever order the rows come in
    assert ngram_join.join(rows.limit(0)).count() == 0 and ngram_join.keep_one(rows.limit(0)).count() == 0


# Embeddings


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id long, weight long, code long")


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK_VECTORS", 16)
    rnd = np.random.default_rng(2)
    rows = []
    for c in range(30):
        base = rnd.standard_normal(24)
        for _ in range(1 if c % 3 else 30):
            rows.append((base + rnd.standard_normal(24) * 0.1).tolist())
    rows += [rows[0]] * 5
    table = [(k, [float(np.float32(x)) for x in v], k % 2, None, None, None) for k, v in enumerate(rows)]
    x = np.array([t[1] for t in table])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.98) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2)
    np.fill_diagonal(near, False)
    found = sorted(collected(embedding_dedup.near_duplicates(vectors(spark, table))), key=lambda r: r["vec_id"])
    links = np.array([r["n_links"] for r in found])
    assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.9 * near.sum() > 0
    assert all(near[r["vec_id"]].any() or r["component_id"] == r["vec_id"] for r in found)


@pytest.mark.parametrize("common", [0.0, 0.9, 0.999])
def test_embeddings_with_a_common_direction(spark, common):
    """Pairs right above the threshold are found however much all vectors have in common."""
    rnd = np.random.default_rng(3)
    x = rnd.standard_normal((500, 64))
    x = np.sqrt(1 - common**2) * x / np.linalg.norm(x, axis=1, keepdims=True)
    x[:, 0] += common
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = rnd.standard_normal(x.shape)
    turn -= (turn * x).sum(axis=1, keepdims=True) * x
    y = 0.9801 * x + np.sqrt(1 - 0.9801**2) * turn / np.linalg.norm(turn, axis=1, keepdims=True)
    x = np.vstack([x, y]).astype(np.float32).astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = (unit @ unit.T >= 0.98).sum() - len(x)
    found = collected(embedding_dedup.near_duplicates(vectors(spark, [(k, v, 0, None, None, None) for k, v in enumerate(x.tolist())])))
    assert 0.98 * pairs <= sum(r["n_links"] for r in found) <= pairs and pairs >= 1000


def test_embeddings_given_with_planted_pairs(spark, small, monkeypatch):
    """The given vectors and a partner of each right above the threshold, against brute force."""
    monkeypatch.setattr(embedding_dedup, "BUCKET", 2)
    given = spark.read.parquet(f"{small}/embeddings.parquet").where("embedding is not null and label is not null").toPandas()
    x = np.array(given["embedding"].tolist(), dtype=np.float64)
    rnd = np.random.default_rng(5)
    turn = rnd.standard_normal(x.shape)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    turn -= (turn * x).sum(axis=1, keepdims=True) * x / size**2
    y = 0.9802 * x + np.sqrt(1 - 0.9802**2) * size * turn / np.linalg.norm(turn, axis=1, keepdims=True)
    x, label = np.float32(np.vstack([x, y])).astype(np.float64), np.tile(given["label"], 2)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    rows = spark.createDataFrame([(k, v, int(c), None, None, None) for k, (v, c) in enumerate(zip(x.tolist(), label, strict=True))], "vec_id long, embedding array<float>, label int, id long, weight long, code long")
    found = {r["vec_id"]: r["n_links"] for r in collected(embedding_dedup.near_duplicates(rows))}
    assert all(found[k] <= n for k, n in enumerate(near.sum(axis=1))) and sum(found.values()) >= 0.98 * near.sum() >= len(given)


def test_embeddings_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 0), (6, [], 0), (7, [0.0, 0.0], 0), (8, [nan, 1.0], 0),
        (9, [inf, 1.0], 0), (10, [None, 1.0], 0), (11, [2.0, 0.0], 0), (None, [1.0, 0.0], 1), (12, [1.0, 0.0, 0.0], 0), (1, [1.0, 0.0], 0),
    ]
    found = collected(embedding_dedup.near_duplicates(vectors(spark, [(*r, None, None, None) for r in rows])))
    by = collections.defaultdict(list)
    for r in found:
        by[r["vec_id"]].append((r["n_links"], r["component_id"]))
    assert len(found) == len(rows)
    assert by[1] == [(3, 1)] * 2 and by[2] == by[11] == [(3, 1)]  # equal rows count one by one
    assert by[3] == [(1, 3)] and by[None] == [(1, 3)]
    assert all(by[k] == [(0, k)] for k in (4, 5, 6, 7, 8, 9, 10, 12))
    assert embedding_dedup.near_duplicates(vectors(spark, [])).count() == 0


def test_rotation_balances_codes():
    x = np.random.default_rng(1).standard_normal((2000, 24)) * np.linspace(1, 4, 24)
    mean, axes = embedding_dedup.principal(x)
    keys = embedding_dedup.table_keys(x, mean, embedding_dedup.fit_rotation(x, mean, axes, 7))
    assert keys.shape == (2000, 1 + embedding_dedup.PROBES)
    share = [np.mean(keys[:, 0].view(np.uint64) >> np.uint64(k) & np.uint64(1)) for k in range(24)]
    assert 0.4 < min(share) and max(share) < 0.6
    flipped = keys[:, :1] ^ keys[:, 1:]
    assert (np.bitwise_count(flipped) == 1).all() and (flipped[:, 0] != flipped[:, 1]).all()


@pytest.mark.parametrize("vectors", [1_000, 1_000_000, 1_000_000_000])
def test_tables_reach_the_recall_at_any_number_of_vectors(vectors):
    """Substrings grow with the number of vectors, and tables with them; pairs that were not used for the fit meet as often."""
    rnd = np.random.default_rng(4)
    x = rnd.standard_normal((4000, 64))
    mean, tables = embedding_dedup.fit_tables(x, 0.98, vectors)
    assert tables[0].shape == (64, max(4, int(np.ceil(np.log2(vectors / embedding_dedup.BUCKET)))))
    a = rnd.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    turn = rnd.standard_normal(a.shape)
    turn -= (turn * a).sum(axis=1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * turn / np.linalg.norm(turn, axis=1, keepdims=True)
    met = np.zeros(len(a), dtype=bool)
    for t in tables:
        left, right = (embedding_dedup.table_keys(y, mean, t) for y in (a, b))
        met |= (left[:, :, None] == right[:, None, :]).any(axis=(1, 2))
    assert met.mean() > 0.98


# Repeated passages


def brute_passages(rows, size=suffix_dedup.MIN_WORDS, ids=None):
    """Rows that agree in id and text are one document."""
    words = {k: [w.lower() for w in re.findall(r"[^\W_]+", t or "")] for k, t in enumerate(rows)}
    where = collections.defaultdict(set)
    for k, w in words.items():
        for i in range(len(w) - size + 1):
            where[tuple(w[i : i + size])].add((ids[k] if ids else k, rows[k]))
    out = []
    for k, w in words.items():
        spans = []
        for i in range(len(w) - size + 1):
            if len(where[tuple(w[i : i + size])]) > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + size
                else:
                    spans.append([i, i + size])
        out += [(k, *s) for s in spans]
    return sorted(out)


def test_passages_brute_force(spark):
    rnd = random.Random(9)
    shared = [prose(700 + k, n).split() for k, n in enumerate((50, 51, 60, 75, 120, 400))]
    texts = []
    for k in range(60):
        words = prose(k, rnd.randint(20, 150)).split()
        for _ in range(rnd.randint(0, 2)):
            part = rnd.choice(shared)
            cut = rnd.randint(0, 10) if rnd.random() < 0.3 else 0
            at = rnd.randint(0, len(words))
            words[at:at] = part[cut:]
        texts.append(", ".join(words))
    texts += [texts[0] + " more", prose(99, 49), prose(98, 49), "word " * 300, "word " * 200]
    found = collected(suffix_dedup.repeated_passages(docs(spark, list(enumerate(texts)))))
    assert sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in found) == brute_passages(texts)
    for r in found:
        own = re.findall(r"[^\W_]+", texts[r["doc_id"]][r["start_char"] : r["end_char"]])
        assert len(own) == r["n_words"] == r["end_word"] - r["start_word"]


def test_passages_awkward(spark):
    rows = awkward(spark)
    found = collections.Counter(r["doc_id"] for r in suffix_dedup.repeated_passages(rows).collect())
    assert set(found) == {None, 5, 6, 8, 11}
    assert suffix_dedup.repeated_passages(rows.limit(0)).count() == 0


def test_sorted_runs_over_batches_of_any_size():
    """However the sorted suffixes are cut into batches, the inner runs give the same seeds, in time that grows with them."""
    import pyarrow as pa

    rnd = np.random.default_rng(6)
    k0 = np.sort(np.concatenate([np.repeat(rnd.integers(0, 50, 40), 5), np.full(3000, 25)]))
    columns = [k0, k0 * 7, rnd.integers(0, 9, len(k0)), np.arange(len(k0), dtype=np.int32)]
    order = np.lexsort(columns[::-1])
    table = pa.table({n: c[order] for n, c in zip(("k0", "k1", "rk", "pos"), columns, strict=True)})
    inner = set(range(len(k0))) - set(np.flatnonzero(np.isin(k0, k0[[0, -1]])).tolist())

    def seeds(size):
        found = pa.Table.from_batches(suffix_dedup._neighbours(iter(table.to_batches(max_chunksize=size)))).to_pylist()
        return sorted((r["pos"], r["sign"]) for r in found if r["pos"] in inner)

    assert seeds(10_000) == seeds(1) == seeds(3) == seeds(64) and len(seeds(64)) >= 3000


def test_passages_of_rows_that_are_repeated_very_often(spark):
    shared = prose(900, 60)
    rows = docs(spark, [(7, f"{shared} {prose(1, 30)}")] * 400 + [(8, f"{prose(2, 30)} {shared}")])
    found = collected(suffix_dedup.repeated_passages(rows.repartition(5)))
    assert sorted((r["doc_id"], r["n_words"]) for r in found) == [(7, 60), (8, 60)]


def test_window_starts_reach_both_ends():
    starts = suffix_dedup.window_starts(np.array([100, 110]), np.array([1, 1]), 1000)
    assert {100 - suffix_dedup.WINDOW + 1, 100, 110} <= set(starts.tolist())
    assert max(starts) == 110 + suffix_dedup.PREFIX - suffix_dedup.MIN_WORDS + suffix_dedup.WINDOW - 1


# Pipeline


def test_pipeline_stages_and_whole(spark, small, tokenizer):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_join", "secret_scan", "mixing", "bpe"]
    rows = spark.read.parquet(f"{small}/documents.parquet")
    columns = rows.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stored(stage(spark, rows, small))
        assert rows.columns == columns
    mixed = collections.Counter()
    for r in rows.collect():
        mixed[r["doc_id"], hashlib.sha256(" ".join(map(str, tokenizer.encode_ordinary(r["text"]))).encode()).hexdigest()] += 1
    found = collections.Counter((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, small).collect())
    assert found == mixed


def test_pipeline_awkward(spark):
    rows = awkward(spark).unionByName(docs(spark, [(20 + k, prose(k + 50, 80), "c") for k in range(20)]))
    for _, stage in corpus_pipeline.STAGES:
        for part in (rows, rows.limit(0)):
            out = stage(spark, part, "")
            out = stored(out)
        rows = stored(stage(spark, rows, ""))
    assert rows.count() > 0 and SCHEMA


def test_bounded_sample_is_the_least_hashes(spark):
    from tablemill.llm.common import bounded_sample

    rows = spark.range(20_000)
    mark = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 40))
    want = [r["id"] for r in rows.orderBy(mark("id")).limit(50).collect()]
    assert [r["id"] for r in bounded_sample(rows, F.xxhash64("id"), 50).collect()] == want
    assert bounded_sample(rows.limit(7), F.xxhash64("id"), 50).count() == 7
