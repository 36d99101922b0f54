"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, reranking with original vectors.

A rotation learned on a bounded sample turns vectors into balanced binary codes, which are cut into substrings, one for
each table. A vector stands in each table under its substring and under those that differ from it in one of the PROBES
bits that it is least certain of. Vectors of one label and dimension that stand under the same substring share a bucket;
there the cosine of the original vectors in double precision decides alone. Every vector is indexed. A pair is linked
only if its cosine reaches the threshold; a pair above it is missed only if it meets in no table.

Labels may say much about their vectors, and a label's vectors be a cluster. So vectors are coded by what is left when
the mean of their group is taken off; the first groups are those of equal label and length. Groups of up to ten BUCKETs
are compared as they are, and need no codes. Larger ones share rotations with those of the same length and about the same
spread around their means. Buckets that come out larger than ten BUCKETs, as those of a cluster within a label do, are
groups themselves, and coded once more by rotations of their own, up to DEPTH times.

A substring has about log2(group / BUCKET) bits, so buckets stay the same size however many vectors there are. How many
tables that takes depends on the vectors: the nearer a group's vectors are to their mean, the less their codes agree at
the threshold. So tables are added until made-up pairs right at the threshold, around the sampled vectors nearest to
their mean, meet as often as RECALL. If MAX_TABLES do not reach that, substrings get shorter, and if the shortest don't,
the group is compared as a whole, which misses nothing and takes quadratic time: its vectors are about as near to each
other as pairs that are linked.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components, and null labels, link with
nothing; equal vectors of one label form a class and are compared once; vectors of different lengths never meet; an
empty table gives an empty result; a table without usable vectors has no links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.llm.banding import bucket_lists, least_common, padded, rows_of
from tablemill.llm.common import broadcast_if_small, stored
from tablemill.llm.ngram_join import with_links
from tablemill.llm.tiles import link_tiles, tiles

COSINE = 0.98
#: Vectors that share a substring, about, if they are spread evenly; bits of a substring, at least and at most.
BUCKET, LEAST_BITS, MOST_BITS = 64, 4, 48
#: Bits that a vector is least certain of, each flipped once in each table.
PROBES = 2
#: The share of pairs at the threshold that must meet, the most tables for it, and the pairs tried.
RECALL, MAX_TABLES, TRIALS = 0.995, 64, 8_000
#: Rotations are fitted on at most so many vectors of all kinds together, those that hash lowest, or so many numbers.
SAMPLE, SAMPLE_NUMBERS, ROUNDS = 20_000, 3_000_000, 30
#: How often buckets that are too large are coded, and classes of spread (a halved squared distance to the mean each).
DEPTH, SPREADS = 3, 24
BLOCK_VECTORS = 1024
#: Means of at most so many groups are broadcast.
MEANS = 10_000
STRIP = 64


def principal(x: np.ndarray, mean: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(mean, principal directions as columns) of rows x, as unit vectors. mean: of each row's group, if there are groups."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = x.mean(axis=0) if mean is None else mean
    return mean, np.linalg.svd((x - mean).T @ (x - mean))[0]


def fit_rotation(x: np.ndarray, mean: np.ndarray, axes: np.ndarray, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """A projection of x - mean to as many columns as it has dimensions: principal directions, then a rotation towards
    balanced binary codes, columns in an order of the seed."""
    v = (x / np.linalg.norm(x, axis=1, keepdims=True) - mean) @ axes
    random = np.random.default_rng(seed)
    turn = np.linalg.qr(random.standard_normal((v.shape[1], v.shape[1])))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = (u @ w).T
    return (axes @ turn)[:, random.permutation(v.shape[1])]


def table_keys(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """The 1 + PROBES substrings under which each row of x stands in the table of this projection, as longs."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    far = (x - mean) @ projection
    weights = np.uint64(1) << np.arange(far.shape[1], dtype=np.uint64)
    code = ((far >= 0) * weights).sum(axis=1, dtype=np.uint64)
    flips = weights[np.argsort(np.abs(far), axis=1, kind="stable")[:, :PROBES]]
    return np.column_stack([code, code[:, None] ^ flips]).view(np.int64)


def threshold_pairs(x: np.ndarray, mean: np.ndarray, cosine: float, seed: int = 7) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of exactly this cosine, around the tenth of rows x nearest to their mean, and these means.

    First they differ in directions of any kind, then in directions in which the rows of x themselves differ.
    """
    random = np.random.default_rng(seed)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = np.broadcast_to(mean, x.shape)
    near = np.argsort(((x - mean) ** 2).sum(axis=1), kind="stable")[: max(1, len(x) // 10)]
    chosen = near[np.arange(max(TRIALS, len(near))) % len(near)]
    a, m = x[chosen], mean[chosen]
    rest = x - mean
    other = rest[random.integers(0, len(x), len(a))] - rest[random.integers(0, len(x), len(a))]
    for turn in (random.standard_normal(a.shape), other):
        turn = turn - (turn * a).sum(axis=1, keepdims=True) * a
        size = np.linalg.norm(turn, axis=1, keepdims=True)
        some = size[:, 0] > 1e-6
        if some.any():
            yield a[some], cosine * a[some] + np.sqrt(1 - cosine**2) * turn[some] / size[some], m[some]


def fit_tables(x: np.ndarray, cosine: float, vectors: int, mean: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """(mean, a projection for each table): as many as RECALL takes; none if MAX_TABLES of the shortest substrings are
    too few.

    vectors: how many there are in a group at most. mean: of each row's group; that of all rows if there is one group.
    """
    most = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, vectors) / BUCKET))))
    mean, axes = principal(x, mean)
    pairs = list(threshold_pairs(x, mean, cosine))
    columns, seed = np.empty((x.shape[1], 0)), 7
    for bits in range(most, LEAST_BITS - 1, -2):
        met = [np.zeros(len(a), dtype=bool) for a, _, _ in pairs]
        tables: list[np.ndarray] = []
        while len(tables) < MAX_TABLES:
            end = bits * (len(tables) + 1)
            while columns.shape[1] < end:
                columns, seed = np.hstack([columns, fit_rotation(x, mean, axes, seed)]), seed + 1
            tables.append(columns[:, end - bits : end])
            for (a, b, m), seen in zip(pairs, met, strict=True):
                left, right = table_keys(a, m, tables[-1]), table_keys(b, m, tables[-1])
                seen |= (left[:, :, None] == right[:, None, :]).any(axis=(1, 2))
            if all(seen.mean() >= RECALL for seen in met):
                return mean, tables
            if len(tables) == 8 and max(1 - seen.mean() for seen in met) ** (MAX_TABLES / 8) > 1 - RECALL:
                break  # at that rate all tables would not do
    return mean, []


def usable(embedding: Column, label: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(label.isNotNull() & embedding.isNotNull() & ~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _units(lists: pa.Array) -> np.ndarray:
    x = rows_of(lists).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of unit vectors by group, of each batch."""
    for batch in batches:
        groups, at = np.unique(batch.column(0).to_numpy(), return_inverse=True)
        sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
        for length in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == length)
            order = own[np.argsort(at[own], kind="stable")]
            starts = np.flatnonzero(np.diff(at[order], prepend=-1))
            sums = np.add.reduceat(_units(batch.column(1).take(pa.array(order))), starts, axis=0)
            counts = np.diff([*starts, len(order)])
            yield pa.RecordBatch.from_arrays([pa.array(groups[at[order[starts]]]), pa.array(counts), pa.array(sums.tolist(), pa.list_(pa.float64()))], names=["grp", "n", "sums"])


def group_means(rows: DataFrame) -> DataFrame:
    """(grp, n, centre, kind) of groups of vectors of one length: how many, their mean as unit vectors, and length and
    class of spread as one number. Sums are added in every task before they are shuffled."""
    part = rows.select("grp", "embedding").mapInArrow(_sums, "grp long, n long, sums array<double>")
    sums = part.select("grp", "n", F.posexplode("sums").alias("pos", "v")).groupBy("grp", "pos").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    mean = sums.groupBy("grp").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", (F.col("v") / F.col("n")).alias("v")))).getField("v").alias("centre"))
    # Unit vectors lie 1 - |mean|^2 from their mean, squared and on average.
    left = 1 - F.aggregate("centre", F.lit(0.0), lambda s, v: s + v * v)
    spread = F.least(F.lit(SPREADS - 1), F.floor(-F.log2(F.greatest(left, F.lit(2.0**-SPREADS)))))
    return mean.withColumn("kind", F.size("centre") * SPREADS + F.greatest(F.lit(0), spread).cast("int"))


def _coder(tables: dict[int, list[np.ndarray]]):
    """Keys of vectors by their kind's tables; null where a kind has none."""

    @F.pandas_udf("array<long>")
    def run(columns: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for embedding, centre, kind in columns:
            out = np.full(len(kind), None, dtype=object)
            for k in np.unique(kind):
                if own := tables.get(int(k)):
                    at = np.flatnonzero(kind == k)
                    x, mean = np.stack(embedding.iloc[at]).astype(np.float64), np.stack(centre.iloc[at])
                    keys = np.hstack([table_keys(x, mean, projection) for projection in own])
                    out[at] = np.fromiter(keys, dtype=object, count=len(at))
            yield pd.Series(out)

    return run


def _fitted(members: DataFrame, means: DataFrame, cosine: float) -> dict[int, list[np.ndarray]]:
    """Tables for each kind of group. members: (grp, embedding, centre, kind). Kinds are as many as lengths and spreads."""
    kinds = {r["kind"]: r for r in means.groupBy("kind").agg(F.sum("n").alias("total"), F.max("n").alias("most")).collect()}
    share = {k: max(1, min(SAMPLE, SAMPLE_NUMBERS // (k // SPREADS)) // len(kinds)) / r["total"] for k, r in kinds.items()}
    unit = 1 << 40
    limits = F.create_map(*[c for k, s in share.items() for c in (F.lit(k), F.lit(min(unit, int(s * unit))).cast("long"))])
    hashed = F.pmod(F.xxhash64("embedding", F.lit(5)), F.lit(unit))
    sample = members.where(hashed < limits[F.col("kind")]).select("kind", "embedding", "centre", hashed.alias("h")).orderBy("h").limit(2 * SAMPLE).toPandas()
    out = {}
    for kind, rows in sample.groupby("kind"):
        x, mean = np.stack(rows["embedding"]).astype(np.float64), np.stack(rows["centre"])
        out[int(kind)] = fit_tables(x, cosine, kinds[kind]["most"], mean)[1]
    return out


def bucket_keys(rows: DataFrame, cosine: float, level: int = 0) -> DataFrame:
    """(id, h): the buckets in which each vector stands. rows: (id, grp, embedding), a group being of one length."""
    sizes = stored(rows.groupBy("grp").count())
    whole = lambda df: df.select("id", F.xxhash64("grp", F.lit("whole")).alias("h"))
    big = sizes.where(F.col("count") > 10 * BUCKET)
    if level == DEPTH or not big.limit(1).count():
        return whole(rows)
    small = rows.join(broadcast_if_small(sizes.where((F.col("count") <= 10 * BUCKET) & (F.col("count") > 1)).select("grp")), "grp")
    members = rows.join(broadcast_if_small(big.select("grp")), "grp")
    means = stored(group_means(members))
    members = members.join(broadcast_if_small(means.select("grp", "centre", "kind"), MEANS), "grp")
    tables = _fitted(members, means, cosine)
    coded = members.select("id", "grp", _coder(tables)("embedding", "centre", "kind").alias("codes"))
    number = F.xxhash64("grp", F.lit(level), F.floor(F.col("pos") / (1 + PROBES)), "code")
    coded = stored(coded.select("id", "grp", F.posexplode_outer("codes").alias("pos", "code")).select("id", "grp", F.when(F.col("pos").isNull(), 0).otherwise(number).alias("h"), F.col("pos").isNull().alias("uncoded")))
    keyed = coded.where("not uncoded").select("id", "h")
    # Of buckets with the same members one is enough.
    sums = keyed.groupBy("h").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    large = stored(sums.where(F.col("n") > 10 * BUCKET).groupBy("n", "x", "y").agg(F.min("h").alias("h"), F.collect_list("h").alias("all")))
    out = whole(small).unionByName(whole(coded.where("uncoded")))
    if not large.limit(1).count():
        return out.unionByName(keyed)
    ready = keyed.join(broadcast_if_small(large.select(F.explode("all").alias("h"))), "h", "left_anti")
    again = keyed.join(broadcast_if_small(large.select("h")), "h").select("id", F.col("h").alias("grp")).join(rows.select("id", "embedding").dropDuplicates(["id"]), "id")
    return out.unionByName(ready).unionByName(bucket_keys(stored(again.select("id", "grp", "embedding")), cosine, level + 1))


def _near(cosine: float):
    def compare(cols: dict[str, pa.Array], second: int | None) -> Iterator[tuple[int, np.ndarray]]:
        x = rows_of(cols["embedding"]).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        first = least_common(padded(cols["keys"]), cols["h"][0].as_py())
        for start in range(0, second or len(x) - 1, STRIP):
            if second:
                other, near = second, x[start : min(second, start + STRIP)] @ x[second:].T >= cosine
            else:
                other, near = start, np.triu(x[start : start + STRIP] @ x[start:].T >= cosine, 1)
            for k in np.flatnonzero(near.any(axis=1)).tolist():
                yield start + k, first(start + k, np.flatnonzero(near[k]) + other)

    return compare


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id) for each row of vectors (vec_id long, embedding array<float>, label)."""
    usable_vector = F.when(usable(F.col("embedding"), F.col("label")), F.col("embedding"))
    base = vectors.select("vec_id", "label", usable_vector.alias("embedding"))
    # Equal vectors of a label are told by 128 bits of hash, so that only these are joined on.
    key = ["k0", "k1"]
    keyed = base.where("embedding is not null").select("vec_id", "label", "embedding", *[F.xxhash64(F.lit(k), "label", "embedding").alias(n) for k, n in enumerate(key)])
    classes = keyed.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()))
    groups = classes.select("id", F.xxhash64("label", F.size("embedding")).alias("grp"), "embedding")
    keys = bucket_keys(groups, cosine).groupBy("id").agg(F.sort_array(F.collect_set("h")).alias("keys"))
    coded = stored(classes.select("id", "weight", "embedding", F.lit(1).cast("long").alias("volume")).join(keys, "id"))
    rows = coded.join(bucket_lists(coded, BLOCK_VECTORS), "id")
    rows = rows.select("id", "weight", "embedding", "keys", F.inline("buckets"))
    tiled = tiles(rows, "blocks")
    links = stored(link_tiles(tiled, ["h"], ["embedding", "keys", "h"], _near(cosine)))
    linked = with_links(keyed.select("vec_id", *key), key, classes, links, "vec_id").select("vec_id", "n_links", "component_id")
    alone = base.where("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone)
