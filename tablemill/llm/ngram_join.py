"""N-gram Jaccard join by MinHash banding, verified on the full n-gram sets.

Words are runs of letters and digits in lower case; an n-gram is SHINGLE words in a row, and a text of fewer words is
one n-gram. Texts of equal words form a class and are compared once. Band and row counts are chosen for a target recall
at the similarity; band keys are shuffled, and within a bucket pairs are verified on whole sets, in tiles of bounded
size, which report numbers of links and a spanning forest, never all pairs.

Edge cases: a null text is empty; a text without words is linked with nothing; repeated rows and equal texts with
different ids are linked with each other; null ids count as rows (the least id of a group ignores them); an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.llm.banding import bucket_lists, least_common, rows_of
from tablemill.llm.common import fresh, schema, stored
from tablemill.llm.components import components
from tablemill.llm.tiles import link_tiles, tiles

SHINGLE = 5
SIMILARITY = Fraction(4, 5)
RECALL = 0.9995
MAX_HASHES = 128
#: N-grams in a block of a tile.
BLOCK_SHINGLES = 250_000


def choose_bands(similarity: float, recall: float, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows (the fewest false candidates) whose bands reach the recall within max_hashes."""
    best = None
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)) if similarity < 1 else 1
        if bands * rows <= max_hashes:
            best = bands, rows
    if not best:
        raise ValueError("no banding reaches this recall within max_hashes")
    return best


BANDS, ROWS = choose_bands(float(SIMILARITY), RECALL)
_RANDOM = np.random.default_rng(20_011)
_XOR = _RANDOM.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_ODD = _RANDOM.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode())
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(words: str, hashes: dict) -> np.ndarray:
    """The sorted hashes of the distinct n-grams of words, which are joined by single spaces."""
    if not words:
        return np.empty(0, np.uint64)
    w = np.array([hashes[x] for x in words.split(" ")], dtype=np.uint64)
    size = min(SHINGLE, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = h * _P + w[k : len(w) - size + 1 + k]
    return np.unique(_mix(h))


def band_keys(sets: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(sets), 4096):
        least = np.minimum(least, ((sets[k : k + 4096, None] ^ _XOR) * _ODD).min(axis=0))
    least = least.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = _mix(key * _P + least[:, r])
    return key.view(np.int64)


@F.pandas_udf(schema("n_shingles long, keys longs"))
def _signature(words: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    hashes = _WordHashes()
    for batch in words:
        sizes, bands = [], []
        for x in batch:
            s = shingles(x, hashes)
            sizes.append(len(s))
            bands.append(band_keys(s) if len(s) else None)
        yield pd.DataFrame({"n_shingles": sizes, "keys": bands})


@F.pandas_udf(schema("packed binary"))
def _sets(words: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    hashes = _WordHashes()
    for batch in words:
        yield pd.DataFrame({"packed": [shingles(x, hashes).tobytes() for x in batch]})


def plain_words(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", " ")))


def _similar(num: int, den: int):
    """Compares a tile: pairs of a Jaccard similarity of num/den at least, in whole numbers."""

    def compare(cols: dict[str, pa.Array], second: int | None) -> Iterator[tuple[int, np.ndarray]]:
        sets = [np.frombuffer(x, np.uint64) for x in cols["packed"].to_pylist()]
        first = least_common(rows_of(cols["keys"]), cols["h"][0].as_py())
        sizes = np.array([len(s) for s in sets])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        values, at = np.unique(np.concatenate(sets), return_inverse=True)
        mark = np.zeros(len(values), dtype=np.int32)
        for i in range(second or len(sets) - 1):
            own, k = at[starts[i] : starts[i] + sizes[i]], second or i + 1
            mark[own] = 1
            common = np.add.reduceat(mark[at[starts[k] :]], starts[k:] - starts[k])
            mark[own] = 0
            js = np.flatnonzero(common * (num + den) >= num * (sizes[i] + sizes[k:])) + k
            if len(js):
                yield i, first(i, js)

    return compare


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_shingles, n_links, component_id) for each row of docs.

    n_links: other rows whose n-gram sets have the similarity. component_id: the least doc_id reachable by links.
    key: MD5 of the words, the same for rows of one class.
    """
    words, sig = "plain_words", "signature"
    base = docs.select("doc_id", plain_words(F.col("text")).alias(words))
    slim = stored(base.select("doc_id", F.unhex(F.md5(words)).alias("key"), _signature(words).alias(sig)).select("doc_id", "key", f"{sig}.*"))
    classes = slim.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"), F.first("n_shingles").alias("volume"), F.first("keys").alias("keys"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()))
    need = stored(classes.join(bucket_lists(classes, BLOCK_SHINGLES), "id").select("id", "key", "rep", "weight", "keys", "buckets"))
    # One row of each class is enough: that of its least id. Joining on the id too spreads large groups of copies.
    texts = base.select(F.col("doc_id").alias("rep_id"), F.unhex(F.md5(words)).alias("text_key"), words)
    found = texts.join(need, (F.col("text_key") == F.col("key")) & F.col("rep_id").eqNullSafe(F.col("rep")))
    rows = found.select("id", "weight", "keys", "buckets", _sets(words)["packed"].alias("packed"))
    tiled = tiles(rows.select("id", "weight", "keys", "packed", F.inline("buckets")), "blocks")
    links = stored(link_tiles(tiled, ["h"], ["packed", "keys"], _similar(SIMILARITY.numerator, SIMILARITY.denominator)))
    slim = slim.drop("keys")
    alone = slim.where("n_shingles = 0").withColumn("n_links", F.lit(0).cast("long")).withColumn("component_id", F.col("doc_id"))
    return with_links(slim.where("n_shingles > 0"), ["key"], classes, links, "doc_id").unionByName(alone)


def with_links(rows: DataFrame, key: list[str], classes: DataFrame, links: DataFrame, row_id: str) -> DataFrame:
    """rows with n_links and component_id, from the links between classes. classes: id, key, rep, weight.

    Every row has a class. Classes without links take no part in the joins on root: they have none, and would all meet
    in one task.
    """
    sums = links.groupBy("id").agg(F.sum("weight").alias("linked"))
    roots = components(links.select(F.col("id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "id")
    own = stored(classes.select("id", *key, "rep", "weight").join(sums, "id", "left").join(roots, "id", "left"))
    linked = own.where("root is not null")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    said = lambda links, component: [*key, (F.col("weight") - 1 + links).cast("long").alias("n_links"), component.alias("component_id")]
    own = linked.join(least, "root").select(*said(F.col("linked"), F.col("least"))).unionByName(own.where("root is null").select(*said(F.lit(0), F.col("rep"))))
    out = rows.join(stored(own), key)
    # A group all of whose ids are null has no least one.
    return out.withColumn("component_id", F.coalesce("component_id", row_id))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each group of linked documents the row with the least id, with the columns of docs.

    Of rows that agree in id and words that of the least hash over all columns stays. Rows without an id stay only where
    no row of their group has one.
    """
    judged = stored(join(docs).select("doc_id", "key", "component_id"))
    stay = judged.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "key").count()
    stay = stored(stay.select(F.col("doc_id").alias("stay_id"), F.col("key").alias("stay_key"), (F.col("count") > 1).alias("again")))
    key = fresh(docs, "stay_words")
    own = [F.col(f"d.`{c}`") for c in docs.columns]
    keyed = docs.withColumn(key, F.unhex(F.md5(plain_words(F.col("text"))))).alias("d")
    out = keyed.join(stay.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.stay_id")) & (F.col(f"d.`{key}`") == F.col("s.stay_key")))
    if not stay.where("again").limit(1).count():
        return out.select(*own)
    named = {c: fresh(docs, f"stay_{n}") for n, c in enumerate(("id", "words", "row"))}
    once = out.where("not s.again").select(*own)
    row = F.md5(F.to_json(F.struct(*own), {"ignoreNullFields": "false"}))
    again = out.where("s.again").select(*own, F.col("s.stay_id").alias(named["id"]), F.col("s.stay_key").alias(named["words"]), row.alias(named["row"]))
    # Minima are pre-aggregated; rows that agree in everything are interchangeable.
    least = again.groupBy(named["id"], named["words"]).agg(F.min(named["row"]).alias("least")).alias("l")
    same = [F.col(f"a.`{named[c]}`").eqNullSafe(F.col(f"l.`{named[c]}`")) for c in ("id", "words")]
    again = again.alias("a").join(least, [*same, F.col(f"a.`{named['row']}`") == F.col("l.least")]).select("a.*")
    return once.unionByName(again.dropDuplicates([named["id"], named["words"]]).select(*[F.col(f"`{c}`") for c in docs.columns]))
