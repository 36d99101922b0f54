"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps the measurements and one long whose bit i is set when
rule i fails. Policies are versioned bitmasks over the ledger, so a new policy or an ablation never reads text again.

Edge cases: a null text measures as an empty one; a text without words fails ``few_words`` only; repeated rows are
judged one by one; an empty table gives an empty ledger; columns of the input never clash with the ledger, which is one
struct under a name that the input doesn't have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import fresh, schema

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_unique_words")


@dataclass(frozen=True)
class Rule:
    """fails: SQL over the measurements, in whole numbers so that every engine agrees."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_trigrams", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "duplicate_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 15 * n_words"),
    Rule(6, "many_words", "n_words > 100000"),
    Rule(7, "few_unique_words", "100 * n_unique_words < 5 * n_words"),
)
BASE_POLICY, DEFAULT_POLICY = "v1-base", "v2"
#: Policy version -> names of the rules that reject a document.
POLICIES = {
    BASE_POLICY: ("few_words", "repeated_trigrams"),
    DEFAULT_POLICY: ("few_words", "repeated_trigrams", "symbols", "duplicate_lines", "short_words", "long_words"),
    "v3-strict": tuple(r.name for r in RULES),
}


def mask(policy: str) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[name] for name in POLICIES[policy])


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of one text. bytes.split() cuts at exactly the six white-space characters meant here."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    ids: dict[bytes, int] = {}
    at = [ids.setdefault(w, len(ids)) for w in words]
    repeats = 0
    if n >= 4 and len(ids) < n:
        a = np.array(at, dtype=np.int64)
        pairs = np.unique(a[:-1] * len(ids) + a[1:], return_inverse=True)[1]
        grams = pairs[:-1] * len(ids) + a[2:]
        _, where, count = np.unique(grams, return_inverse=True, return_counts=True)
        twice = count[where] > 1
        covered = np.zeros(n, dtype=bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        repeats = int(covered.sum())
    return n, chars, symbols, len(lines), len(lines) - len(set(lines)), repeats, len(ids)


@F.pandas_udf(schema(", ".join(f"{m} long" for m in MEASURES)))
def _measures(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        rows = np.array([measure(t) for t in batch], dtype=np.int64).reshape(-1, len(MEASURES))
        yield pd.DataFrame(rows, columns=list(MEASURES))


def with_ledger(docs: DataFrame, name: str = "ledger") -> tuple[DataFrame, str]:
    """docs with one more struct column (its name is returned): the measurements and fail_bits. One pass, no shuffle."""
    raw = fresh(docs, "raw_measures")
    out = docs.withColumn(raw, _measures("text"))
    fields = [F.col(raw)[m].alias(m) for m in MEASURES]
    bits: Column = F.lit(0).cast("long")
    for rule in RULES:
        said = F.expr(_qualified(rule.fails, raw))
        bits = bits.bitwiseOR(F.when(said, F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    name = fresh(out, name)
    return out.withColumn(name, F.struct(*fields, bits.alias("fail_bits"))).drop(raw), name


def _qualified(sql: str, struct: str) -> str:
    return " ".join(f"`{struct}`.{w}" if w in MEASURES else w for w in sql.split())


def passes(fail_bits: Column, policy: str = DEFAULT_POLICY) -> Column:
    return fail_bits.bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablations(fail_bits: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """One row per rule of the policy: documents that fail it, that fail only it (kept if it were dropped), and kept.

    fail_bits: a frame with a long column fail_bits. The shuffle carries at most 2^rules counts of distinct masks.
    """
    own = fail_bits.select(F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")).alias("b"))
    counts = own.groupBy("b").count()
    rules = [r for r in RULES if r.name in POLICIES[policy]]
    cells = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("m")) for r in rules])
    long = counts.select("b", "count", F.inline(cells))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("count"))), F.lit(0)).alias
    return long.groupBy("rule").agg(
        total(F.col("b").bitwiseAND(F.col("m")) != 0)("n_failed"),
        total(F.col("b") == F.col("m"))("n_failed_alone"),
        total(F.col("b") == 0)("n_kept"),
    )


def keep_good(docs: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """The rows of docs that the policy keeps, with the columns of docs."""
    judged, ledger = with_ledger(docs)
    return judged.where(passes(F.col(ledger)["fail_bits"], policy)).select(*[F.col(f"`{c}`") for c in docs.columns])
