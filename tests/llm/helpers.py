"""Small tables with the awkward rows that every corpus operator must take."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

#: With columns whose names the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, Ledger string, secrets string, mix string, licenses string, id long, key string, signature string, shard int"


def docs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """rows: (doc_id, text[, source])."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or ""), *(None,) * 9) for r in rows], SCHEMA)


def prose(seed: int, words: int) -> str:
    """Words that no other seed has."""
    rnd = random.Random(seed)
    made = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 9))) + str(seed) for _ in range(80)]
    return " ".join(rnd.choice(made) for _ in range(words))


def awkward(spark: SparkSession) -> DataFrame:
    long = " ".join(prose(k, 400) for k in range(40))
    return docs(spark, [
        (1, None), (2, ""), (3, " \t\n "), (4, "word"), (5, prose(5, 60)), (5, prose(5, 60)), (6, prose(5, 60)), (None, prose(7, 60)), (None, None),
        (8, long, None), (9, "émoji 🙂 ünïcode ñ " * 20, "b"), (10, "!!! ... ---"), (11, prose(5, 60) + " tail"),
    ])
