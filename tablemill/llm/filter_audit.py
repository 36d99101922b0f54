"""How document filters interact: what each removes at each place of every order in which they can be applied.

Every filter is judged once for each document; its failures are the bits of a mask. What filters do to a part of the
corpus depends on how many documents have each mask, so documents are counted into cells (part, mask), at most 2^filters
for a part. A recursive query then extends prefixes of orders with unused letters: a level joins the cells of the part,
carries the bits applied so far, and emits that step's metrics. Orders that begin alike share a prefix, so k filters take
k! * e rows for a part, whatever the corpus holds.

A repeated text is told by 128 bits of hash and its length: the least id of each text is pre-aggregated in every task,
and documents are joined to it on text and id together, so that neither a text with many copies nor one filter is one
task's load.

Edge cases: a null text is empty, a null part is the empty text; a null id is smaller than none and has none smaller,
so its row never repeats another, and rows that agree in id don't repeat each other; several labels of a document are
one, which is set if any is; labels without a document count nowhere; an empty table has no parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Filters that see a text alone, as conditions of failure over its measurements.
OWN_FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 3 * n_chars",
    "D": "has_symbol",
}
#: The filter that fails a text which a document of a smaller id has.
REPEATED = "E"
LETTERS = (*OWN_FILTERS, REPEATED)
BITS = {letter: 1 << k for k, letter in enumerate(LETTERS)}
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def _bit(letter: str, fails: Column) -> Column:
    return F.when(fails, F.lit(BITS[letter])).otherwise(F.lit(0))


def masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, mask) for each row of docs (doc_id long, text, and the column that parts them): bit k is set if
    filter k of LETTERS fails."""
    said = F.coalesce("text", F.lit(""))
    found = F.regexp_extract_all("t", F.lit(f"({WORD})"))
    texts = docs.select("doc_id", F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), said.alias("t"))
    measured = texts.select(
        "doc_id", "part", F.unhex(F.md5(F.col("t").cast("binary"))).alias("digest"), F.length("t").alias("n_chars"), F.size(found).alias("n_words"),
        F.size(F.array_distinct(found)).alias("n_distinct"), F.regexp_count("t", F.lit("[A-Z]")).alias("n_capitals"), F.col("t").rlike(r"[#$%&*|]").alias("has_symbol"),
    )
    own = reduce(Column.bitwiseOR, [_bit(letter, F.expr(fails)) for letter, fails in OWN_FILTERS.items()])
    slim = stored(measured.select("doc_id", "part", "digest", "n_chars", own.alias("own")))
    first = slim.where("doc_id is not null").groupBy("digest", "n_chars").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    judged = slim.join(first, ["digest", "n_chars", "doc_id"], "left")
    repeated = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return judged.select("doc_id", "part", F.col("own").bitwiseOR(_bit(REPEATED, repeated)).alias("mask"))


def cells(masked: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(part, mask, n, n_good, n_toxic): documents of each mask, and those labelled good and toxic."""
    said = {"n_good": "quality", "n_toxic": "toxic"}
    if labels is None:
        masked = masked.withColumns({c: F.lit(0) for c in said.values()})
    else:
        # Documents of one mask that have a label are counted by id first: a repeated null id is one row here.
        masked = masked.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
        once = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c) for c in said.values()])
        masked = masked.join(once, "doc_id", "left")
    n = F.lit(1) if labels is None else F.col("n")
    sums = [F.coalesce(F.sum(F.when(F.col(c) == 1, n)), F.lit(0)).cast("long").alias(name) for name, c in said.items()]
    return masked.groupBy("part", "mask").agg(F.sum(n).cast("long").alias("n"), *sums)


def _total(counted: str, where: str) -> str:
    """SQL: a sum over the cells of a part, with c as a cell."""
    return f"aggregate(filter(p.cells, c -> {where}), 0L, (s, c) -> s + c.{counted})"


def walk(counted: DataFrame, letters: tuple[str, ...] = LETTERS) -> DataFrame:
    """(part, prefix, step, letter, METRICS): one row for each prefix of an order, with what its last filter does there.

    counted: rows of cells(). They are gathered into one row for a part, of at most 2^filters structs, and the recursion
    joins that row at each level.
    """
    spark = counted.sparkSession
    gathered = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("cells"))
    gathered = stored(gathered)
    bits = ", ".join(f"('{letter}', {1 << k})" for k, letter in enumerate(letters))
    here = "c.mask & (w.applied | l.bit) = l.bit"  # fails this filter and passed all before it
    metrics = {
        "kept": _total("n", "c.mask & (w.applied | l.bit) = 0"), "removed": _total("n", here), "redundant": _total("n", "c.mask & l.bit <> 0 AND c.mask & w.applied <> 0"),
        "unique_fails": _total("n", "c.mask = l.bit"), "good_lost": _total("n_good", here), "toxic_lost": _total("n_toxic", here),
    }
    query = f"""
        WITH RECURSIVE walk AS (
          SELECT part, '' AS prefix, 0 AS step, '' AS letter, 0 AS applied, {', '.join(f'0L AS {m}' for m in METRICS)} FROM {{parts}}
          UNION ALL
          SELECT w.part, concat(w.prefix, l.letter), w.step + 1, l.letter, w.applied | l.bit, {', '.join(metrics[m] for m in METRICS)}
          FROM walk w JOIN (VALUES {bits}) AS l(letter, bit) ON w.applied & l.bit = 0 JOIN {{parts}} p ON p.part = w.part)
        SELECT part, prefix, step, letter, {', '.join(METRICS)} FROM walk WHERE step > 0"""
    # The rows are k! * e for each part; Spark's own limit is a guard against recursion that never ends, as this does.
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        return stored(spark.sql(query, parts=gathered))
    finally:
        spark.conf.set(limit, before)


def audit(docs: DataFrame, labels: DataFrame | None = None, part: str = "lang") -> DataFrame:
    """(part, filter_order, step, METRICS, shapley): one row for each part, order of the filters, and step.

    Metrics count documents of the part: kept after the step, removed by it, redundant (failing its filter, but removed
    before), unique_fails (failing no other filter), good_lost and toxic_lost (removed here, with that label). shapley
    is what the step's filter removes, summed over all orders.
    """
    steps = walk(cells(masks(docs, part), labels))
    orders = steps.where(F.col("step") == len(LETTERS)).select("part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("at"))
    along = orders.withColumn("prefix", F.expr("left(filter_order, at)")).join(steps, ["part", "prefix"])
    shapley = along.groupBy(F.col("part").alias("s_part"), F.col("letter").alias("s_letter")).agg(F.sum("removed").cast("long").alias("shapley"))
    out = along.join(shapley, (F.col("part") == F.col("s_part")) & (F.col("letter") == F.col("s_letter")))
    return out.select("part", "filter_order", "step", *METRICS, "shapley")
