"""Mixing sources to target weights with hash-threshold histograms.

Each source has a budget of words. A document's place is a 64-bit hash of its id and text, so a source's documents are
taken in hash order up to the budget, without a sort: sums by (source, top hash bits) find the bucket in which the
budget ends, only that bucket is summed again by its next bits, and the last few documents by their whole hash. A
budget above the source's size takes every document once and a second time up to the rest.

Edge cases: a null text has size 0 and is taken with its hash (0 words); null is a source of its own, last in order;
rows with equal id and text share a hash and are
interchangeable, at the boundary as many of them are taken as bring the source nearest to its target; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.llm.common import broadcast_if_small, fresh, stored
from tablemill.operators.windows import global_row_number, global_running_sums

WEIGHTS = (3, 1, 2)
#: All sources together get so much of all sizes; one source at most CAP times its own size.
SHARE_NUM, SHARE_DEN, CAP = 3, 2, 2
#: Bits of each histogram level. 2^12 sums for each source are shuffled, whatever the corpus holds.
LEVEL_BITS = 12
LEVELS = 2


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place(doc_id: Column, text: Column) -> Column:
    """60 bits of MD5 as a long: any engine can recompute it, and it doesn't depend on row order or partitions."""
    said = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> with target double.

    The reshared excess comes to rest where a source is either at its cap or gets the same amount per weight as the
    others; sorted by cap per weight, the capped sources are a prefix. Ranks and running sums are taken in ranges of
    the order, as sources may be as many as hosts; only sums over all of them reach the driver.
    """
    key = F.col("source").asc_nulls_last()
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int")).cast("long")
    out = global_row_number(sizes, [key], "rank").withColumn("weight", weight).withColumn("cap", F.col("source_size") * CAP)
    by_cap = [(F.col("cap") / F.col("weight")).asc(), key]
    out = stored(global_running_sums(out, by_cap, caps="cap", weights="weight"))
    whole = out.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    budget = F.lit(whole["size"] * (SHARE_NUM / SHARE_DEN))
    before, left = F.col("caps") - F.col("cap"), F.lit(whole["weight"]) - (F.col("weights") - F.col("weight"))
    out = out.withColumn("capped", (budget - before) * F.col("weight") >= F.col("cap") * left)
    cell = lambda c, yes: F.coalesce(F.sum(F.when(yes, F.col(c))), F.lit(0))
    sums = out.agg(cell("cap", F.col("capped")).alias("capped"), cell("weight", ~F.col("capped")).alias("free")).first()
    level = F.col("weight") * (budget - F.lit(sums["capped"])) / F.lit(sums["free"] or 1)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level)
    return out.select("source", "source_size", target.cast("double").alias("target"))


def _boundary(sums: DataFrame, keys: list[str], left: Column) -> DataFrame:
    """For each source the first bucket at which the running sum exceeds what is left, and what is left before it."""
    run = F.sum("s").over(Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    at = sums.withColumn("upto", run).where(F.col("upto") > left)
    return at.groupBy(*keys).agg(F.min(F.struct("b", (F.col("upto") - F.col("s")).alias("used"))).alias("hit"))


def mix(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with one struct column more (its name is returned): size, source_size, target, copies, taken.

    Three passes over a slim table of (source, hash, size); the texts themselves are read twice and never shuffled.
    """
    src = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("~null"))  # "s..." < "~null"
    slim = stored(docs.select(src.alias("source"), place(F.col("doc_id"), F.col("text")).alias("h"), words(F.col("text")).alias("size")))
    plan = stored(targets(stored(slim.groupBy("source").agg(F.sum("size").alias("source_size")))))
    # The part of the target beyond whole rounds over the source: that is what thresholds decide.
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.withColumn("rounds", F.least(rounds, F.lit(CAP)).cast("long"))
    plan = plan.withColumn("left", F.col("target") - F.col("rounds") * F.col("source_size")).withColumn("low", F.lit(0).cast("long")).withColumn("high", F.lit(1 << 60).cast("long"))
    for level in range(1, LEVELS + 1):
        shift = 60 - LEVEL_BITS * level
        inside = slim.join(broadcast_if_small(plan.select("source", "low", "high", "left")), "source").where((F.col("h") >= F.col("low")) & (F.col("h") < F.col("high")))
        sums = inside.groupBy("source", "left", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("s"))
        hits = _boundary(sums, ["source", "left"], F.col("left")).select("source", "hit")
        plan = plan.join(hits, "source", "left")
        start = F.shiftleft(F.col("hit.b"), shift)
        plan = stored(
            plan.select(
                "source", "source_size", "target", "rounds",
                (F.col("left") - F.coalesce(F.col("hit.used"), F.lit(0))).alias("left"),
                # No bucket exceeds the budget (it is 0 words or all of them): nothing to refine beyond "high".
                F.coalesce(start, F.col("high")).alias("low"),
                F.coalesce(start + F.lit(1 << shift).cast("long"), F.col("high")).alias("high"),
            )
        )
    inside = slim.join(broadcast_if_small(plan.select("source", "low", "high", "left")), "source").where((F.col("h") >= F.col("low")) & (F.col("h") < F.col("high")))
    last = inside.groupBy("source", "left", F.col("h").alias("b")).agg(F.sum("size").alias("s"), F.count("*").alias("c"))
    run = F.sum("s").over(Window.partitionBy("source", "left").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    ends = last.withColumn("upto", run).where(F.col("upto") > F.col("left")).groupBy("source").agg(F.min(F.struct("b", (F.col("upto") - F.col("s")).alias("before"), "s", "c")).alias("at"))
    plan = plan.join(ends, "source", "left")
    # Rows at the boundary have one hash: as many of them are taken as bring the sum nearest to the budget.
    some = F.floor((F.col("left") - F.col("at.before")) * F.col("at.c") / F.col("at.s") + 0.5)
    some = F.greatest(F.lit(0), F.least(some, F.col("at.c"))).cast("long")
    plan = stored(
        plan.select(
            "source", "source_size", "target", "rounds",
            F.coalesce(F.when(some == F.col("at.c"), F.col("at.b") + 1).otherwise(F.col("at.b")), F.col("high")).alias("threshold"),
            F.when((some > 0) & (some < F.col("at.c")), some).alias("extra"),
        )
    )

    names = {k: fresh(docs, k) for k in ("mix_key", "mix", "mix_number", "mix_part", "mix_row")}
    side = plan.select(F.col("source").alias(names["mix_key"]), F.struct("source_size", "target", "rounds", "threshold", "extra").alias(names["mix"]))
    out = docs.withColumn(names["mix_key"], src).join(broadcast_if_small(side), names["mix_key"], "left")
    m, size, h = F.col(names["mix"]), words(F.col("text")), place(F.col("doc_id"), F.col("text"))
    taken = h < m["threshold"]
    if plan.where("extra is not null").limit(1).count():
        at = F.coalesce((h == m["threshold"]) & m["extra"].isNotNull(), F.lit(False))
        own = out.columns
        tied = _numbered(out.where(at), names["mix_key"], names["mix_number"], names["mix_part"], names["mix_row"])
        out = out.where(~at).withColumn(names["mix_number"], F.lit(None).cast("long")).select(*[F.col(f"`{c}`") for c in own], names["mix_number"]).unionByName(tied)
        taken = taken | F.coalesce(F.col(names["mix_number"]) <= m["extra"], F.lit(False))
    copies = F.least(m["rounds"] + taken.cast("long"), F.lit(CAP).cast("long"))
    out = out.withColumn(names["mix"], F.struct(size.alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), copies.alias("copies"), (copies * size).alias("taken")))
    return out.drop(names["mix_key"], names["mix_number"]), names["mix"]


def _numbered(rows: DataFrame, key: str, number: str, part: str, row: str) -> DataFrame:
    """Interchangeable rows numbered from 1 for each key, a third of the table or more: within the tasks that stored
    them, after the counts of the tasks before (one row for each task and key)."""
    rows = stored(rows.withColumn(part, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id()))
    sizes = rows.groupBy(key, part).agg(F.count("*").alias("in_part"))
    before = F.sum("in_part").over(Window.partitionBy(key).orderBy(part)) - F.col("in_part")
    offsets = stored(sizes.select(F.col(key).alias("of_key"), F.col(part).alias("of_part"), before.alias("earlier")))
    within = F.row_number().over(Window.partitionBy(key, part).orderBy(row))
    joined = rows.withColumn(number, within.cast("long")).join(broadcast_if_small(offsets), (F.col(key) == F.col("of_key")) & (F.col(part) == F.col("of_part")))
    return joined.withColumn(number, F.col(number) + F.col("earlier")).drop("of_key", "of_part", "earlier", part, row)


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows that the mix takes, a document that it takes twice as two rows, with the columns of docs."""
    out, m = mix(docs)
    own = [F.col(f"`{c}`") for c in docs.columns]
    times = F.explode(F.array_repeat(F.lit(1), F.col(m)["copies"].cast("int")))
    return out.select(*own, times.alias(fresh(docs, "again"))).select(*own)
