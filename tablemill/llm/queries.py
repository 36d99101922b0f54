"""Registered queries opN_<name> over the given tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm import bpe, embedding_dedup, filter_audit, html_extraction, license_scan, mixing, ngram_join, periodic_runs, quality_rules, resharding, secret_scan, sentencepiece_bpe, suffix_dedup
from tablemill.llm.common import documents, new_path, stored
from tablemill.llm.license_rules import RULES


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, s = license_scan.with_licenses(documents(spark, sf_dir).select("doc_id", "text"))
    columns = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "n_matches", "score")
    return out.select("doc_id", *[F.col(s)[c].alias(c) for c in columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, m = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", *[F.col(m)[c].alias(c) for c in ("size", "source_size", "target", "taken")])


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out, text = html_extraction.with_main_text(pages.select("page_id", "url", "html"), html_extraction.train(pages))
    return out.select("page_id", "url", F.col(text).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: links, the group's least id, and whether the document is the one that stays."""
    out = ngram_join.join(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "n_links", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


SHARDS = 24


def op6_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From an uneven old layout (shard k holds 2k + 1 of 576 hash ranges of the text) to shards of equal bytes."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    old = F.floor(F.sqrt(F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(SHARDS * SHARDS))))
    out, s = resharding.reshard(docs, old, SHARDS)
    law = F.lit("bytes").alias("law")
    columns = [F.col(s)[c].alias(c) for c in ("size", "text_crc32")], [F.col(s)[c].alias(c) for c in ("shard", "slot", "old_shard")]
    return out.select("doc_id", *columns[0], law, *columns[1], F.lit(None).cast("int").alias("grown_shard"))


def shards_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in eight stored shards, resharded to six: the affected shards are rewritten, and all are read back."""
    path = new_path(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(8)).cast("int").alias("shard"))
    docs.write.partitionBy("shard").parquet(path)
    out, s = resharding.reshard(spark.read.parquet(path), F.col("shard"), 6)
    want = stored(out.select("doc_id", F.col(s)["text_crc32"].alias("crc"), F.col(s)["shard"].alias("planned"))).groupBy("doc_id", "crc", "planned").count()
    resharding.rewrite_affected(out.drop("shard"), s, path)
    back = spark.read.parquet(path)
    found = back.groupBy("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"), F.col("shard").alias("planned")).agg(F.count("*").alias("n_found"))
    both = want.join(found, [want[c].eqNullSafe(found[c]) for c in ("doc_id", "crc", "planned")], "full")
    return both.groupBy(F.coalesce(found["planned"], want["planned"]).alias("shard")).agg(F.sum("n_found").alias("n_rows"), F.bool_and(F.coalesce(F.col("count") == F.col("n_found"), F.lit(False))).alias("as_planned")).agg(
        F.count("*").alias("n_shards"), F.sum("n_rows").alias("n_rows"), F.bool_and("as_planned").alias("as_planned"),
    )


#: The vocabulary: a path and the pattern that goes with it, never copied here.
RANK_FILE, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), RANK_FILE, PATTERN, with_ids=False).drop("ids")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, ledger = quality_rules.with_ledger(documents(spark, sf_dir).select("doc_id", "text"))
    said = F.col(ledger)
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_unique_words", "fail_bits")
    base = quality_rules.passes(said["fail_bits"], quality_rules.BASE_POLICY)
    return out.select(
        "doc_id", *[said[c].alias(c) for c in columns], (~base).alias("base_failed"),
        (base & quality_rules.passes(said["fail_bits"])).alias("kept"),
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger stored, and read again under each policy: what each rule rejects, alone and with others."""
    out, ledger = quality_rules.with_ledger(documents(spark, sf_dir).select("doc_id", "text"))
    bits = stored(out.select(F.col(ledger)["fail_bits"].alias("fail_bits")))
    per = [quality_rules.ablations(bits, p).select(F.lit(p).alias("policy"), "*") for p in quality_rules.POLICIES]
    return reduce(DataFrame.unionByName, per)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per passage and document; documents that share no passage have none."""
    return suffix_dedup.repeated_passages(documents(spark, sf_dir).select("doc_id", "text"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, s = secret_scan.with_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", *[F.col(s)[c].alias(c) for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")])


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in which, by the hash of its id, about every tenth text ends in a repeated block of its own
    words. A row without an id stays as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, hit = F.floor(h / 10), h % 10 == 0
    cut = docs.withColumn("ws", F.when(hit, F.regexp_extract_all("text", F.lit(f"({WORD})"))))
    n = F.size("ws")
    placed = cut.select("doc_id", "text", "ws", n.alias("n"), F.when(n > 0, g % n).cast("int").alias("a"), (3 + g % 8).alias("parts"))
    placed = placed.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / F.col("parts"))).cast("int"))
    block, rest = F.slice("ws", F.col("a") + 1, F.col("p")), F.col("n") - F.col("a")
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    planted = F.array_join(F.concat(F.slice("ws", F.lit(1), F.col("a")), tail), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, s = periodic_runs.with_runs(with_planted_runs(documents(spark, sf_dir).select("doc_id", "text")))
    runs = F.col(s)["runs"]
    # The greatest exact length / period; runs come by start and period, so the first of equals stays.
    best = F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    said = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(said, lambda line: F.concat(line, F.lit("\n"))), "")
    out = out.select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col(s)["collapsed"], 256).alias("collapsed_sha256"))
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: A path, as with the ranks.
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode(documents(spark, sf_dir), PIECE_MODEL, with_ids=False).drop("ids")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


WORD = r"[^\x20\x09-\x0D]+"
QUERIES = {f.__name__: f for f in (op1_license_scan, op2_mixing, op3_html_extraction, op4_embedding_dedup, op5_ngram_join, op6_resharding, op7_bpe, op8_quality_rules, op9_suffix_dedup, op10_secret_scan, op11_periodic_runs, op12_sentencepiece, op13_filter_audit, shards_rewritten, quality_ablations)}

_RULE_ROWS = ", ".join(f"({k}, '{label}', '{keyword}', '{pattern}', {priority}, {base})" for k, label, keyword, pattern, priority, base in RULES)
#: Rows b: the ledger.
LEDGER_SQL = rf"""d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS ws FROM d),
        l AS (SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
              WHERE regexp_matches(line, '{WORD}') GROUP BY ALL),
        ls AS (SELECT doc_id, sum(c) AS n_lines, sum(c - 1) AS n_dup_lines FROM l GROUP BY doc_id),
        g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
              FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
        r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        rs AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
        m AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
                     length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
                     coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                     len(list_distinct(ws)) AS n_unique_words
              FROM w LEFT JOIN ls USING (doc_id) LEFT JOIN rs USING (doc_id)),
        b AS (SELECT *, {" + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in quality_rules.RULES)} AS bits FROM m)"""
_BITS = {r.name: 1 << r.bit for r in quality_rules.RULES}
_ABLATED = ", ".join(f"('{p}', '{name}', {_BITS[name]}, {quality_rules.mask(p)})" for p, names in quality_rules.POLICIES.items() for name in names)
ORACLE_SQL = {
    "shards_rewritten": "SELECT 6::BIGINT AS n_shards, count(*) AS n_rows, true AS as_planned FROM documents",
    "op1_license_scan": rf"""
        WITH rules(rule_id, label, keyword, pattern, priority, is_base) AS (VALUES {_RULE_ROWS}),
        n AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS w FROM documents),
        d AS (SELECT doc_id, CASE WHEN w = '' THEN '' ELSE ' ' || replace(w, ' ', '  ') || ' ' END AS w FROM n),
        c AS (SELECT doc_id, rule_id, label, priority, is_base, string_split_regex(w, pattern) AS p, regexp_extract_all(w, pattern) AS h
              FROM d JOIN rules ON contains(w, keyword) AND regexp_matches(w, pattern)),
        u AS (SELECT doc_id, rule_id, label, priority, is_base, i, (length(p[i]) - length(replace(p[i], ' ', ''))) // 2 AS wp,
                     (length(h[i]) - length(replace(h[i], ' ', ''))) // 2 AS wh
              FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM c)),
        m AS (SELECT *, sum(wp) OVER o + sum(wh) OVER o - wh AS s, sum(wp) OVER o + sum(wh) OVER o AS e
              FROM u WINDOW o AS (PARTITION BY doc_id, rule_id ORDER BY i)),
        k AS (SELECT *, coalesce(max(CASE WHEN priority = 1 THEN e END) OVER b, -1) AS far1,
                     coalesce(max(CASE WHEN priority = 2 THEN e END) OVER b, -1) AS far2, coalesce(max(CASE WHEN priority = 3 THEN e END) OVER b, -1) AS far3
              FROM m WINDOW b AS (PARTITION BY doc_id ORDER BY s, e DESC, priority, rule_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        g AS (SELECT *, NOT (far1 >= e OR (priority >= 2 AND far2 >= e) OR (priority >= 3 AND far3 >= e)) AS stays FROM k),
        a AS (SELECT doc_id, count(*) FILTER (is_base) AS n_base, min(s) FILTER (is_base) AS first_word, max(s) FILTER (is_base) AS last_word,
                     array_to_string(list_sort(list(DISTINCT label) FILTER (is_base)), ',') AS base_labels,
                     array_to_string(list_sort(list(DISTINCT label) FILTER (is_base OR stays)), ',') AS labels,
                     count(*) FILTER (stays) AS n_matches, [1.0, 0.8, 0.5][min(priority) FILTER (stays)]::DOUBLE AS score
              FROM g GROUP BY doc_id)
        SELECT doc_id, CAST((length(w) - length(replace(w, ' ', ''))) // 2 AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base,
               CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
               coalesce(labels, '') AS labels, coalesce(n_matches, 0) AS n_matches, coalesce(score, 0.0) AS score
        FROM d LEFT JOIN a USING (doc_id)""",
    "op2_mixing": rf"""
        WITH d AS (
          SELECT doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '{WORD}', 'x', 'g'), '[^x]', '', 'g')) AS size,
                 ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
          FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM s),
        o AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS budget,
                     sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS weight_left, coalesce(sum(cap) OVER p, 0) AS cap_before
              FROM w WINDOW p AS (ORDER BY cap / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        c AS (SELECT *, (budget - cap_before) * weight >= cap * weight_left AS capped FROM o),
        t AS (SELECT source, source_size,
                     CASE WHEN capped THEN cap::DOUBLE
                          ELSE weight * (budget - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::DOUBLE
                               / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () END AS target FROM c),
        r AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END AS rounds FROM t),
        u AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.rounds, target - rounds * source_size AS rest,
                     sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS UNBOUNDED PRECEDING) - size / 2.0 AS mid
              FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
               CAST(least(rounds + CASE WHEN mid <= rest THEN 1 ELSE 0 END, 2) * size AS BIGINT) AS taken FROM u""",
    "op8_quality_rules": rf"""
        WITH {LEDGER_SQL}
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
               CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
               CAST(n_unique_words AS BIGINT) AS n_unique_words, CAST(bits AS BIGINT) AS fail_bits,
               (bits & {quality_rules.mask(quality_rules.BASE_POLICY)}) <> 0 AS base_failed,
               (bits & {quality_rules.mask(quality_rules.DEFAULT_POLICY)}) = 0 AS kept FROM b""",
    "quality_ablations": f"""
        WITH {LEDGER_SQL}, cells(policy, rule, m, p) AS (VALUES {_ABLATED})
        SELECT policy, rule, count(*) FILTER (bits & m <> 0) AS n_failed, count(*) FILTER (bits & p = m) AS n_failed_alone,
               count(*) FILTER (bits & p = 0) AS n_kept FROM b, cells GROUP BY ALL""",
    "op13_filter_audit": rf"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
                   FROM documents LEFT JOIN labels USING (doc_id)),
        w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS ws, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals FROM d),
        k AS (SELECT part, good, toxic, CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
                     + CASE WHEN 100 * capitals > 3 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
                     + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM w),
        c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM k GROUP BY ALL),
        f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        o AS (SELECT f1.letter || f2.letter || f3.letter || f4.letter || f5.letter AS filter_order, [f1.bit, f2.bit, f3.bit, f4.bit, f5.bit] AS bits
              FROM f f1, f f2, f f3, f f4, f f5 WHERE f1.bit + f2.bit + f3.bit + f4.bit + f5.bit = 31
              AND len(list_distinct([f1.bit, f2.bit, f3.bit, f4.bit, f5.bit])) = 5),
        s AS (SELECT filter_order, i AS step, bits[i] AS bit, list_sum(bits[1:i]) - bits[i] AS applied FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS i FROM o)),
        m AS (SELECT part, filter_order, step, bit,
                     sum(CASE WHEN mask & (applied + bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & (applied + bit) = bit THEN n ELSE 0 END) AS removed,
                     sum(CASE WHEN mask & bit <> 0 AND mask & applied <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                     sum(CASE WHEN mask & (applied + bit) = bit THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & (applied + bit) = bit THEN toxic ELSE 0 END) AS toxic_lost
              FROM c, s GROUP BY part, filter_order, step, bit)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, {", ".join(f"CAST({x} AS BIGINT) AS {x}" for x in filter_audit.METRICS)},
               CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM m""",
}
