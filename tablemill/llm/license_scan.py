"""Licence scans with ordered signature rules, in DataFrame expressions only.

A text becomes lower-case words, each with a space on either side. Keywords are looked for first; the expressions of a
keyword's rules run only on texts that hold it. Matches carry word intervals. One pass over a text's matches, sorted
by start and descending end, drops each match that lies within a match of equal or better priority.

Edge cases: null text is empty; a text without words has n_words 0, no matches, and score 0; ties of interval and
priority go to the rule that stands first; repeated rows are scanned one by one. No shuffle, no join on an id: null and
repeated ids do no harm.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import fresh
from tablemill.llm.license_rules import KEYWORDS, OTHER_KEYWORDS, RULES, STEM

NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Of the best match that stays, by priority.
SCORES = (1.0, 0.8, 0.5)
#: Matches whose running sums are appended to one array.
BLOCK = 256
_MATCH = "array<struct<s:bigint,back:bigint,priority:int,rule_id:int,label:string,is_base:boolean,e:bigint>>"


def _one_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), NOT_WORD, " "))


def _spaced_words(one: Column) -> Column:
    """Lower-case words (A-Z only), each between two spaces of its own; empty if there is none."""
    # Lower-casing beyond A-Z is harmless (no rule holds such letters), but for the Kelvin sign, which becomes a k.
    low = F.when(one.contains("\u212a"), F.translate(one, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(one))
    return F.when(one == "", "").otherwise(F.concat(F.lit(" "), F.replace(low, F.lit(" "), F.lit("  ")), F.lit(" ")))


def _n_words(sql: str) -> str:
    return f"cast((length({sql}) - length(replace({sql}, ' ', ''))) div 2 as bigint)"


def _constant(value: list, kind: str) -> Column:
    """A literal of many parts as one: it is folded when the plan is made."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _running_sums(values: str) -> str:
    """SQL for the running sums of an array of longs: within blocks, then with the sum of the blocks before."""
    add = lambda items, item: f"aggregate({items}, array(0L), (a, x) -> array_append(a, a[size(a) - 1] + {item}))"
    blocks = f"transform(sequence(0, (size(v) - 1) div {BLOCK}), b -> slice({add(f'slice(v, b * {BLOCK} + 1, {BLOCK})', 'x')}, 2, {BLOCK}))"
    before = add("k", "x[size(x) - 1]")
    let = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    return let("v", values, let("k", blocks, let("o", before, "flatten(transform(k, (x, b) -> transform(x, y -> y + o[b])))")))


def with_licenses(docs: DataFrame, name: str = "licenses") -> tuple[DataFrame, str]:
    """docs with one struct column more (its name is returned)."""
    words, present, found = (fresh(docs, n) for n in ("spaced_words", "present_keywords", "rule_matches"))
    name = fresh(docs, name)
    fields = ("rule_id", "label", "keyword", "pattern", "priority", "is_base")
    rules = _constant([dict(zip(fields, r, strict=True)) for r in RULES], "array<struct<rule_id:int,label:string,keyword:string,pattern:string,priority:int,is_base:boolean>>")
    # Columns that are used several times stay projections of their own, so each is computed once.
    out = docs.withColumn(words, _one_spaced(F.col("text")))
    out = out.withColumn(words, _spaced_words(F.col(words)))
    hold = lambda keywords: F.filter(_constant(keywords, "array<string>"), lambda k: F.contains(F.col(words), k))
    out = out.withColumn(present, F.when(F.col(words).contains(STEM), hold(KEYWORDS)).otherwise(hold(OTHER_KEYWORDS)))
    tried = F.filter(rules, lambda r: F.array_contains(F.col(present), r["keyword"]) & F.rlike(F.col(words), r["pattern"]))
    cut = F.transform(
        tried,
        lambda r: F.struct(
            r["rule_id"].alias("rule_id"), r["label"].alias("label"), r["priority"].alias("priority"), r["is_base"].alias("is_base"),
            F.split(F.col(words), r["pattern"], -1).alias("between"), F.regexp_extract_all(F.col(words), r["pattern"], F.lit(0)).alias("hits"),
        ),
    )
    out = out.withColumn(found, F.when(F.size(present) > 0, cut))
    # Word intervals from running sums of the words between matches and in them. Arrays are appended to within blocks
    # only: an array that grew by each match would be copied with each.
    counted = F.expr(f"""
      transform(`{found}`, r -> struct(r.rule_id, r.label, r.priority, r.is_base,
        transform(r.hits, h -> {_n_words("h")}) as inner, transform(r.between, b -> {_n_words("b")}) as outer))""")
    out = out.withColumn(found, counted)
    steps = "transform(r.inner, (w, i) -> w + r.outer[i])"
    out = out.withColumn(found, F.expr(f"transform(`{found}`, r -> struct(r.*, {_running_sums(steps)} as ends))".replace("r.*", "r.rule_id, r.label, r.priority, r.is_base, r.inner")))
    matches = """transform(r.ends, (e, i) -> named_struct(
      's', e - r.inner[i], 'back', -e, 'priority', r.priority, 'rule_id', r.rule_id, 'label', r.label, 'is_base', r.is_base, 'e', e))"""
    out = out.withColumn(found, F.expr(f"array_sort(flatten(transform(`{found}`, r -> {matches})))"))
    # far1..far3: how far the matches of priority 1..3 seen so far reach. A match within reach of its own or a better one goes.
    judged = F.expr(f"""
      aggregate(`{found}`,
        named_struct('far1', -1L, 'far2', -1L, 'far3', -1L, 'labels', cast(array() as array<string>), 'n', 0L, 'best', 9),
        (a, m) -> named_struct(
          'far1', if(m.priority = 1, greatest(a.far1, m.e), a.far1),
          'far2', if(m.priority = 2, greatest(a.far2, m.e), a.far2),
          'far3', if(m.priority = 3, greatest(a.far3, m.e), a.far3),
          'labels', if({(gone := "(a.far1 >= m.e or (m.priority >= 2 and a.far2 >= m.e) or (m.priority >= 3 and a.far3 >= m.e))")}, a.labels, array_union(a.labels, array(m.label))),
          'n', a.n + if({gone}, 0L, 1L),
          'best', if({gone}, a.best, least(a.best, m.priority))))""")
    out = out.withColumn(present, judged)
    base = F.filter(F.coalesce(F.col(found), F.expr(f"cast(array() as {_MATCH})")), lambda m: m["is_base"])
    said = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base_labels = F.transform(base, lambda m: m["label"])
    p = F.col(present)
    fields = F.struct(
        F.expr(_n_words(f"`{words}`")).alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["s"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["s"])).alias("last_word"),
        said(base_labels).alias("base_labels"),
        said(F.array_union(base_labels, F.coalesce(p["labels"], F.expr("cast(array() as array<string>)")))).alias("labels"),
        F.coalesce(p["n"], F.lit(0).cast("long")).alias("n_matches"),
        F.when(p["best"] == 1, SCORES[0]).when(p["best"] == 2, SCORES[1]).when(p["best"] == 3, SCORES[2]).otherwise(0.0).alias("score"),
    )
    return out.withColumn(name, fields).drop(words, present, found), name
