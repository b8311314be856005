"""Quality rules as a bitmask ledger, in DataFrame operations only.

``ledger`` evaluates every rule once and stores one row per document: the measurements and one
integer whose bit r says that rule r failed.  Policies are versioned masks over those bits; applying
one, or asking what a rule adds to it, is bitwise arithmetic on the ledger and reads no text again.

Defined cases: a null or empty text has no words and fails MIN_WORDS; repeated rows are judged one
by one; an empty table gives an empty ledger; other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` is true; its bit in the ledger is its position in RULES."""

    name: str
    fails: str


#: Order is part of the stored format: add at the end, never reorder.
RULES = (
    Rule("min_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbol_share", "100 * n_symbols > 10 * word_chars"),
    Rule("repeated_lines", "n_dup_lines > 2 and 100 * n_dup_lines > 30 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}

#: Policies by version: the rules that they apply.
POLICIES = {
    "base@1": ("min_words", "repeated_words"),
    "prose@1": ("min_words", "repeated_words", "symbol_share", "repeated_lines", "short_words", "long_words"),
}


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def words_of(text: Column) -> Column:
    """The words of a text; the empty array for null, empty and blank texts."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, common.SPACE_RE)).otherwise(F.array().cast("array<string>"))


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that the text holds twice or more, first occurrences included.

    Sorting (window, position) puts equal windows side by side: n log n in the row, no shuffle, and
    no comparison of all pairs.
    """

    def covered(hashes):
        windows = F.transform(
            F.sequence(F.lit(1), F.size(hashes) - 2),
            lambda i: F.struct(
                F.xxhash64(F.get(hashes, i - 1), F.get(hashes, i), F.get(hashes, i + 1)).alias("h"),
                i.alias("i"),
            ),
        )

        def marked(s):
            twice = F.filter(
                s,
                lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]),
            )
            return common.let(
                F.sort_array(F.transform(twice, lambda x: x["i"])),
                lambda at: F.aggregate(
                    F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3)))),
                    F.lit(0),
                    lambda total, x: total + x,
                ),
            )

        return common.let(F.sort_array(windows), marked)

    return F.when(
        F.size(words) >= 4, common.let(F.transform(words, lambda w: F.xxhash64(w)), covered)
    ).otherwise(F.lit(0)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(common.WORD_RE))
    base = docs.select(
        "doc_id",
        words_of(text).alias("words"),
        lines.alias("lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    return base.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and ``fail_bits``: what every policy is computed from."""
    rows = measured(common.id_and_text(docs, id_col, text_col))
    bits = F.lit(0)
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(BIT[rule.name])).otherwise(F.lit(0)))
    return common.null_ids(rows.withColumn("fail_bits", bits))


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    """The ledger with ``kept`` under one policy."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, fail only it, and are kept without it.

    The ledger shrinks to one row per bit pattern (at most 2^rules) before rules are looked at.
    """
    whole = mask(policy)
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).alias("bit")) for n in POLICIES[policy]])
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    only = F.col("bits") == F.col("r.bit")
    return (
        patterns.select("bits", "n", F.explode(rules).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("fails"),
            F.sum(F.when(only, F.col("n")).otherwise(0)).alias("fails_only_this"),
            F.sum(F.when((F.col("bits") == 0) | only, F.col("n")).otherwise(0)).alias("kept_without"),
        )
    )


def op1_quality_rules(spark, sf_dir):
    rows = apply_policy(ledger(common.documents(spark, sf_dir)), "prose@1")
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(mask("base@1"))) != 0).alias("base_failed"),
        "kept",
        "n_lines",
        "fail_bits",
    )


OP1_SQL = r"""
with t as (select doc_id, coalesce(text, '') as body from documents),
w as (select doc_id, body, regexp_extract_all(body, '[^\x20\x09-\x0D]+') as ws,
             list_filter(string_split(body, chr(10)),
                         lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from t),
g as (select doc_id, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) >= 3),
win as (select doc_id, i, ws[i] as a, ws[i + 1] as b, ws[i + 2] as c from g),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from win) q
          where n > 1),
cover as (select doc_id, count(distinct p) as n from
          (select doc_id, unnest([i, i + 1, i + 2]) as p from twice) q group by doc_id),
m as (select w.doc_id, len(ws)::bigint as n_words,
             length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
             (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
             (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
             coalesce(cover.n, 0)::bigint as n_repeat_words, len(ls)::bigint as n_lines
      from w left join cover on w.doc_id = cover.doc_id),
f as (select *, (n_words < 50)::int + 2 * (100 * n_repeat_words > 50 * n_words)::int
             + 4 * (100 * n_symbols > 10 * word_chars)::int + 8 * (n_dup_lines > 2 and 100 * n_dup_lines > 30 * n_lines)::int
             + 16 * (word_chars < 2 * n_words)::int + 32 * (word_chars > 20 * n_words)::int as bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (bits & 3) <> 0 as base_failed, bits = 0 as kept, n_lines, bits::int as fail_bits
from f
"""
