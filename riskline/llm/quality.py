"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document and leaves one bit and its measurement in the
ledger. A policy is a versioned set of bits, so applying another policy, or asking what each
rule removes on its own, reads the ledger and never the text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskline.llm.text import SPACES, let, whole, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A rule fails a document when ``fails``, SQL over the measurements, is true."""

    name: str
    fails: str


# The position in this tuple is the rule's bit, so rules are only ever appended.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "100 * n_symbols > 30 * n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
)

# Versioned policies: the rules that reject. Earlier versions stay as they are.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words"),
}
CURRENT = "v1"


def policy_bits(policy: str = CURRENT, rules: tuple[Rule, ...] = RULES) -> int:
    """Bitmask of the rules that ``policy`` applies."""
    names = [r.name for r in rules]
    return sum(1 << names.index(name) for name in POLICIES[policy])


def _repeated_words(hashes: Column) -> Column:
    """Words inside windows that occur twice or more; ``hashes`` has one item per window start."""

    def covered(by_hash: Column) -> Column:
        again = F.filter(
            by_hash,
            lambda e, i: F.get(by_hash, i - 1)["h"].eqNullSafe(e["h"]) | F.get(by_hash, i + 1)["h"].eqNullSafe(e["h"]),
        )
        return let(
            F.array_sort(F.transform(again, lambda e: e["i"])),
            lambda starts: F.aggregate(
                F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW)))),
                F.lit(0),
                lambda total, n: total + n,
            ),
        )

    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, covered))


def measurements(text: Column) -> Column:
    """Struct of all measurements of a text, each computed once."""

    def of_words(w: Column) -> Column:
        windows = let(
            F.transform(w, lambda x: F.xxhash64(x)),
            lambda h: F.when(
                F.size(h) >= WINDOW,
                F.transform(F.slice(h, F.lit(1), F.size(h) - (WINDOW - 1)), lambda _, i: F.xxhash64(F.slice(h, i + 1, WINDOW))),
            ).otherwise(F.array().cast("array<bigint>")),
        )
        return F.struct(F.size(w).alias("n_words"), let(windows, _repeated_words).alias("n_repeat_words"))

    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    return F.struct(
        let(words(text), of_words).alias("w"),
        of_lines.alias("l"),
        F.length(F.translate(text, SPACES, "")).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
    )


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the measurements and ``fail_bits``, one row per row of ``docs``.

    A null text has no words. Repeated rows and null ids stay rows of their own, an empty
    table gives an empty ledger, and columns of ``docs`` outside ``keep`` and ``text`` are not
    looked at, whatever their names. Equality of 8-word windows is that of their 64-bit
    hashes inside one document. No shuffle, no UDF.
    """
    measured = docs.select(*keep, measurements(whole(text)).alias("__m"))
    flat = measured.select(
        *keep,
        F.col("__m.w.n_words").cast("long").alias("n_words"),
        F.col("__m.word_chars").cast("long").alias("word_chars"),
        F.col("__m.n_symbols").cast("long").alias("n_symbols"),
        F.col("__m.l.n_lines").cast("long").alias("n_lines"),
        F.col("__m.l.n_dup_lines").cast("long").alias("n_dup_lines"),
        F.col("__m.w.n_repeat_words").cast("long").alias("n_repeat_words"),
    )
    bits = F.lit(0).cast("long")
    for bit, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.expr(f"CASE WHEN {rule.fails} THEN {1 << bit}L ELSE 0L END"))
    return flat.withColumn("fail_bits", bits)


def verdict(policy: str = CURRENT) -> Column:
    """True where the ledger row passes the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy_bits(policy)).cast("long")) == 0


def ablation(entries: DataFrame, policy: str = CURRENT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of the policy: documents that fail it, and those that it alone rejects.

    One aggregation over the distinct masks, of which there are at most 2 ** len(rules).
    """
    mask = policy_bits(policy, rules)
    masks = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).count()
    table = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << b).cast("long").alias("bit")) for b, r in enumerate(rules) if mask >> b & 1])
    each = masks.select("bits", "count", F.explode(table).alias("r"))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("count")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("count")).otherwise(0)).alias("only_by_this"),
    )


def passing(docs: DataFrame, policy: str = CURRENT, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy does not reject, with their columns unchanged."""
    entries = ledger(docs.select(F.struct("*").alias("doc"), F.col(text).alias("text")), keep=("doc",))
    return entries.where(verdict(policy)).select("doc.*")


def op7_quality_ledger(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    base = F.col("fail_bits").bitwiseAND(F.lit(policy_bits("base")).cast("long")) != 0
    return ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & verdict()).alias("kept"), "fail_bits",
    )


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT row, i, w[i:i + 7] AS win FROM w, unnest(generate_series(1, len(w) - 7)) AS u(i)),
rep AS (SELECT row, i FROM win QUALIFY count(*) OVER (PARTITION BY row, win) > 1),
cov AS (SELECT row, sum(least(8, nxt - i)) AS n FROM (
    SELECT row, i, coalesce(lead(i) OVER (PARTITION BY row ORDER BY i), i + 8) AS nxt FROM rep) GROUP BY row),
l AS (SELECT row, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT doc_id, len(w) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (row) JOIN l USING (row) LEFT JOIN cov USING (row)),
b AS (SELECT *, CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END AS fail_bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept,
  CAST(fail_bits AS BIGINT) AS fail_bits FROM b
"""
