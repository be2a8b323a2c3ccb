"""Quality rules as a bitmask ledger.

Every rule is evaluated once a document: the ledger holds the measurements and one bit for each rule that fails.
A policy is a named, versioned set of bits; applying one, or counting what each rule costs alone, reads the ledger and never the
text again.  Built-in functions only; no shuffle for the ledger.

Nulls: a null text has no words and fails few_words.  Repeated rows: each is measured for itself.  Extra columns
are kept in the struct row, whatever their names, and not read.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import let, words
from .shared import table

SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
#: Rules by bit: a name and when a document fails.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("long_words", "word_chars > 15 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
#: Versions of the policy: what fails any of its bits goes.
POLICIES = {"base-1": BASE, "web-1": BASE | BIT["symbols"] | BIT["repeated_lines"] | BIT["long_words"]}
CURRENT = "web-1"


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows found twice or more: windows sorted with their places, those equal to a neighbour
    kept, and their places in order; each adds three words less its overlap with the one before.  Windows are compared by 64-bit hashes."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")))
    places = let(
        F.sort_array(windows),
        lambda s: F.sort_array(
            F.transform(F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))), lambda x: x["i"])
        ),
    )
    covered = let(places, lambda p: F.aggregate(p, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")), lambda a: a["n"]))
    return F.when(F.size(w) >= 4, covered).otherwise(0)


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, ledger): the documents as a struct, and their measurements and fail_bits."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)

    def measured(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        )

    m = docs.select(F.struct(*docs.columns).alias("row"), let(words(F.col(text)), measured).alias("ledger"))
    at = {name: F.col("ledger.lines.n") if name == "n_lines" else F.col("ledger.lines.dup") if name == "n_dup_lines" else F.col(f"ledger.{name}") for name in MEASURES}
    m = m.withColumn("ledger", F.struct(*(c.alias(name) for name, c in at.items())))
    bits = F.lit(0).cast("long")
    for name, fails in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(_named(fails)), F.lit(BIT[name])).otherwise(0).cast("long"))
    return m.withColumn("ledger", F.col("ledger").withField("fail_bits", bits))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with a struct column `ledger`, which they must not have."""
    return judged(docs, text).select("row.*", "ledger")


def _named(rule: str) -> str:
    for name in sorted(MEASURES, key=len, reverse=True):
        rule = " ".join(f"ledger.{x}" if x == name else x for x in rule.split(" "))
    return rule


def passes(policy: str = CURRENT) -> Column:
    return F.col("ledger.fail_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(ledgers: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that would be kept without it, from counts by bit pattern."""
    patterns = ledgers.groupBy(F.col("ledger.fail_bits").bitwiseAND(F.lit(POLICIES[policy])).alias("bits")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in BIT.items() if b & POLICIES[policy]]
    each = patterns.select("bits", "n", F.explode(F.array(*rules)).alias("r"))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "row.doc_id",
        *(F.col(f"ledger.{m}").alias(m) for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        (F.col("ledger.fail_bits").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"),
        passes().alias("kept"),
        F.col("ledger.fail_bits").alias("fail_bits"),
    )


QUERIES = {"op8_quality_rules": op8_quality_rules}
SQL = {
    "op8_quality_rules": r"""
WITH t AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT row, i, count(*) OVER (PARTITION BY row, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
r AS (
  SELECT row, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY row),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN r USING (row))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
    OR 100 * n_dup_lines > 30 * n_lines OR word_chars > 15 * n_words) AS kept,
  CAST(CAST(n_words < 50 AS INT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS INT) + 4 * CAST(10 * n_symbols > n_words AS INT)
    + 8 * CAST(100 * n_dup_lines > 30 * n_lines AS INT) + 16 * CAST(word_chars > 15 * n_words AS INT) AS BIGINT) AS fail_bits
FROM m"""
}
