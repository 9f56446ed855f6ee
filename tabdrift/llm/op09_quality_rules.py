"""Quality rules as a bitmask ledger (native).

Every rule is evaluated once per document; the ledger stores the measurements and one integer with a bit for each rule
that failed. Policies are versioned masks over those bits, so changing a policy or computing an ablation never looks at
a text again: both are bitwise operations and aggregations over the ledger.

Cases: a null text counts as empty; an empty text has no words and fails too_few_words; repeated rows are judged one by
one; an empty table gives an empty ledger; other columns of the input, whatever their names, are ignored by ledger()
and kept by keep().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let

#: Name of each rule and its condition over the measurements; bit i stands for the i-th.
RULES = (
    ("too_few_words", "n_words < 50"),
    ("repeated_trigrams", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)"),
    ("shouting", "100 * n_upper > 50 * word_chars"),
    ("exclamation", "100 * n_exclamation > 30 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Version of a policy: mask of the rules that reject.
POLICIES = {
    "base": BIT["too_few_words"] | BIT["repeated_trigrams"],
    "v1": (1 << len(RULES)) - 1,
}


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more, first ones included."""
    n = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )

    def covered(at: Column) -> Column:
        steps = F.zip_with(F.slice(at, F.lit(1), F.size(at) - 1), F.slice(at, F.lit(2), F.size(at) - 1), lambda a, b: F.least(F.lit(3), b - a))
        return F.aggregate(steps, F.lit(3), lambda s, x: s + x)

    def repeated(s: Column) -> Column:
        found = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        return let(F.sort_array(F.transform(found, lambda x: x["i"])), lambda at: F.when(F.size(at) > 0, covered(at)).otherwise(0))

    def counted(w: Column) -> Column:
        pairs = F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(F.sort_array(pairs), repeated))

    return F.when(n < 4, F.lit(0)).otherwise(let(windows, counted)).cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, measurements, failed (bitmask of failed rules)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    lacking = lambda chars: F.length("t") - F.length(F.regexp_replace("t", chars, ""))
    d = d.select(
        "doc_id",
        F.array_remove(F.split("t", SPACE), "").alias("words"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        lacking(r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        lacking(r"\p{Lu}").cast("long").alias("n_upper"),
        lacking("!").cast("long").alias("n_exclamation"),
    )
    d = d.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        "n_upper",
        "n_exclamation",
    )
    bits = [F.when(F.expr(rule), BIT[name]).otherwise(0) for name, rule in RULES]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return d.withColumn("failed", mask)


def fails(policy: str) -> Column:
    """Whether a ledger row fails the policy."""
    return F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) != 0


def keep(docs: DataFrame, policy: str = "v1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that pass a policy, with all their columns. The ledger is computed in the same scan.

    The running number keeps the filter above the ledger: pushed below it, the filter would split a text again for each
    of its words, as the split would stand inside the lambda functions."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = ledger(docs.select(whole.alias("row"), F.col(text_col).alias("text")), "row").withColumn("pin", F.monotonically_increasing_id())
    return rows.where(~fails(policy) & (F.col("pin") >= 0)).select("doc_id.*")


def ablation(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: documents failing it, failing it alone, and kept without it.

    One aggregation over the distinct masks, at most 2 to the number of rules, so nothing grows with the corpus."""
    active = F.col("failed").bitwiseAND(F.lit(POLICIES[policy]))
    masks = rows.groupBy(active.alias("mask")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(b).alias("bit")) for k, b in BIT.items() if b & POLICIES[policy]])
    each = masks.select("mask", "n", F.explode(rules).alias("r")).select("mask", "n", "r.*")
    without = F.col("mask").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0
    hit = F.col("mask").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule", "bit").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("mask") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_failed_alone"),
        F.coalesce(F.sum(F.when(without, F.col("n"))), F.lit(0)).alias("n_kept_without"),
    )


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    rows = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        fails("base").alias("base_failed"), (~fails("v1")).alias("kept"), F.col("failed").cast("long").alias("failed"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t,
    list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), g AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS tri
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
), r AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS n FROM g) WHERE n > 1
), c AS (
  SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY rid
), m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    len(lines) AS n_lines,
    length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper,
    length(t) - length(replace(t, '!', '')) AS n_exclamation
  FROM w LEFT JOIN c ON c.rid = w.rid
), f AS (
  SELECT *, CAST(
      CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words) THEN 16 ELSE 0 END
    + CASE WHEN 100 * n_upper > 50 * word_chars THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_exclamation > 30 * n_words THEN 64 ELSE 0 END AS BIGINT) AS failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failed = 0 AS kept, failed
FROM f
"""
