"""Quality rules as a bitmask ledger, with DataFrame functions only.

Every rule is evaluated once per document; a failing rule sets its bit beside the measurements. A policy is a
versioned mask over those bits, so changing a policy or measuring what each rule costs re-reads the ledger and
never the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import WORD, documents, let

#: Rules in bit order: name and the SQL over measurements that is true where the document fails.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("symbols", "2 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
#: A document passes a policy if none of the policy's bits is set.
POLICIES = {"v1": BASE, "v2": (1 << len(RULES)) - 1}
CURRENT = "v2"


def _repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the same text, the first included.

    Windows are told apart by 64-bit hashes. Where all differ, as in most texts, nothing is sorted.
    """

    def covered(windows: Column) -> Column:
        def runs(order: Column) -> Column:
            again = F.filter(order, lambda p, i: (F.get(order, i - 1)["h"] == p["h"]) | F.coalesce(F.get(order, i + 1)["h"] == p["h"], F.lit(False)))
            places = F.array_sort(F.transform(again, lambda p: p["i"]))
            none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("stop"))
            grow = lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["stop"])).cast("long").alias("n"), (p + 3).alias("stop"))
            return F.aggregate(places, none, grow, lambda a: a["n"])

        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(pairs, runs))

    starts = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    return let(F.transform(starts, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), covered)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of each row: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    A null text counts as empty: all zero. Texts are taken whole.
    """
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))

    def by_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated_words(w).alias("n_repeat_words"))

    def by_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    measured = text.select("doc_id", let(F.regexp_extract_all("t", F.lit(WORD), 0), by_words).alias("w"), let(lines, by_lines).alias("l"), F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    return measured.select("doc_id", "w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements plus ``fail_bits``, one bit per rule of RULES, for every row of ``docs``.

    Uses doc_id and text only; other columns, whatever their names, are ignored. Null ids pass through, equal rows
    give equal rows, an empty table gives none.
    """
    bits = [F.when(F.expr(test), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, test) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs).withColumn("fail_bits", total)


def apply_policy(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """``base_failed`` and ``kept`` under one policy; a document that fails a base rule is never kept."""
    mask = POLICIES[version] | BASE
    return book.withColumn("base_failed", F.col("fail_bits").bitwiseAND(BASE) != 0).withColumn("kept", F.col("fail_bits").bitwiseAND(mask) == 0).withColumn("policy", F.lit(version))


def ablation(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that only this rule rejects.

    The ledger is first counted by its bits (2 ** rules rows at most), then read with bitwise masks.
    """
    mask = POLICIES[version]
    seen = book.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).alias("bit")) for n, _ in RULES if BIT[n] & mask)))
    hit = F.col("fail_bits").bitwiseAND(mask)
    each = seen.select(hit.alias("hit"), "n", rules.alias("r")).select("hit", "n", "r.*")
    only = F.sum(F.when(F.col("hit") == F.col("bit"), F.col("n")).otherwise(0))
    return each.groupBy("rule").agg(F.sum(F.when(F.col("hit").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"), only.alias("failed_alone"))


def op8_quality_rules(spark, sf_dir):
    scored = apply_policy(ledger(documents(spark, sf_dir)))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "fail_bits")


def quality_ablation(spark, sf_dir):
    """Per rule of the current policy: how many documents fail it, and how many it alone rejects."""
    found = ablation(ledger(documents(spark, sf_dir)))
    return found.select("rule", F.col("failed").cast("long").alias("failed"), F.col("failed_alone").cast("long").alias("failed_alone"))


def ablation_oracle(table: str = "documents") -> str:
    mask = POLICIES[CURRENT]
    rules = ", ".join(f"('{name}', {BIT[name]})" for name, _ in RULES if BIT[name] & mask)
    return f"SELECT rule, count(*) FILTER (fail_bits & bit <> 0)::BIGINT AS failed, count(*) FILTER (fail_bits & {mask} = bit)::BIGINT AS failed_alone FROM ({oracle(table)}) b, (VALUES {rules}) r(rule, bit) GROUP BY rule"


def oracle(table: str = "documents") -> str:
    bits = " | ".join(f"CASE WHEN {test} THEN {1 << k} ELSE 0 END" for k, (_, test) in enumerate(RULES))
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM {table}),
win AS (SELECT doc_id, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM t)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM win) WHERE c >= 2),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT t.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM t LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, ({bits})::INTEGER AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {BASE}) <> 0 AS base_failed,
  (fail_bits & {POLICIES[CURRENT] | BASE}) = 0 AS kept, n_lines, fail_bits FROM b"""
