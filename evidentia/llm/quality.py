"""Quality rules as a ledger: each rule is evaluated once, its failure is a bit, and policies are masks over the bits.

The ledger of a document holds its measurements and ``failed_bits``.  A policy, which has a version, names the rules
that reject; applying one, or counting what a change of policy would do, reads the ledger only.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import words

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    name: str
    bit: int
    fails: str  # a condition over the measurements


#: Bits are never reused: a changed rule gets a new one.
RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > 2 * n_words"),
    Rule("capitals", 3, "n_letters > 0 and 2 * n_capitals > n_letters"),
    Rule("word_length", 4, "n_words > 0 and (word_chars < 2 * n_words or word_chars > 25 * n_words)"),
    Rule("duplicate_lines", 5, "n_lines >= 4 and 10 * n_dup_lines > 6 * n_lines"),
)
BASE = ("few_words", "repeated_windows")
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols", "capitals"),
    "v2": (*BASE, "symbols", "capitals", "word_length", "duplicate_lines"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals")


def mask(names: Iterable[str]) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[n] for n in names)


def measured(docs: DataFrame) -> DataFrame:
    """``doc`` (the whole row as a struct) and the measurements of its ``text``, each a long.

    n_repeat_words: every three-word window becomes a hash with its position in the low bits; after sorting, windows that
    may occur twice are neighbours.  Those are sorted again by their words, which settles it, and the words they cover
    are counted once each.
    """
    text = F.coalesce(F.col("doc.text").cast("string"), F.lit(""))
    out = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"))
    out = out.select("doc", words(text).alias("w"))
    out = out.select("doc", "w", F.size("w").alias("n"), F.expr("cast(ceil(log2(size(w) + 1)) as int)").alias("low"))
    window = F.transform(
        F.sequence(F.lit(0), F.col("n") - 3),
        lambda i: F.call_function("shiftleft", F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)), F.col("low")).bitwiseOR(i.cast("long")),
    )
    out = out.withColumn("s", F.when(F.col("n") >= 3, F.sort_array(window)).otherwise(F.array().cast("array<long>")))
    high = lambda x: F.call_function("shiftrightunsigned", x, F.col("low"))
    twice = F.filter("s", lambda x, j: (high(x) == high(F.get("s", j - 1))) | (high(x) == high(F.get("s", j + 1))))
    at = F.expr("shiftleft(1L, low) - 1")
    word = lambda x, j: F.get("w", x.bitwiseAND(at).cast("int") + j)
    spelt = lambda x: F.struct(F.concat_ws(" ", word(x, 0), word(x, 1), word(x, 2)).alias("words"), x.bitwiseAND(at).alias("at"))
    again = F.filter("t", lambda x, j: (x["words"] == F.get("t", j - 1)["words"]) | (x["words"] == F.get("t", j + 1)["words"]))
    covered = F.flatten(F.transform(again, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2)))
    out = out.withColumn("t", F.sort_array(F.transform(twice, spelt)))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    kept_only = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    out = out.select(
        "doc",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        kept_only(r"[^#*$%&|<>]+").cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.size(F.array_distinct(covered)).cast("long").alias("n_repeat_words"),
        kept_only(r"[^\p{L}]+").cast("long").alias("n_letters"),
        kept_only(r"[^\p{Lu}]+").cast("long").alias("n_capitals"),
    )
    out = out.withColumn("n_lines", F.size("lines").cast("long"))
    return out.withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("lines"))).select("doc", *MEASURES)


def ledger(docs: DataFrame) -> DataFrame:
    """``doc``, the measurements and ``failed_bits`` (long) of each row of ``docs``, which has a ``text``.

    A null or empty text has no words or lines and fails ``few_words``.  Rows are judged one by one: repeated rows
    get equal results, and whatever columns the table has stay inside ``doc``.
    """
    bits = F.lit(0).cast("long")
    for r in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured(docs).withColumn("failed_bits", bits)


def judged(book: DataFrame, policy: str = "v2") -> DataFrame:
    """Adds ``base_failed`` and ``kept``, the verdict of a policy; a document that fails the base is never kept."""
    base, own = mask(BASE), mask(POLICIES[policy]) | mask(BASE)
    return book.withColumn("base_failed", F.col("failed_bits").bitwiseAND(F.lit(base)) != 0).withColumn(
        "kept", F.col("failed_bits").bitwiseAND(F.lit(own)) == 0
    )


def ablations(book: DataFrame, policy: str = "v2") -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects, and that the policy keeps without it.

    ``bits_any`` and ``bits_all`` are the or and the and of the failure bits of the documents that fail the rule: which
    other rules ever, and always, fail with it.  One pass and one small aggregation over the ledger.
    """
    own = mask(POLICIES[policy])
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if r.name in POLICIES[policy]])
    seen = book.select(F.col("failed_bits").bitwiseAND(F.lit(own)).alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    fails = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    without = F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0
    return (
        seen.select("bits", "n", F.explode(rules).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(fails & without, F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(without, F.col("n")).otherwise(0)).alias("n_kept_without"),
            F.bit_or(F.when(fails, F.col("bits"))).alias("bits_any"),
            F.bit_and(F.when(fails, F.col("bits"))).alias("bits_all"),
        )
    )
