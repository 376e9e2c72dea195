"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` reads every text once and stores measurements and one failure bit per rule. Policies are versioned masks over these
bits, so a changed policy or an ablation is bitwise arithmetic on the ledger and never reads a text again.

Defined cases: a null, empty or blank text has no words, all its counts are 0 and it fails ``few_words``; equal lines and
windows are compared exactly; repeated rows are judged one by one; other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class QualityRule:
    """``fails``: SQL condition over the measurements."""

    name: str
    fails: str


# The order fixes the bits: new rules go to the end, so that stored ledgers stay readable.
RULES = (
    QualityRule("few_words", "n_words < 50"),
    QualityRule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    QualityRule("symbols", "10 * n_symbols > n_words"),
    QualityRule("shouting", "10 * n_upper > 3 * word_chars"),
    QualityRule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    QualityRule("long_words", "word_chars > 20 * n_words"),
    QualityRule("digits", "2 * n_digits > word_chars"),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BIT[n] for n in names)


#: Policies by name and version; a text is kept if none of the mask's bits is set.
POLICIES = {
    "base/1": mask("few_words", "repeated_words"),
    "prose/1": mask("few_words", "repeated_words", "symbols", "shouting", "repeated_lines"),
    "prose/2": mask(*BIT),
}


def _repeats(windows: Column) -> Column:
    """Words covered by windows that occur twice or more. ``windows``: sorted (text, place) structs."""
    own = F.transform(windows, lambda x, j: F.when((x["t"] == F.get(windows, j - 1)["t"]) | (x["t"] == F.get(windows, j + 1)["t"]), x["i"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    add = lambda acc, i: F.struct((i + 3).alias("end"), (acc["n"] + i + 3 - F.greatest(i, acc["end"])).alias("n"))
    return F.aggregate(F.sort_array(F.array_compact(own)), start, add, lambda acc: acc["n"])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every text."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    split = texts.select("doc_id", "text", F.filter(F.split("text", f"{SPACE}+"), lambda w: w != "").alias("words"),
                         F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE[1:-1]}]")).alias("lines"))
    last = F.size("words") - 2
    window = lambda x, i: F.struct(F.concat_ws(" ", x, F.get("words", i + 1), F.get("words", i + 2)).alias("t"), i.alias("i"))
    windows = F.when(last > 0, F.sort_array(F.slice(F.transform("words", window), F.lit(1), F.greatest(last, F.lit(0)))))
    counted = split.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), (F.char_length("text") - F.regexp_count("text", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), windows.alias("windows"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"), F.regexp_count("text", F.lit("[0-9]")).cast("long").alias("n_digits"))
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_upper", "n_digits",
                          F.coalesce(_repeats(F.col("windows")), F.lit(0)).cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document: measurements and ``failed``, the bits of all rules that fail."""
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(BIT[rule.name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs).withColumn("failed", bits)


def passes(failed: Column, policy: str) -> Column:
    return failed.bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: rows that fail it, that fail it alone, and that the policy would keep without it."""
    whole = POLICIES[policy]
    inside = F.col("failed").bitwiseAND(F.lit(whole).cast("long"))
    rules = [(n, b) for n, b in BIT.items() if b & whole]
    sums = [F.struct(F.lit(n).alias("rule"), F.count_if(inside.bitwiseAND(F.lit(b).cast("long")) != 0).alias("n_failed"),
                     F.count_if(inside == b).alias("n_alone"), F.count_if(inside.bitwiseAND(F.lit(whole & ~b).cast("long")) == 0).alias("n_kept_without"))
            for n, b in rules]
    return book.agg(F.array(*sums).alias("_rows")).select(F.inline("_rows"))


def verdicts(docs: DataFrame, policy: str = "prose/2") -> DataFrame:
    """Per document: the measurements, base_failed and kept under ``policy``."""
    book = ledger(docs)
    base = ~passes(F.col("failed"), "base/1")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
                       (~base & passes(F.col("failed"), policy)).alias("kept"), "failed")
