"""Repertoire profiles: gene usage, CDR3 lengths, and letters by position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from receptorium.constants import STANDARD_AA
from receptorium.functions import text

# --- fixed value: CDR3 lengths of a profile ---------------------------------------------------------
LENGTHS = (7, 22)


def _genes(index: DataFrame, *segments: str) -> DataFrame:
    """Rows with a species and with the named segments; the other segment may be missing."""
    return index.select("species", "chain", "source", "cdr3_aa", text.gene_base(F.col("v_gene")).alias("v"), text.gene_base(F.col("j_gene")).alias("j")) \
        .filter(reduce(lambda a, s: a & (F.col(s) != ""), segments, F.col("species").isNotNull()))


def gene_usage(index: DataFrame, segment: str) -> DataFrame:
    """Frequency of a gene per species and chain, with its standard deviation over the sources."""
    rows = _genes(index, segment).withColumnRenamed(segment, "gene")
    per_source = rows.groupBy("species", "chain", "source", "gene").agg(F.count(F.lit(1)).alias("n"))
    key = ["species", "chain"]
    source_total = Window.partitionBy(*key, "source")
    shares = per_source.withColumn("share", F.col("n") / F.sum("n").over(source_total))
    n_sources = per_source.groupBy(*key).agg(F.count_distinct("source").alias("n_sources"))
    totals = per_source.groupBy(*key).agg(F.sum("n").alias("total"))
    agg = shares.groupBy(*key, "gene").agg(F.sum("n").alias("n"), F.sum("share").alias("s1"), F.sum(F.col("share") * F.col("share")).alias("s2"))
    # a source without the gene counts as share 0
    m = F.col("n_sources")
    variance = (F.col("s2") - F.col("s1") * F.col("s1") / m) / (m - 1)
    return agg.join(totals, key).join(n_sources, key).select(
        *key, "gene", (F.col("n") / F.col("total")).alias("freq"),
        F.when(m > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))).otherwise(F.lit(0.0)).alias("std"))


def cdr3_lengths(index: DataFrame) -> DataFrame:
    """Share of each CDR3 length per (species, chain, V, J), within the profile lengths."""
    rows = _genes(index, "v", "j").withColumn("len", F.length("cdr3_aa")).filter(F.col("len").between(*LENGTHS))
    counts = rows.groupBy("species", "chain", "v", "j", "len").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("species", "chain", "v", "j")))


def position_letters(index: DataFrame) -> DataFrame:
    """Share of each amino acid per position, per (species, chain, V, J, length)."""
    rows = _genes(index, "v", "j").withColumn("len", F.length("cdr3_aa")).filter(F.col("len").between(*LENGTHS))
    key = ["species", "chain", "v", "j", "len"]
    rows = rows.groupBy(*key, "cdr3_aa").agg(F.count(F.lit(1)).alias("w"))  # identical CDR3 explode once
    letters = rows.select(*key, "w", F.posexplode(F.split("cdr3_aa", "")).alias("pos", "aa")) \
        .filter(F.col("aa").rlike(f"^[{STANDARD_AA}]$"))
    counts = letters.groupBy(*key, "pos", "aa").agg(F.sum("w").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*key, "pos")))


def repertoire_baseline(index: DataFrame) -> dict[str, DataFrame]:
    return {"v_usage": gene_usage(index, "v"), "j_usage": gene_usage(index, "j"), "lengths": cdr3_lengths(index), "letters": position_letters(index)}
