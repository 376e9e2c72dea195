"""Union of harmonized sources, keep-first duplicates, and their counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from receptorium.constants import DEDUP_KEY, INDEX_COLUMNS, LABELLED_COLUMNS, LABELLED_KEY, LABELLED_REQUIRED
from receptorium.operators.pairwise import first_rows


def as_index(df: DataFrame) -> DataFrame:
    """Index columns in order, the missing ones NULL, CDR3 trimmed and upper-cased, empty CDR3 dropped."""
    have = set(df.columns)
    cols = [F.col(c).cast("string").alias(c) if c in have else F.lit(None).cast("string").alias(c)
            for c in INDEX_COLUMNS]
    extra = ["src_row"] if "src_row" in have else []
    out = df.select(*cols, *extra).withColumn("cdr3_aa", F.upper(F.trim(F.col("cdr3_aa"))))
    return out.filter(F.length("cdr3_aa") > 0)


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All sources in one table; rows keep their order through ``src_ord`` (source) and ``src_row``."""
    tagged = [f.withColumn("src_ord", F.lit(i)) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of every key in the given order; NULL keys compare equal."""
    return first_rows(df, keys, [F.col(c) for c in order], 1, "_rn").drop("_rn")


def dedup_index(df: DataFrame) -> DataFrame:
    order = [c for c in ("src_ord", "src_row") if c in df.columns]
    return keep_first(df, DEDUP_KEY, order)


def source_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))


def sources_searched(index: DataFrame) -> DataFrame:
    return index.agg(F.array_sort(F.collect_set("source")).alias("sources"))


def labelled_positives(raw: DataFrame) -> DataFrame:
    """Labelled rows kept for similarity search: positives with all required fields, de-duplicated."""
    rows = raw.filter(F.col("label") == 1) if "label" in raw.columns else raw
    rows = rows.dropna(subset=LABELLED_REQUIRED)
    keep = [c for c in LABELLED_COLUMNS if c in raw.columns]
    if "src_row" in raw.columns:
        return keep_first(rows.select(*keep, "src_row"), LABELLED_KEY, ["src_row"])
    return rows.select(*keep).dropDuplicates([c for c in LABELLED_KEY if c in keep])


def label_counts(raw: DataFrame, kept: DataFrame) -> DataFrame:
    negatives = F.count_if(F.col("label") == 0) if "label" in raw.columns else F.lit(0)
    totals = raw.agg(F.count(F.lit(1)).alias("rows_total"), negatives.alias("rows_dropped_negative"), F.lit(0).cast("long").alias("rows_kept"))
    rest = kept.agg(F.lit(0).cast("long").alias("rows_total"), F.lit(0).cast("long").alias("rows_dropped_negative"), F.count(F.lit(1)).alias("rows_kept"))
    return totals.unionByName(rest).agg(*[F.sum(c).alias(c) for c in totals.columns])
