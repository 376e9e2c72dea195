"""Which texts contain which needles, by postings of short substrings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

GRAM = 5


def _substrings(c: Column, n: int) -> Column:
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: c.substr(i, F.lit(n))))) \
        .otherwise(F.array().cast("array<string>"))


def containing(needles: DataFrame, texts: DataFrame, gram: int = GRAM) -> DataFrame:
    """Pairs (needle, text) of distinct, non-empty ``needles`` (needle) and ``texts`` (text) where the text contains the needle.

    A needle of at least ``gram`` letters is looked up under the rarest of its substrings of that length and then verified, a shorter
    one under itself, which needs no proof. Only substrings that some needle asks for are posted.
    """
    needles = needles.filter("needle <> ''").select("needle").distinct()
    asked = needles.select("needle", F.explode(F.when(F.length("needle") < gram, F.array("needle")).otherwise(_substrings(F.col("needle"), gram))).alias("key"))
    lengths = sorted(r[0] for r in asked.select(F.length("key")).distinct().collect())  # at most ``gram`` values
    if not lengths:
        return needles.limit(0).select("needle", F.lit(None).cast("string").alias("text"))
    keys = F.concat(*[_substrings(F.col("text"), n) for n in lengths])
    posted = texts.filter("text is not null").select("text").distinct().select("text", F.explode(keys).alias("key")).join(asked.select("key").distinct(), "key", "left_semi")
    often = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # a needle with a substring that no text has is in no text
    rarest = asked.join(often, "key", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("k")).filter("k.n > 0")
    return rarest.select("needle", F.col("k.key").alias("key")).join(posted, "key").filter(F.col("text").contains(F.col("needle"))).select("needle", "text")
