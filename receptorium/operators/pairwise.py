"""Meeting two sets inside a block without a cross join.

Each side is cut into hash pieces of a target size, each piece is copied once per piece of the
other side, and a cogroup hands one bounded pair of pieces to a task. A block that holds most of
the data only gets more pieces.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from receptorium.session import cut_lineage, spread


def _pieces(df: DataFrame, block: list[str], name: str, size: int) -> DataFrame:
    return df.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias(name))


def meet(left: DataFrame, right: DataFrame, block: list[str], left_id: list[str], right_id: list[str],
         left_size: int, right_size: int, score: Callable, schema: str) -> DataFrame:
    """Run ``score(left_rows, right_rows)`` on every pair of pieces of each block.

    ``left_id`` and ``right_id`` name the columns whose hash picks the piece.
    """
    right = right.toDF(*right.columns)  # fresh column identities, so that a set can meet itself
    plan = cut_lineage(_pieces(left, block, "_nl", left_size).join(_pieces(right, block, "_nr", right_size), block))
    l = (left.join(plan, block)
         .withColumn("_l", F.pmod(F.xxhash64(*left_id), F.col("_nl")).cast("int"))
         .withColumn("_r", F.explode(F.sequence(F.lit(0), F.col("_nr") - 1))).drop("_nl", "_nr"))
    r = (right.join(plan, block)
         .withColumn("_r", F.pmod(F.xxhash64(*right_id), F.col("_nr")).cast("int"))
         .withColumn("_l", F.explode(F.sequence(F.lit(0), F.col("_nl") - 1))).drop("_nl", "_nr"))
    keys = [*block, "_l", "_r"]
    return spread(l, *keys).groupBy(*keys).cogroup(spread(r, *keys).groupBy(*keys)).applyInPandas(score, schema)


def first_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of every key; Spark trims each task's rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
