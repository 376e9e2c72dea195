"""Groups of bucketed sets: bounded meetings of their members, links that span them, and connected components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from receptorium.llm.shared import tidy, written

#: tasks over which the members of one component are dealt
SALTS = 8
MEETING = ["_bucket", "_kind", "_i", "_j"]


def blocks(frames, columns: list[str], key):
    """Rows of a sorted partition as arrays per group, over batch borders; a group has at most two blocks."""
    held = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        group = frame[key].to_numpy()
        change = np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1
        if not len(change):
            held = frame
            continue
        edges = [0, *change.tolist()]
        arrays = {c: frame[c].to_numpy() for c in columns}
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield {c: v[a:b] for c, v in arrays.items()}
        held = frame.iloc[edges[-1]:]
    if held is not None and len(held):
        yield {c: held[c].to_numpy() for c in columns}


def _dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism), *keys)


def components(edges: DataFrame) -> DataFrame:
    """(_text, _comp) of every end of an edge: the least text of its component. Each round takes the least label among the
    neighbours and then the label of that label, so long chains close in a few rounds."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    label = written(both.groupBy(F.col("a").alias("_text")).agg(F.least(F.min("b"), F.first("a")).alias("_comp")), "labels")
    salt = F.pmod(F.xxhash64("_text"), F.lit(SALTS)).cast("int")
    while True:
        near = both.join(label.withColumnRenamed("_text", "b"), "b").groupBy(F.col("a").alias("_text")).agg(F.min("_comp").alias("_near"))
        step = label.join(near, "_text").select("_text", F.least("_comp", "_near").alias("_new"), F.col("_comp").alias("_old"), salt.alias("_salt"))
        # the members of a big component are dealt by salt; a label that has no lesser label itself needs no row
        hop = step.filter(F.col("_new") < F.col("_text")).select(F.col("_text").alias("_new"), F.col("_new").alias("_next"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        jump = step.join(hop, ["_new", "_salt"], "left")
        after = written(jump.select("_text", F.coalesce("_next", "_new").alias("_comp"), "_old"), "labels")
        label = after.select("_text", "_comp")
        if after.filter(F.col("_comp") != F.col("_old")).isEmpty():
            return label


def _meetings(placed: DataFrame, size: int) -> DataFrame:
    """Members of groups with several components, copied to the pairs of bounded blocks in which they meet. The members of a
    group's largest component only meet the others, never each other."""
    parts = placed.groupBy("_bucket", "_comp").agg(F.count(F.lit(1)).alias("_n"))
    mixed = (parts.groupBy("_bucket").agg(F.max(F.struct("_n", "_comp")).alias("_top"), F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_comps"))
             .filter(F.col("_comps") > 1).select("_bucket", F.col("_top._comp").alias("_main"), F.ceil(F.col("_top._n") / size).cast("int").alias("_mains"),
                                                  F.ceil((F.col("_all") - F.col("_top._n")) / size).cast("int").alias("_rests")))
    main = F.col("_comp") == F.col("_main")
    block = F.pmod(F.xxhash64("_text", F.lit(1)), F.when(main, F.col("_mains")).otherwise(F.col("_rests"))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    spot = lambda kind, i, j, side: F.struct(F.lit(kind).alias("_kind"), i.alias("_i"), j.alias("_j"), side.cast("int").alias("_side"))
    to_rest = F.transform(upto("_rests"), lambda f: spot(0, F.col("_block"), f, F.lit(1)))
    to_main = F.transform(upto("_mains"), lambda m: spot(0, m, F.col("_block"), F.lit(2)))
    among = F.transform(upto("_rests"), lambda f: spot(1, F.least(f, F.col("_block")), F.greatest(f, F.col("_block")),
                                                       F.when(f == F.col("_block"), 0).when(F.col("_block") < f, 1).otherwise(2)))
    return (placed.select("_bucket", "_text", "_comp").join(mixed, "_bucket").withColumn("_block", block)
            .select("_bucket", "_text", "_comp", F.explode(F.when(main, to_rest).otherwise(F.concat(to_main, among))).alias("_spot"))
            .select("_bucket", "_text", "_comp", "_spot.*"))


def linked(members: DataFrame, payload: DataFrame, compare, schema: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(links, components) of groups ``members`` (_bucket, _text, _n members). First every block of about ``size`` members
    by itself, then all pairs of blocks that still hold different components."""
    def run(rows: DataFrame) -> DataFrame:
        full = _dealt(rows.join(payload, "_text"), MEETING).sortWithinPartitions(*MEETING, "_text")
        return written(full.mapInPandas(tidy(compare), schema), "links")

    block = F.pmod(F.xxhash64("_text", F.lit(1)), F.ceil(F.col("_n") / size)).cast("int")  # 0 for a group of one block
    alone = members.select("_bucket", "_text", F.col("_text").alias("_comp"), F.lit(0).alias("_kind"), block.alias("_i"), block.alias("_j"), F.lit(0).alias("_side"))
    links = run(alone)
    comp = components(links)
    large = members.filter(F.col("_n") > size)  # the others are one block, and done
    if large.isEmpty():
        return links, comp
    placed = large.select("_bucket", "_text").join(comp, "_text", "left").withColumn("_comp", F.coalesce("_comp", "_text"))
    more = run(_meetings(written(placed, "placed"), size))
    if more.isEmpty():
        return links, comp
    links = links.union(more)
    return links, components(links)
