"""Known epitopes of genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from receptorium.functions import text
from receptorium.operators.pairwise import first_rows
from receptorium.session import sent_if_small


def known_epitopes(genes: DataFrame, index: DataFrame, top: int = 5) -> DataFrame:
    """First epitopes (index order) of the records of a V gene and the total number of such records.

    genes: qid, gene, species. Returns qid, epitopes, total.
    """
    rows = index.filter(F.col("epitope_aa").isNotNull()).select(
        text.gene_base(F.col("v_gene")).alias("_g"), text.species_key(F.col("species")).alias("_s"), "epitope_aa", "src_row")
    asked = genes.select("qid", text.gene_base(F.col("gene")).alias("_g"), text.species_key(F.col("species")).alias("_s")).filter("_g <> ''")
    wanted = sent_if_small(asked.select("_g", "_s").distinct())
    hits = rows.join(wanted, ["_g", "_s"], "left_semi")
    totals = hits.groupBy("_g", "_s").agg(F.count(F.lit(1)).alias("total"))
    heads = first_rows(hits, ["_g", "_s"], [F.col("src_row")], top).groupBy("_g", "_s").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "epitope_aa"))), lambda x: x["epitope_aa"]).alias("epitopes"))
    return asked.join(totals, ["_g", "_s"]).join(heads, ["_g", "_s"]).select("qid", "epitopes", "total")
