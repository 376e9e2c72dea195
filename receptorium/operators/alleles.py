"""Allele search with text filters, over fetched records plus seed rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from receptorium.operators.pairwise import first_rows
from receptorium.operators.substrings import containing
from receptorium.session import cut_lineage

NAME_GRAM = 3


def _contains(haystack: Column, needle: Column) -> Column:
    return (needle == "") | F.lower(F.coalesce(haystack, F.lit(""))).contains(needle)


def _normal(filters: DataFrame, *keys: str | Column) -> DataFrame:
    return filters.select(*keys, *[F.lower(F.trim(F.coalesce(c, F.lit("")))).alias(f"f_{c}") for c in ("gene_name", "region", "species", "sequence_contains")]) \
        .withColumnRenamed("f_gene_name", "f_gene")


def matching_alleles(filters: DataFrame, alleles: DataFrame, most: int | None = None) -> DataFrame:
    """Alleles that pass each filter (qid, gene_name, region, species, sequence_contains); an empty filter passes all.

    Substrings are looked up among the distinct gene names and the distinct sequences; rows then meet by equal name and, for filters
    with a piece of sequence, by equal sequence. With ``most``, a filter by gene only takes the first ``most`` rows of a gene, and an
    empty one the first ``most`` of all: enough for a page of that size.
    """
    f = _normal(filters, "qid")
    rows = alleles.withColumns({"gene_key": F.coalesce("gene_name", F.lit("")), "seq_key": F.lower(F.coalesce("sequence", F.lit("")))})
    known = rows.select("gene_key").distinct()
    met = containing(f.select(F.col("f_gene").alias("needle")), known.select(F.lower("gene_key").alias("text")), NAME_GRAM).toDF("f_gene", "name_key")
    names = known.withColumn("name_key", F.lower("gene_key")).join(met, "name_key").select("f_gene", "gene_key")
    names = cut_lineage(names.unionByName(known.withColumn("f_gene", F.lit(""))))
    by_gene_only = (F.col("f_region") == "") & (F.col("f_species") == "") & (F.col("f_sequence_contains") == "")
    by_sequence = F.col("f_sequence_contains") != ""
    if most is None:
        parts = [(f.filter(~by_sequence), rows)]
    else:
        parts = [(f.filter(by_gene_only & (F.col("f_gene") == "")), rows.orderBy("ord").limit(most)),
                 (f.filter(by_gene_only & (F.col("f_gene") != "")), first_rows(rows, ["gene_key"], [F.col("ord")], most).drop("rank")),
                 (f.filter(~by_gene_only & ~by_sequence), rows)]
    found = [some.join(names, "gene_key").join(asked, "f_gene") for asked, some in parts]
    pieces = f.filter(by_sequence)
    held = containing(pieces.select(F.col("f_sequence_contains").alias("needle")), rows.select(F.col("seq_key").alias("text"))).toDF("f_sequence_contains", "seq_key")
    found.append(rows.join(held, "seq_key").join(names, "gene_key").join(pieces, ["f_gene", "f_sequence_contains"]).select(*found[0].columns))
    met = reduce(lambda a, b: a.unionByName(b), found).filter(
        _contains(F.col("region"), F.col("f_region")) & ((F.col("f_species") == "") | (F.col("f_species") == F.lower(F.coalesce("species", F.lit(""))))))
    return met.drop("f_gene", "f_region", "f_species", "f_sequence_contains", "gene_key", "seq_key")


def search_alleles(filters: DataFrame, alleles: DataFrame, seeds: DataFrame | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Page of matches per request: fetched alleles first, then seed rows whose name was not returned yet. Equal filters are
    answered once."""
    fields = ["f_gene", "f_region", "f_species", "f_sequence_contains"]
    asked = _normal(filters, F.col("qid").alias("_request")).withColumn("qid", F.concat_ws("\x01", *fields))
    one = asked.select("qid", F.col("f_gene").alias("gene_name"), *[F.col(c).alias(c[2:]) for c in fields[1:]]).distinct()
    # A page is full before a cut list of fetched rows ends, so the cut never lets a seed row in.
    found = matching_alleles(one, alleles, offset + limit).withColumn("part", F.lit(0))
    if seeds is not None:
        extra = matching_alleles(one, seeds)
        seen = found.select("qid", F.col("allele_name")).filter("allele_name is not null").distinct()
        extra = extra.join(seen, ["qid", "allele_name"], "left_anti").withColumn("part", F.lit(1))
        found = found.unionByName(extra, allowMissingColumns=True)
    page = first_rows(found, ["qid"], [F.col("part"), F.col("ord")], offset + limit)
    return page.filter(F.col("rank") > offset).join(asked.select("qid", "_request"), "qid").drop("qid").withColumnRenamed("_request", "qid")
