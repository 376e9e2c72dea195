"""Germline FASTA scans, allele catalogs, representative genes, and the small static tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from receptorium.constants import CONSTANT_REGIONS, D_ALLELES
from receptorium.functions import sequence, text
from receptorium.sources.files import read_delimited, with_row_number


def fasta_entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, header, seq): wrapped lines joined and upper-cased. ``ord`` grows in file order."""
    raw = spark.read.option("lineSep", ">").text(path)
    lines = F.transform(F.split("value", "\n"), lambda x: F.rtrim(x, F.lit(" \t\r")))
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        (F.col("_metadata.file_block_start") * (1 << 20) + F.monotonically_increasing_id() % (1 << 33)).alias("ord"),
        lines.alias("lines")).filter(F.length(F.col("lines")[0]) > 0).select(
        "file", "ord", F.col("lines")[0].alias("header"),
        F.upper(F.array_join(F.slice("lines", F.lit(2), F.size("lines")), "")).alias("seq"))


def germline_entries(spark: SparkSession, root: str, files: str = "*/TR[ABGD].fasta", place: str = r"([^/]+)/([^/.]+)\.[^/]+$") -> DataFrame:
    """(species, chain, segment, allele, gene, nt, ord) of ``root/SPECIES/CHAIN.fasta`` files, or of other ``files`` whose path names
    species and chain by the groups of ``place``.

    The header's second field is the allele, its last field marks the segment; leaders are dropped.
    """
    e = fasta_entries(spark, f"{root}/{files}")
    fields = F.split("header", r"\|")
    marker = F.upper(F.trim(F.element_at(fields, -1)))
    segment = (F.when(marker.contains("VARIABLE") | marker.contains("V-REGION"), F.lit("V"))
               .when(marker.contains("JOINING") | marker.contains("J-REGION"), F.lit("J"))
               .when(marker.contains("CONSTANT"), F.lit("C")))
    allele = F.upper(F.trim(F.get(fields, F.lit(1))))
    return e.filter(F.size(fields) >= 2).select(
        F.lower(F.regexp_extract("file", place, 1)).alias("species"), F.upper(F.regexp_extract("file", place, 2)).alias("chain"),
        segment.alias("segment"), allele.alias("allele"), F.split_part(allele, F.lit("*"), F.lit(1)).alias("gene"),
        F.col("seq").alias("nt"), "ord").filter(F.col("segment").isNotNull())


def representative_genes(entries: DataFrame) -> DataFrame:
    """One sequence per gene: the last ``*01`` allele seen, else the first allele; ``ord`` is the gene's first row."""
    is_first = F.col("allele").contains("*01")
    weight = F.struct(is_first.alias("a"), F.when(is_first, F.col("ord")).otherwise(-F.col("ord")).alias("b"))
    return entries.groupBy("species", "chain", "segment", "gene").agg(
        F.max_by("nt", weight).alias("nt"), F.min("ord").alias("ord"))


def allele_catalog(entries: DataFrame) -> DataFrame:
    """Distinct alleles with their translation; the first of a repeated name wins."""
    key = ["species", "chain", "segment", "allele"]
    first = entries.groupBy(*key).agg(F.min_by("nt", "ord").alias("nt"), F.min("ord").alias("ord"))
    frames = [F.col(f"aa{f}") for f in range(3)]
    first = first.select("*", *sequence.frames(F.col("nt")))
    first = first.withColumn("_frame", F.when(F.col("segment") == "J", sequence.j_anchor(frames)["frame"])
                             .when(F.col("segment") == "C", sequence.fewest_stops(frames)).otherwise(0))
    read = F.when(F.col("_frame") == 0, frames[0]).when(F.col("_frame") == 1, frames[1]).otherwise(frames[2])
    aa = (F.when(F.col("segment").isin("V", "C"), sequence.drop_one_stop(read))
          .when(F.col("segment") == "J", read).otherwise(F.lit("")))
    return first.select(*key, F.split_part("allele", F.lit("*"), F.lit(1)).alias("gene"), "nt", aa.alias("aa"), "ord")


def d_alleles(spark: SparkSession) -> DataFrame:
    """Beta D alleles in catalog shape."""
    return spark.createDataFrame(D_ALLELES, "species string, chain string, allele string, nt string").select(
        "species", "chain", F.lit("D").alias("segment"), "allele",
        F.split_part("allele", F.lit("*"), F.lit(1)).alias("gene"), "nt", F.lit("").alias("aa"), F.lit(0).cast("long").alias("ord"))


def constant_regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONSTANT_REGIONS, "species string, chain string, constant_aa string, constant_source string")


def loop_table(raw: DataFrame) -> DataFrame:
    """V loops (organism, id, cdr1, cdr2, cdr25) from a gene table with columns organism, id, region, cdrs and, if
    known, the row order ``ord``: the last row of an id counts."""
    parts = F.split("cdrs", ";")
    rows = raw.filter((F.col("region") == "V") & (F.size(parts) >= 3)).select(
        F.lower("organism").alias("organism"), "id", parts[0].alias("cdr1"), parts[1].alias("cdr2"), parts[2].alias("cdr25"),
        F.col("ord") if "ord" in raw.columns else F.struct("cdrs").alias("ord"))
    last = rows.groupBy("organism", "id").agg(F.max_by(F.struct("cdr1", "cdr2", "cdr25"), "ord").alias("_l"))
    return last.select("organism", "id", "_l.cdr1", "_l.cdr2", "_l.cdr25")


def read_loops(spark: SparkSession, path: str) -> DataFrame:
    return loop_table(with_row_number(read_delimited(spark, path, "\t", multi_line=False), "ord"))


def germline_species(species: Column) -> Column:
    """Species whose germline is used: mouse for mouse, human for everything else."""
    return F.when(text.species_key(species) == "mouse", F.lit("mouse")).otherwise(F.lit("human"))
