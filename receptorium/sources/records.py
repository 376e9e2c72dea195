"""The four public record formats as index rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from receptorium.constants import SOURCE_URL
from receptorium.functions import text
from receptorium.operators.dedup import as_index
from receptorium.sources.files import path_exists, read_delimited, stage_archive_member, with_row_number
from receptorium.sources.quoted import first_records, read_quoted


def _cell(df: DataFrame, name: str) -> Column:
    """Cleaned cell of a column, NULL when the file has no such column."""
    return text.clean(F.col(f"`{name}`")) if name in df.columns else F.lit(None).cast("string")


def apply_synonyms(df: DataFrame, column: str, synonyms: DataFrame | None) -> DataFrame:
    """Approved symbol of a gene by a synonym table (symbol, approved); otherwise the upper-cased input."""
    if synonyms is None:
        return df.withColumn(column, F.upper(column))
    table = synonyms.select(F.upper("symbol").alias("_s"), F.col("approved").alias("_a")).groupBy("_s").agg(F.min("_a").alias("_a"))
    return df.join(table, F.upper(df[column]) == F.col("_s"), "left") \
        .withColumn(column, F.coalesce("_a", F.upper(column))).drop("_s", "_a")


def _finish(df: DataFrame, synonyms: DataFrame | None) -> DataFrame:
    for gene in ("v_gene", "d_gene", "j_gene"):
        if gene in df.columns:
            df = apply_synonyms(df, gene, synonyms)
    return as_index(df)


def vdjdb_rows(raw: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """Numbered VDJdb rows (column ``row``) to index rows; other loci and empty CDR3 are skipped."""
    c = lambda n: _cell(raw, n)
    row = F.col("row").cast("string")
    complex_id = c("complex.id")
    rows = raw.select(
        F.lit("vdjdb").alias("source"), F.concat(F.lit("vdjdb:"), row).alias("source_record_id"),
        F.when(complex_id.isNull() | (complex_id == "0"), F.concat(F.lit("vdjdb:u"), row))
        .otherwise(F.concat(F.lit("vdjdb:c"), complex_id)).alias("pairing_key"),
        text.species_name(c("species")).alias("species"),
        text.recode(F.upper(c("gene")), {"TRA": "alpha", "TRB": "beta"}).alias("chain"),
        c("cdr3").alias("cdr3_aa"), c("v.segm").alias("v_gene"), c("j.segm").alias("j_gene"),
        c("antigen.epitope").alias("epitope_aa"), c("antigen.gene").alias("antigen"),
        c("antigen.species").alias("antigen_organism"), c("mhc.class").alias("mhc_class"),
        c("mhc.a").alias("mhc_a"), c("mhc.b").alias("mhc_b"),
        text.reference_id(c("reference.id")).alias("reference_pmid"),
        F.lit(SOURCE_URL["vdjdb"]).alias("external_url"), c("vdjdb.score").alias("score"),
        F.col("row").alias("src_row"))
    return _finish(rows.filter(F.col("chain").isNotNull() & F.col("cdr3_aa").isNotNull()), synonyms)


def read_vdjdb(spark: SparkSession, path: str, synonyms: DataFrame | None = None) -> DataFrame:
    return vdjdb_rows(with_row_number(read_delimited(spark, path, "\t", multi_line=False)), synonyms)


def _chains(df: DataFrame, alpha: Column, beta: Column, keep: list[str]) -> DataFrame:
    """Wide to long: one struct per chain; a chain without CDR3 gives no row; order alpha, beta."""
    return df.select(*keep, F.posexplode(F.array(alpha, beta)).alias("_pos", "_c")).select(*keep, "_pos", "_c.*") \
        .filter(F.col("cdr3_aa").isNotNull()) \
        .withColumn("src_row", F.col("row") * 2 + F.col("_pos")).drop("_pos", "row")


def mcpas_rows(raw: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """Numbered McPAS rows to index rows: an alpha row, a beta row, or both."""
    raw = raw.withColumnsRenamed({n: n.lstrip("﻿") for n in raw.columns})
    c = lambda n: _cell(raw, n)
    key = F.concat(F.lit("mcpas:"), F.col("row").cast("string"))
    wide = raw.select(
        "row", F.lit("mcpas").alias("source"), key.alias("source_record_id"), key.alias("pairing_key"),
        text.species_name(c("Species")).alias("species"), c("Epitope.peptide").alias("epitope_aa"),
        c("Antigen.protein").alias("antigen"), c("Pathology").alias("antigen_organism"), c("MHC").alias("mhc_a"),
        text.reference_id(c("PubMed.ID")).alias("reference_pmid"), F.lit(SOURCE_URL["mcpas"]).alias("external_url"),
        *[c(n).alias(n.replace(".", "_")) for n in ("CDR3.alpha.aa", "CDR3.alpha.nt", "TRAV", "TRAJ",
                                                    "CDR3.beta.aa", "CDR3.beta.nt", "TRBV", "TRBD", "TRBJ")])
    def side(chain, aa, nt, v, d, j):
        return F.struct(F.lit(chain).alias("chain"), F.col(aa).alias("cdr3_aa"), F.col(nt).alias("cdr3_nt"),
                        F.col(v).alias("v_gene"), (F.col(d) if d else F.lit(None).cast("string")).alias("d_gene"),
                        F.col(j).alias("j_gene"))
    keep = ["row", "source", "source_record_id", "pairing_key", "species", "epitope_aa", "antigen",
            "antigen_organism", "mhc_a", "reference_pmid", "external_url"]
    return _finish(_chains(wide, side("alpha", "CDR3_alpha_aa", "CDR3_alpha_nt", "TRAV", None, "TRAJ"),
                           side("beta", "CDR3_beta_aa", "CDR3_beta_nt", "TRBV", "TRBD", "TRBJ"), keep), synonyms)


def read_mcpas(spark: SparkSession, path: str, synonyms: DataFrame | None = None) -> DataFrame:
    return mcpas_rows(read_quoted(spark, path), synonyms)


def tcr3d_rows(complexes: DataFrame, chains: DataFrame | None = None, synonyms: DataFrame | None = None) -> DataFrame:
    """Numbered structure rows to index rows; missing CDR1/CDR2 come from the chain table, last row first."""
    c = lambda n: _cell(complexes, n)
    wide = complexes.select("row", c("PDB_ID").alias("pdb_id"), text.species_name(c("TCR_organism")).alias("species"),
                            c("Epitope").alias("epitope_aa"), c("MHC_allele").alias("mhc_a"),
                            text.reference_id(c("Pubmed")).alias("reference_pmid"),
                            *[c(f"CDR{i}_{s}").alias(f"cdr{i}_{s}") for s in ("alpha", "beta") for i in (1, 2, 3)],
                            *[c(f"TR{x}{seg}_gene").alias(f"{seg}_{s}".lower()) for s, x in (("alpha", "A"), ("beta", "B")) for seg in "VJ"]) \
        .filter(F.col("pdb_id").isNotNull())
    if chains is not None:
        k = lambda n: _cell(chains, n)
        kind = F.lower(k("tcr_type"))
        pick = lambda s: F.max_by(F.when(kind == s, F.struct(k("cdr1_sequences").alias("cdr1"), k("cdr2_sequences").alias("cdr2"))),
                                  F.when(kind == s, F.col("row"))).alias(f"fill_{s}")
        fill = chains.filter(kind.isin("alpha", "beta") & k("pdb_id").isNotNull()) \
            .groupBy(k("pdb_id").alias("pdb_id")).agg(pick("alpha"), pick("beta"))
        wide = wide.join(fill, "pdb_id", "left")
    def side(s):
        filled = lambda n: F.coalesce(F.col(f"{n}_{s}"), F.col(f"fill_{s}.{n}")) if chains is not None else F.col(f"{n}_{s}")
        return F.struct(F.lit(s).alias("chain"), F.col(f"cdr3_{s}").alias("cdr3_aa"), F.col(f"v_{s}").alias("v_gene"),
                        F.col(f"j_{s}").alias("j_gene"), filled("cdr1").alias("cdr1_aa"), filled("cdr2").alias("cdr2_aa"))
    keep = ["row", "pdb_id", "species", "epitope_aa", "mhc_a", "reference_pmid"]
    out = _chains(wide, side("alpha"), side("beta"), keep)
    key = F.concat(F.lit("tcr3d:"), F.col("pdb_id"))
    return _finish(out.withColumns({
        "source": F.lit("tcr3d"), "pairing_key": key, "source_record_id": F.concat(key, F.lit(":"), F.col("chain")),
        "external_url": F.concat(F.lit(SOURCE_URL["tcr3d"]), F.col("pdb_id"))}), synonyms)


def read_tcr3d(spark: SparkSession, complexes: str, chains: str | None = None, synonyms: DataFrame | None = None) -> DataFrame:
    fill = with_row_number(read_delimited(spark, chains, "\t", multi_line=False)) if chains and path_exists(spark, chains) else None
    return tcr3d_rows(with_row_number(read_delimited(spark, complexes, "\t", multi_line=False)), fill, synonyms)


def read_iedb(spark: SparkSession, path: str, synonyms: DataFrame | None = None) -> DataFrame:
    """Receptor export with two header rows: group names, then column names."""
    raw = read_quoted(spark, path, header=False)
    place = list(zip(*first_records(spark, path, 2)))
    data = raw.filter("row >= 2").withColumn("row", F.col("row") - 2)
    columns = [c for c in raw.columns if c != "row"]
    of = {key: columns[i] for i, key in enumerate(place)}
    cell = lambda group, name: text.clean(F.col(of[(group, name)])) if (group, name) in of else F.lit(None).cast("string")
    receptor = cell("Receptor", "IEDB Receptor ID")
    key = F.concat(F.lit("iedb:"), receptor)

    def side(group):
        pick = lambda a, b: F.coalesce(cell(group, a), cell(group, b))
        v, j = pick("Curated V Gene", "Calculated V Gene"), pick("Curated J Gene", "Calculated J Gene")
        chain = text.alpha_beta_of_genes(v, j)
        return F.struct(
            chain.alias("chain"),
            F.when(chain.isNotNull(), pick("CDR3 Curated", "CDR3 Calculated")).alias("cdr3_aa"),
            v.alias("v_gene"), pick("Curated D Gene", "Calculated D Gene").alias("d_gene"), j.alias("j_gene"),
            cell(group, "Protein Sequence").alias("full_aa"), cell(group, "Nucleotide Sequence").alias("full_nt"),
            pick("CDR1 Curated", "CDR1 Calculated").alias("cdr1_aa"), pick("CDR2 Curated", "CDR2 Calculated").alias("cdr2_aa"),
            text.taxon_species(cell(group, "Organism IRI")).alias("species"))

    wide = data.filter(receptor.isNotNull()).select(
        "row", F.lit("iedb").alias("source"), key.alias("source_record_id"), key.alias("pairing_key"),
        cell("Epitope", "Name").alias("epitope_aa"), cell("Epitope", "Source Molecule").alias("antigen"),
        cell("Epitope", "Source Organism").alias("antigen_organism"), cell("Assay", "MHC Allele Names").alias("mhc_a"),
        F.coalesce(cell("Receptor", "Group IRI"), F.concat(F.lit(SOURCE_URL["iedb"]), receptor)).alias("external_url"),
        side("Chain 1").alias("_1"), side("Chain 2").alias("_2"))
    keep = [c for c in wide.columns if c not in ("_1", "_2")]
    return _finish(_chains(wide, F.col("_1"), F.col("_2"), keep), synonyms)


def present_sources(spark: SparkSession, raw_dir: str, staging: str, synonyms: DataFrame | None = None) -> dict[str, DataFrame]:
    """Index rows of every source found in a snapshot folder, in index order; archives win over flat files."""
    out = {}
    if path_exists(spark, f"{raw_dir}/vdjdb-*.zip"):
        out["vdjdb"] = read_vdjdb(spark, stage_archive_member(spark, f"{raw_dir}/vdjdb-*.zip", "vdjdb.slim.txt", f"{staging}/vdjdb"), synonyms)
    elif path_exists(spark, f"{raw_dir}/vdjdb_slim.txt"):
        out["vdjdb"] = read_vdjdb(spark, f"{raw_dir}/vdjdb_slim.txt", synonyms)
    if path_exists(spark, f"{raw_dir}/iedb_receptor_full_v3.zip"):
        out["iedb"] = read_iedb(spark, stage_archive_member(spark, f"{raw_dir}/iedb_receptor_full_v3.zip", "tcr_full_v3.csv", f"{staging}/iedb"), synonyms)
    elif path_exists(spark, f"{raw_dir}/iedb_tcr.csv"):
        out["iedb"] = read_iedb(spark, f"{raw_dir}/iedb_tcr.csv", synonyms)
    if path_exists(spark, f"{raw_dir}/mcpas.csv"):
        out["mcpas"] = read_mcpas(spark, f"{raw_dir}/mcpas.csv", synonyms)
    if path_exists(spark, f"{raw_dir}/tcr3d_complexes.tsv"):
        out["tcr3d"] = read_tcr3d(spark, f"{raw_dir}/tcr3d_complexes.tsv", f"{raw_dir}/tcr3d_chain.tsv", synonyms)
    return out
