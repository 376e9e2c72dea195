"""Allele service payloads, landed as JSON files, as flat gene records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

PAYLOAD = ("accession string, name string, class string, locus string, status string, date_assigned string, "
           "date_modified string, sequence struct<coding:string,genomic:string,protein:string>, "
           "organism struct<commonName:string,scientificName:string,`group`:string,taxon:string>")


def allele_records(payloads: DataFrame, project: str = "HLA", combined: bool = False) -> DataFrame:
    """payloads(value: JSON of one allele) to gene records.

    The plain form is the human collection; ``combined`` is the multi-species one, which keeps more
    metadata, a longer protein prefix, and the species named in the payload.
    """
    p = payloads.select(F.from_json("value", PAYLOAD).alias("p")).select("p.*")
    name = F.coalesce("name", F.lit(""))
    base = F.split_part(name, F.lit("*"), F.lit(1))
    coding, protein = F.coalesce("sequence.coding", F.lit("")), F.coalesce("sequence.protein", F.lit(""))
    if combined:
        gene = F.when(~F.upper(base).startswith("HLA"), F.concat(F.lit("HLA-"), base)).otherwise(base) if project == "HLA" else base
        human = F.lower(F.coalesce("organism.commonName", F.lit(""))).contains("human") | F.lit(project == "HLA")
        species, source, size, backend = F.when(human, "human").otherwise("other"), "mhc", 80, "ebi-ipd-mhc"
        extra = {"mhc_class": "class", "locus": "locus", "organism_common": "organism.commonName",
                 "organism_scientific": "organism.scientificName", "organism_group": "organism.group", "taxon": "organism.taxon",
                 "date_assigned": "date_assigned", "date_modified": "date_modified", "status": "status"}
    else:
        gene = F.when(base != "", F.concat(F.lit("HLA-"), base)).otherwise("unknown")
        species, source, size, backend = F.lit("human"), "hla", 60, "ebi-imgt-hla"
        extra = {"hla_class": "class"}
    meta = {"accession": F.col("accession"), **{k: F.col(v) for k, v in extra.items()},
            "genomic_seq_len": F.length(F.coalesce("sequence.genomic", F.lit(""))).cast("string"),
            "protein_seq": F.left(protein, F.lit(size)), "backend": F.lit(backend)}
    return p.select(F.lit(source).alias("source"), species.alias("species"), gene.alias("gene_name"), name.alias("allele_name"),
                    F.lit("coding").alias("region"), coding.alias("sequence"),
                    F.map_from_arrays(F.array(*[F.lit(k) for k in meta]), F.array(*meta.values())).alias("metadata"))
