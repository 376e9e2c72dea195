"""User files as gene records: FASTA, delimited text, JSON, free text, and receptor exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from receptorium.constants import SPECIES_NAMES, WHITESPACE
from receptorium.functions import text
from receptorium.functions.parsing import FREE_GENE_PATTERN
from receptorium.sources.files import read_delimited
from receptorium.sources.germline import fasta_entries

RECORD_FIELDS = ["source", "species", "gene_name", "allele_name", "region", "sequence", "antigen_epitope", "metadata"]
# --- fixed values: file extensions; a run of nucleotides in free text ------------------------------------------------
FASTA_EXTENSIONS, TAB_EXTENSIONS = ("fa", "fasta", "fna", "faa"), ("tsv", "txtv")
DNA_RUN_PATTERN = r"(?i)\b[ACGT]{12,}\b"


def _records(df: DataFrame, source: str, metadata: Column | None = None, **fields: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    cols = {"source": F.lit(source), **fields, "metadata": metadata if metadata is not None else F.lit(None).cast("map<string,string>")}
    keep = [c for c in ("file",) if c in df.columns]
    return df.select(*keep, *[cols.get(f, none).alias(f) for f in RECORD_FIELDS])


def header_species(header: Column) -> Column:
    t = F.lower(header)
    return (F.when(t.contains("homo sapiens") | t.contains("human"), F.lit("human"))
            .when(t.contains("mus musculus") | t.contains("mouse"), F.lit("mouse")))


def fasta_gene(header: Column) -> Column:
    """struct(gene, allele, region) of a pipe-separated header; the gene falls back to the first gene-like word."""
    parts = F.transform(F.split(header, r"\|"), lambda x: F.trim(x, F.lit(WHITESPACE)))
    at = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit(""))
    guess = F.nullif(F.regexp_extract(header, FREE_GENE_PATTERN.replace("{2,6}", "{1,4}"), 1), F.lit(""))
    return F.struct(F.coalesce(at(1), guess, F.lit("unknown")).alias("gene"), F.get(parts, F.lit(0)).alias("allele"), at(2).alias("region"))


def fasta_records(entries: DataFrame, source: str, species: str = "other") -> DataFrame:
    """entries(header, seq) to gene records."""
    header = F.col("header")
    g = fasta_gene(header)
    meta = F.create_map(F.lit("description"), header, F.lit("record_id"), F.split(header, r"\s+")[0])
    return _records(entries, source, meta, species=F.coalesce(header_species(header), F.lit(species)), gene_name=g["gene"],
                    allele_name=g["allele"], region=g["region"], sequence=F.upper("seq"))


def cdr3_fasta(entries: DataFrame) -> DataFrame:
    """(id, seq) of a CDR3 FASTA, blank sequences dropped."""
    return entries.select(F.split("header", r"\s+")[0].alias("id"), F.upper(F.trim("seq", F.lit(WHITESPACE))).alias("seq")) \
        .filter(F.length("seq") > 0)


def table_records(df: DataFrame, source: str, species: str = "other", need: tuple[str, ...] = ("sequence", "cdr3")) -> DataFrame:
    """Delimited or JSON rows to gene records; rows without any of the needed fields are dropped."""
    cell = lambda n: F.nullif(F.col(f"`{n}`").cast("string"), F.lit("")) if n in df.columns else F.lit(None).cast("string")
    names = [c for c in df.columns if c != "file" and not c.startswith("_")]
    meta = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"`{n}`").cast("string") for n in names]))
    rows = df.filter(F.coalesce(*[cell(n) for n in need]).isNotNull())
    return _records(rows, source, meta, species=F.coalesce(cell("species"), F.lit(species)),
                    gene_name=F.coalesce(cell("gene_name"), cell("gene"), cell("v_segm"), F.lit("unknown")),
                    allele_name=F.coalesce(cell("allele_name"), cell("allele")), region=cell("region"),
                    sequence=F.upper(F.coalesce(cell("sequence"), cell("cdr3"), F.lit(""))), antigen_epitope=cell("antigen_epitope"))


def dna_runs(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Numbered nucleotide runs of a text column."""
    runs = F.regexp_extract_all(F.col(column), F.lit(DNA_RUN_PATTERN), F.lit(0))
    return df.select(*keys, F.posexplode(runs).alias("_i", "_s")).select(
        *keys, (F.col("_i") + 1).alias("n"), F.concat(F.lit("text-seq-"), (F.col("_i") + 1).cast("string")).alias("gene_name"),
        F.upper("_s").alias("sequence"))


def text_records(df: DataFrame, source: str, species: str = "other") -> DataFrame:
    runs = dna_runs(df, "value", *[c for c in ("file",) if c in df.columns])
    return _records(runs, source, F.create_map(F.lit("parser"), F.lit("plain-text")), species=F.lit(species),
                    gene_name=F.col("gene_name"), sequence=F.col("sequence"))


def export_records(df: DataFrame) -> DataFrame:
    """Receptor export rows (cdr3, v_segm, ...) to gene records; unknown species become ``other``."""
    cell = lambda n: F.col(f"`{n}`") if n in df.columns else F.lit(None).cast("string")
    full = lambda n: F.nullif(cell(n), F.lit(""))
    cdr3 = F.upper(text.strip(cell("cdr3")))
    key = F.replace(F.lower(text.strip(cell("species"))), F.lit(" "), F.lit(""))
    meta = F.map_from_arrays(F.array(*[F.lit(n) for n in _EXPORT_META]), F.array(*[cell(n) for n in _EXPORT_META]))
    return _records(df.filter(F.coalesce(cdr3, F.lit("")) != ""), "vdjdb", meta,
                    species=F.coalesce(text.recode(key, SPECIES_NAMES), F.lit("other")),
                    gene_name=F.coalesce(full("v_segm"), full("v_gene"), F.lit("unknown")), allele_name=full("mhc_a"),
                    region=F.lit("CDR3"), sequence=cdr3, antigen_epitope=full("antigen_epitope"))


_EXPORT_META = ["j_segm", "mhc_b", "mhc_class", "antigen_gene", "antigen_species", "score"]


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Receptor export whose first line decides between tab and comma."""
    first = spark.read.text(path).first()
    return export_records(read_delimited(spark, path, "\t" if first and "\t" in first.value else ","))


def _glob(*extensions: str) -> str:
    """File name pattern of extensions in either case."""
    either = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions]
    return "*." + (either[0] if len(either) == 1 else "{" + ",".join(either) + "}")


def extension_kind(path: Column) -> Column:
    """How an upload is read, by its extension in either case; anything unknown is free text."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return (F.when(ending.isin(*FASTA_EXTENSIONS), F.lit("fasta")).when(ending == "csv", F.lit("csv"))
            .when(ending.isin(*TAB_EXTENSIONS), F.lit("tsv")).when(ending == "json", F.lit("json")).otherwise(F.lit("text")))


def json_records(df: DataFrame, source: str, species: str = "other") -> DataFrame:
    """Whole JSON texts (column ``value``: one object or an array of objects) to gene records. Every key of a row is kept in
    its metadata; rows without a sequence are dropped."""
    one = F.from_json("value", "map<string,string>")
    many = F.from_json("value", "array<map<string,string>>")
    rows = df.select(*[c for c in ("file",) if c in df.columns],
                     F.explode(F.when(F.ltrim("value", F.lit(WHITESPACE)).startswith("{"), F.array(one)).otherwise(many)).alias("_row"))
    cell = lambda n: F.nullif(F.try_element_at("_row", F.lit(n)), F.lit(""))
    return _records(rows.filter(cell("sequence").isNotNull()), source, F.col("_row"), species=F.coalesce(cell("species"), F.lit(species)),
                    gene_name=F.coalesce(cell("gene_name"), cell("gene"), cell("v_segm"), F.lit("unknown")),
                    allele_name=F.coalesce(cell("allele_name"), cell("allele")), region=cell("region"),
                    sequence=F.upper(cell("sequence")), antigen_epitope=cell("antigen_epitope"))


def ingest_uploads(spark: SparkSession, folder: str, source: str, species: str = "other") -> DataFrame:
    """All files under a folder as gene records, each format by its extension, the rest as free text."""
    def files(patterns):
        return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", patterns)
    name = F.col("_metadata.file_path").alias("file")
    fasta = files(_glob(*FASTA_EXTENSIONS)).option("lineSep", ">").text(folder).select("*", name)
    lines = F.transform(F.split("value", "\n"), lambda x: F.rtrim(x, F.lit(" \t\r")))
    fasta = fasta.select("file", lines.alias("l")).filter(F.length(F.col("l")[0]) > 0).select(
        "file", F.col("l")[0].alias("header"), F.array_join(F.slice("l", F.lit(2), F.size("l")), "").alias("seq"))
    out = [fasta_records(fasta, source, species)]
    for pattern, sep in ((_glob("csv"), ","), (_glob(*TAB_EXTENSIONS), "\t")):
        for path in _paths(files(pattern).format("binaryFile").load(folder)):
            out.append(table_records(read_delimited(spark, path, sep).withColumn("file", F.lit(path)), source, species))
    rows = files(_glob("json")).option("wholetext", "true").text(folder).select("value", name)
    out.append(json_records(rows, source, species))
    rest = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(folder).select("value", name) \
        .filter(extension_kind(F.col("file")) == "text")
    out.append(text_records(rest, source, species))
    return reduce(lambda a, b: a.unionByName(b), out)


def _paths(listing: DataFrame) -> list[str]:
    """Paths of a file listing: delimited files have their own headers, so each is its own scan."""
    return [r.path for r in listing.select("path").collect()]


__all__ = ["fasta_entries", "ingest_uploads"]
