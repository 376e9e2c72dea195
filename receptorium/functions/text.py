"""Column functions over record fields: names, genes, species, MHC, scores, references."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from receptorium.constants import (
    CHAIN_LABELS, CHAINS, HLA_LOCI, MHC_PROJECT_PREFIXES, NA_CELLS, SPECIES_NAMES, STANDARD_AA,
    TAXON_SPECIES, WHITESPACE,
)


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def recode(key: Column, values: dict[str, str], default: Column | None = None) -> Column:
    """``key`` translated through a short dictionary, as a CASE expression."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(default) if default is not None else out


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITESPACE))


def clean(c: Column) -> Column:
    """Cell without surrounding space; NULL when it carries no value."""
    t = strip(c)
    return F.when(~F.lower(t).isin(*NA_CELLS), t)


def species_name(c: Column) -> Column:
    key = F.replace(F.lower(strip(F.coalesce(c, F.lit("")))), F.lit(" "), F.lit(""))
    return recode(key, SPECIES_NAMES, key)


def taxon_species(iri: Column) -> Column:
    tail = F.element_at(F.split(F.rtrim(clean(iri), F.lit("/")), "/"), -1)
    taxon = F.element_at(F.split(tail, "_"), -1)
    return F.coalesce(recode(taxon, TAXON_SPECIES, F.lower(tail)), F.lit(""))


def gene_symbol(c: Column) -> Column:
    """Gene symbol as used in the index; see ``operators.genes.apply_synonyms`` for a synonym table."""
    return F.upper(clean(c))


def gene_base(c: Column) -> Column:
    return F.coalesce(F.split_part(F.upper(strip(c)), F.lit("*"), F.lit(1)), F.lit(""))


def allele_suffix(c: Column) -> Column:
    """Text after the first ``*`` of a gene name, NULL when there is none."""
    part = F.upper(strip(F.split_part(c, F.lit("*"), F.lit(2))))
    return F.when(part != "", part)


def chain_code(gene: Column) -> Column:
    """TRA/TRB/TRG/TRD of a V or J gene; TRB where the name says nothing."""
    head = F.substring(F.upper(F.split_part(F.trim(gene, F.lit("*")), F.lit("*"), F.lit(1))), 1, 4)
    known = {f"{c}{s}": c for c in CHAINS for s in "VJ"}
    return recode(head, known, F.lit("TRB"))


def chain_label(code: Column) -> Column:
    return recode(code, CHAIN_LABELS)


def chain_label_strict(gene: Column) -> Column:
    """alpha/beta/gamma/delta only for names that start with a receptor locus, else NULL."""
    g = F.upper(strip(gene))
    return F.when((F.length(g) >= 4) & F.substring(g, 1, 3).isin(*CHAINS), chain_label(chain_code(g)))


def alpha_beta_of_genes(*genes: Column) -> Column:
    """First gene that names the alpha or beta locus decides; other loci give NULL."""
    picks = []
    for gene in genes:
        g = F.upper(clean(gene))
        picks.append(F.when(F.substring(g, 1, 3).isin("TRA", "TRB"), chain_label(chain_code(g))))
    return F.coalesce(*picks)


def chain_synonym(c: Column) -> Column:
    key = F.lower(strip(F.coalesce(c, F.lit(""))))
    words = {label: code for code, label in CHAIN_LABELS.items()} | {c.lower(): c for c in CHAINS}
    return recode(key, words)


def segment_letter(gene: Column) -> Column:
    g = F.upper(strip(gene))
    letter = F.substring(g, 4, 1)
    return F.when((F.length(g) >= 4) & g.startswith("TR") & letter.isin("V", "D", "J", "C"), letter)


def v_family(gene: Column) -> Column:
    return F.coalesce(F.split_part(F.split_part(gene, F.lit("*"), F.lit(1)), F.lit("-"), F.lit(1)), F.lit(""))


def germline_gene(gene: Column) -> Column:
    """Gene base in germline spelling: the alpha/delta dual names use a slash."""
    return F.regexp_replace(gene_base(gene), r"-DV(\d)", "/DV$1")


def reference_id(c: Column) -> Column:
    s = strip(F.replace(F.replace(clean(c), F.lit("PMID:"), F.lit("")), F.lit("PMID"), F.lit("")))
    doi = F.lower(s).startswith("10.") & s.contains("/")
    return F.when(s.rlike("^[0-9]+$") | doi, s)


def mhc_organism(c: Column) -> Column:
    s = F.upper(strip(c))
    return F.when(s.startswith("HLA"), F.lit("human")).when(s.startswith("H2") | s.startswith("H-2"), F.lit("mouse"))


def mhc_is_cross_species(mhc: Column, species: Column) -> Column:
    organism = mhc_organism(mhc)
    return F.coalesce(organism != F.lower(strip(F.coalesce(species, F.lit("")))), F.lit(False))


def species_key(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def score_number(c: Column) -> Column:
    return F.coalesce(strip(c).try_cast("double"), F.lit(float("-inf")))


def nonstandard_residues(seq: Column) -> Column:
    """Sorted distinct letters outside the twenty amino acids."""
    foreign = F.regexp_replace(F.upper(seq), f"[{STANDARD_AA}]", "")
    letters = F.filter(F.split(foreign, ""), lambda ch: ch != "")
    return F.coalesce(F.array_sort(F.array_distinct(letters)), F.array().cast("array<string>"))


def alphabet(seq: Column) -> Column:
    s = F.upper(strip(F.coalesce(seq, F.lit(""))))
    return F.when(s.rlike("^[ACGTN]+$"), F.lit("nucleotide")).otherwise(F.lit("amino_acid"))


def similarity(distance: Column, max_distance: Column) -> Column:
    """1 - d / max(max_d, 1), unrounded: thresholds apply to this, outputs round to 4."""
    return F.lit(1.0) - distance / F.greatest(max_distance, F.lit(1.0))


def query_echo(value: Column, detected: Column) -> Column:
    """Short queries verbatim, long ones as length and digest."""
    long_value = F.length(value) > 40
    return F.struct(
        F.when(~long_value, value).alias("value"),
        F.when(long_value, F.length(value)).alias("length"),
        F.when(long_value, F.sha2(value, 256)).alias("sha256"),
        detected.alias("detected_type"),
    )


def allele_locus(gene: Column) -> Column:
    """``HLA-A`` or ``hla-a`` to ``A``; other names upper-cased without the prefix."""
    return recode(F.lower(gene), {f"hla-{x.lower()}": x for x in HLA_LOCI},
                  F.replace(F.upper(gene), F.lit("HLA-"), F.lit("")))


def allele_project(gene: Column) -> Column:
    """Which allele collection a gene name belongs to: HLA (human) or MHC (other species)."""
    flat = F.replace(F.replace(F.lower(gene), F.lit("-"), F.lit("")), F.lit("_"), F.lit(""))
    other = flat.rlike("^(" + "|".join(MHC_PROJECT_PREFIXES) + ")")
    hla = F.upper(gene).startswith("HLA") | ((F.length(gene) <= 5) & gene.contains("*"))
    return F.when(other, F.lit("MHC")).when(hla, F.lit("HLA")).otherwise(F.lit("MHC"))


def allele_name_prefix(gene: Column) -> Column:
    name = strip(gene)
    return F.when(F.upper(name).startswith("HLA-"), F.substring(name, 5, 1 << 20)).otherwise(name)
