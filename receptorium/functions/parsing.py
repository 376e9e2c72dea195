"""Column functions that classify and parse query text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from receptorium.constants import (
    IEDB_WORDS, MHC_WORDS, REGION_WORDS, SIMILAR_WORDS, SPECIES_WORDS, TCR_WORDS, VDJDB_WORDS,
)
from receptorium.functions.text import recode, strip

# --- fixed values: patterns -----------------------------------------------------------------
ID_PATTERN = r"(?i)^(vdjdb|iedb):\w+$"  # what classification takes for an id; lookups know all four prefixes below
ID_PREFIX_PATTERN = r"^(vdjdb|iedb|mcpas|tcr3d):"
GENE_PATTERN = r"(?i)^TR[ABGD][VDJC]\d+(-\d+)?(\*\d+)?$"
GENE_TOKEN_PATTERN = r"^TR[ABGD][VJ]."
CDR3_PATTERN = r"^C[ACDEFGHIKLMNPQRSTVWY]{7,21}$"
AMINO_TEXT_PATTERN = r"^[ACDEFGHIKLMNPQRSTVWYZX*]+$"
AMINO_ONLY_PATTERN = r"[EFILPQZX*]"
FREE_GENE_PATTERN = r"\b([A-Z]{2,6}[A-Z0-9-]*\*?[0-9:]*)\b"
DNA_WORD_PATTERN = r"\b([ACGT]{8,})\b"
PEPTIDE_PATTERN = r"\b([ACDEFGHIKLMNPQRSTVWY]{8,15})\b"

AMBIGUOUS_MESSAGE = "every letter is both a base and a residue; read as amino acids"
UNRESOLVED_MESSAGE = "no known form fits this query; give its input_type"


def classify(query: Column) -> Column:
    """struct(detected_type, normalized, source, code, message) of a query string."""
    q = strip(query)
    s = F.replace(F.replace(F.upper(q), F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    is_id, is_gene = q.rlike(ID_PATTERN), q.rlike(GENE_PATTERN)
    is_amino_text = s.rlike(AMINO_TEXT_PATTERN)
    amino_only = s.rlike(AMINO_ONLY_PATTERN)
    mostly_dna = F.length(F.regexp_replace(s, "[^ACGT]", "")) / F.length(s) >= 0.9
    kind = (
        F.when(is_id, F.lit("id"))
        .when(is_gene & q.contains("*"), F.lit("allele"))
        .when(is_gene, F.lit("gene_name"))
        .when(is_amino_text & amino_only, F.lit("raw_aa"))
        .when(is_amino_text & mostly_dna, F.lit("raw_nt"))
        .when(is_amino_text, F.lit("raw_aa"))
        .otherwise(F.lit("unknown"))
    )
    ambiguous = ~is_id & ~is_gene & is_amino_text & ~amino_only & ~mostly_dna
    unknown = ~is_id & ~is_gene & ~is_amino_text
    return F.struct(
        kind.alias("detected_type"),
        F.when(is_id | unknown, q).when(is_gene, F.upper(q)).otherwise(s).alias("normalized"),
        F.when(is_id, F.lower(F.split_part(q, F.lit(":"), F.lit(1)))).alias("source"),
        F.when(ambiguous, F.lit("ambiguous_alphabet")).when(unknown, F.lit("unresolved_input_type")).alias("code"),
        F.when(ambiguous, F.lit(AMBIGUOUS_MESSAGE)).when(unknown, F.lit(UNRESOLVED_MESSAGE)).alias("message"),
    )


def classify_as(query: Column, input_type: Column) -> Column:
    """``classify`` unless ``input_type`` forces the reading."""
    q = strip(query)
    auto = classify(query)
    forced = F.struct(
        input_type.alias("detected_type"),
        F.when(input_type.isin("raw_nt", "raw_aa"), F.upper(q)).otherwise(q).alias("normalized"),
        F.when((input_type == "id") & q.rlike(ID_PATTERN), F.lower(F.split_part(q, F.lit(":"), F.lit(1)))).alias("source"),
        F.lit(None).cast("string").alias("code"),
        F.lit(None).cast("string").alias("message"),
    )
    return F.when(F.coalesce(input_type, F.lit("auto")) == "auto", auto).otherwise(forced)


def is_gene_token(tok: Column) -> Column:
    return F.upper(tok).rlike(GENE_TOKEN_PATTERN)


def is_cdr3_token(tok: Column) -> Column:
    return F.upper(tok).rlike(CDR3_PATTERN) & ~is_gene_token(tok)


def _first(tokens: Column, test) -> Column:
    return F.get(F.filter(tokens, test), F.lit(0))


def parse_text(text: Column) -> Column:
    """struct(species, cdr3_aa, v_gene, j_gene, record_id) found in free text."""
    t = F.coalesce(text, F.lit(""))
    tokens = F.filter(F.split(strip(t), r"[\s,;]+"), lambda x: x != "")
    words = F.split(F.lower(t), "[^a-z]+")
    species = _first(words, lambda w: w.isin(*SPECIES_WORDS))
    return F.struct(
        recode(species, SPECIES_WORDS).alias("species"),
        _first(tokens, is_cdr3_token).alias("cdr3_aa"),
        _first(tokens, lambda x: F.upper(x).rlike("^TR[ABGD]V.")).alias("v_gene"),
        _first(tokens, lambda x: F.upper(x).rlike("^TR[ABGD]J.")).alias("j_gene"),
        _first(tokens, lambda x: F.lower(x).rlike(ID_PREFIX_PATTERN)).alias("record_id"),
    )


def _mentions(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def keyword_filters(query: Column) -> Column:
    """struct of search filters named in a sentence."""
    low, up = F.lower(query), F.upper(query)
    source = (
        F.when(low.contains("hla"), F.lit("hla"))
        .when(_mentions(low, MHC_WORDS), F.lit("mhc"))
        .when(_mentions(low, IEDB_WORDS), F.lit("iedb"))
        .when(_mentions(low, VDJDB_WORDS), F.lit("vdjdb"))
        .when(_mentions(low, TCR_WORDS), F.lit("tcr"))
    )
    species = (
        F.when(_mentions(low, ["human", "homo sapiens"]), F.lit("human"))
        .when(_mentions(low, ["mouse", "mus musculus"]), F.lit("mouse"))
    )
    region = F.coalesce(*[F.when(low.contains(r), F.lit(r)) for r in REGION_WORDS])
    gene = F.nullif(F.regexp_extract(query, FREE_GENE_PATTERN, 1), F.lit(""))
    dna = F.nullif(F.regexp_extract(up, DNA_WORD_PATTERN, 1), F.lit(""))
    peptide = F.nullif(F.regexp_extract(up, PEPTIDE_PATTERN, 1), F.lit(""))
    return F.struct(
        source.alias("source"), species.alias("species"), region.alias("region"),
        gene.alias("gene_name"), dna.alias("sequence_contains"),
        F.when(~peptide.eqNullSafe(dna), peptide).alias("antigen_epitope"),
    )


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def plan_intent(query: Column) -> Column:
    """struct(intent, query, v_gene, j_gene, cdr3_aa): what a sentence asks for."""
    def tag(t: Column) -> Column:
        return F.struct(t.alias("tok"), F.upper(t).alias("up"), F.length(t).alias("n"), _bound(classify(t), lambda c: F.struct(
            c["detected_type"].alias("kind"), c["code"].alias("code"))).alias("c"))

    def found(x: Column) -> Column:
        tok = lambda test: _first(x, test)["tok"]
        return F.struct(
            F.coalesce(tok(lambda t: (t["c"]["kind"] == "raw_aa") & (t["n"] >= 8) & (t["n"] <= 22)), F.lit("")).alias("cdr3"),
            F.coalesce(tok(lambda t: t["up"].rlike("^TR[ABGD]V.")), F.lit("")).alias("v"),
            F.coalesce(tok(lambda t: t["up"].rlike("^TR[ABGD]J.")), F.lit("")).alias("j"),
            tok(lambda t: (t["c"]["kind"] != "unknown") & t["c"]["code"].isNull()).alias("plain"),
            _mentions(F.lower(query), SIMILAR_WORDS).alias("similar"))

    def aim(x: Column) -> Column:
        intent = (F.when(x["similar"], F.lit("similar"))
                  .when((x["v"] != "") | (x["j"] != ""), F.lit("dossier"))
                  .when(x["cdr3"] != "", F.lit("similar"))
                  .when(x["plain"].isNotNull(), F.lit("dossier"))
                  .otherwise(F.lit("search")))
        return F.struct(intent.alias("intent"), x.alias("x"))

    def asked(y: Column) -> Column:
        x, intent = y["x"], y["intent"]
        has_gene = (x["v"] != "") | (x["j"] != "")
        named = (F.when((intent == "dossier") & has_gene,
                        F.when(x["cdr3"] != "", x["cdr3"]).when(x["v"] != "", x["v"]).otherwise(x["j"]))
                 .when(intent == "dossier", x["plain"])
                 .when(intent == "search", query))
        return F.struct(intent.alias("intent"), named.alias("query"), x["v"].alias("v_gene"), x["j"].alias("j_gene"), x["cdr3"].alias("cdr3_aa"))

    tokens = F.filter(F.split(strip(query), r"\s+"), lambda x: x != "")
    return _bound(F.transform(tokens, tag), lambda x: _bound(found(x), lambda f: _bound(aim(f), asked)))
