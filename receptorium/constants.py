"""Public biological constants and the vocabularies of the record formats."""

# --- fixed values: record index columns, in order -----------------------------------------
INDEX_COLUMNS = [
    "source", "source_record_id", "pairing_key", "species", "chain", "cdr3_aa", "cdr3_nt",
    "full_aa", "full_nt", "v_gene", "d_gene", "j_gene", "cdr1_aa", "cdr2_aa", "epitope_aa",
    "antigen", "antigen_organism", "mhc_class", "mhc_a", "mhc_b", "pdb_id", "reference_pmid",
    "external_url", "score",
]
DEDUP_KEY = ["source", "chain", "cdr3_aa", "v_gene", "j_gene", "epitope_aa", "mhc_a"]
LABELLED_COLUMNS = [
    "cdr3_b_aa", "v_b_gene", "j_b_gene", "epitope_aa", "mhc_class", "mhc_a", "antigen",
    "antigen_organism", "cluster_id",
]
LABELLED_REQUIRED = ["cdr3_b_aa", "v_b_gene", "j_b_gene", "epitope_aa"]
LABELLED_KEY = ["cdr3_b_aa", "v_b_gene", "j_b_gene", "epitope_aa", "mhc_a"]

# --- fixed values: vocabularies ------------------------------------------------------------
NA_CELLS = ["", "na", "nan", "-"]
WHITESPACE = " \t\n\r\x0b\x0c"
SPECIES_NAMES = {"homosapiens": "human", "musmusculus": "mouse"}
TAXON_SPECIES = {"9606": "human", "10090": "mouse"}
CHAIN_LABELS = {"TRA": "alpha", "TRB": "beta", "TRG": "gamma", "TRD": "delta"}
CHAINS = ["TRA", "TRB", "TRG", "TRD"]
SPECIES_WORDS = {
    "mouse": "mouse", "murine": "mouse", "souris": "mouse",
    "human": "human", "humain": "human", "homo": "human",
}
SIMILAR_WORDS = ["similar", "nearest", "neighbour", "neighbor", "close to"]
MHC_WORDS = [
    "mamu", "patr", "gogo", "popy", "bola", "dla", "sla", "rt1", "eqca", "ovar", "mane", "mafa",
    "caja", "aona", "macaque", "bovine", "canine", "swine", "rhesus", "chimpanzee", "gorilla",
    "ipd-mhc", "ipd mhc",
]
IEDB_WORDS = ["iedb", "immune epitope database", "tcell assay", "mhc ligand", "effector cell"]
VDJDB_WORDS = ["vdjdb", "cdr3", "epitope", "antigen", "specificity"]
TCR_WORDS = ["tcr", "t-cell receptor"]
REGION_WORDS = ["v-region", "d-region", "j-region", "c-region", "exon", "intron", "leader"]
MHC_PROJECT_PREFIXES = [
    "mamu", "patr", "gogo", "popy", "hymo", "aona", "caja", "saoe", "sasc", "mane", "mafa",
    "macy", "bola", "dla", "sla", "rt1", "eqca", "ovar",
]
HLA_LOCI = ["A", "B", "C", "DPA1", "DPB1", "DQA1", "DQB1", "DRA", "DRB1", "DRB3", "DRB4", "DRB5",
            "E", "F", "G"]
SOURCE_URL = {
    "vdjdb": "https://vdjdb.cdr3.net/search",
    "mcpas": "https://friedmanlab.weizmann.ac.il/McPAS-TCR/",
    "iedb": "https://www.iedb.org/receptor/",
    "tcr3d": "https://www.rcsb.org/structure/",
}

# --- fixed values: provenance source names shown in reports ---------------------------------
PROV_GERMLINE, PROV_KMER, PROV_RECONSTRUCTION, PROV_NEIGHBOURS, PROV_EPITOPES = (
    "cdr_enricher", "kmer_align", "reconstructor", "unitcr", "iedb")

# --- fixed values: genetic code ------------------------------------------------------------
# Amino acids of the standard code, codons enumerated with bases in the order TCAG.
BASE_ORDER = "TCAG"
AMINO_BY_CODON = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
BACK_CODON = {
    "A": "GCC", "R": "AGG", "N": "AAC", "D": "GAC", "C": "TGC", "E": "GAG", "Q": "CAG",
    "G": "GGC", "H": "CAC", "I": "ATC", "L": "CTG", "K": "AAG", "M": "ATG", "F": "TTC",
    "P": "CCC", "S": "AGC", "T": "ACC", "W": "TGG", "Y": "TAC", "V": "GTG", "*": "TGA",
}
STANDARD_AA = "ACDEFGHIKLMNPQRSTVWY"

# --- fixed values: BLOSUM62 (lower triangle, NCBI letter order) -----------------------------
BLOSUM_LETTERS = "ARNDCQEGHILKMFPSTWYVBZX*"
BLOSUM62 = """
 4
-1 5
-2 0 6
-2 -2 1 6
 0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
 0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
 1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
 0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
 0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
-2 -1 3 4 -3 0 1 -1 0 -3 -4 0 -3 -3 -2 0 -1 -4 -3 -3 4
-1 0 0 1 -3 3 4 -2 0 -3 -3 1 -1 -3 -1 0 -1 -3 -2 -2 1 4
 0 -1 -1 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2 0 0 -2 -1 -1 -1 -1 -1
-4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 1
"""
BLOSUM_UNKNOWN = -4

# --- fixed values: distance parameters ------------------------------------------------------
CDR3_TRIM_N, CDR3_TRIM_C, CDR3_GAP = 3, 2, 8
TCRDIST_CDR3_WEIGHT, TCRDIST_GAP, TCRDIST_MAX_COST = 3, 4, 4
MAX_NEIGHBOURS = 25
FAMILY_MIN = 5
TRAILING_SECONDS = 60
STALE_DAYS = 30
KMER = 7

# --- fixed values: germline positions -------------------------------------------------------
CDR1_SPAN, CDR2_SPAN = (27, 38), (56, 65)
V_REGION_SPANS = {"FR1": (0, 26), "CDR1": (26, 38), "FR2": (38, 55), "CDR2": (55, 65), "FR3": (65, 104)}
V_FRAMEWORK_MIN = 30

# --- fixed values: human beta D alleles -----------------------------------------------------
D_ALLELES = [
    ("human", "TRB", "TRBD1*01", "GGGACAGGGGGC"),
    ("human", "TRB", "TRBD2*01", "GGGACTAGCGGGGGGG"),
    ("human", "TRB", "TRBD2*02", "GGGACTAGCGGGAGGG"),
]

# --- fixed values: membrane-bound constant regions (UniProt) ---------------------------------
CONSTANT_REGIONS = [
    ("mouse", "beta",
     "EDLRNVTPPKVSLFEPSKAEIANKQKATLVCLARGFFPDHVELSWWVNGKEVHSGVSTDPQAYKESNYSYCLSSRLRVSATFWHNPRNHFRCQ"
     "VQFHGLSEEDKWPEGSPKPVTQNISAEAWGRADCGITSASYQQGVLSATILYEILLGKATLYAVLVSTLVVMAMVKRKNS",
     "UniProt P01852, mouse TRBC, membrane form"),
    ("mouse", "alpha",
     "IQNPEPAVYQLKDPRSQDSTLCLFTDFDSQINVPKTMESGTFITDKTVLDMKAMDSKSNGAIAWSNQTSFTCQDIFKETNATYPSSDVPCDAT"
     "LTEKSFETDMNLNFQNLSVMGLRILLLKVAGFNLLMTLRLWSS",
     "UniProt P01849, mouse TRAC, membrane form"),
    ("human", "beta",
     "EDLNKVFPPEVAVFEPSEAEISHTQKATLVCLATGFFPDHVELSWWVNGKEVHSGVSTDPQPLKEQPALNDSRYCLSSRLRVSATFWQNPRNH"
     "FRCQVQFYGLSENDEWTQDRAKPVTQIVSAEAWGRADCGFTSVSYQQGVLSATILYEILLGKATLYAVLVSALVLMAMVKRKDF",
     "UniProt P01850, human TRBC1, membrane form, with the first Glu that joins J to C"),
    ("human", "alpha",
     "IQNPDPAVYQLRDSKSSDKSVCLFTDFDSQTNVSQSKDSDVYITDKTVLDMRSMDFKSNSAVAWSNKSDFACANAFNNSIIPEDTFFPSPESS"
     "CDVKLVEKSFETDTNLNFQNLSVIGFRILLLKVAGFNLLMTLRLWSS",
     "UniProt P01848, human TRAC, membrane form"),
]
