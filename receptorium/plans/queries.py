"""Named queries over the bridge views, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from receptorium.constants import DEDUP_KEY
from receptorium.functions import parsing, sequence, text
from receptorium.operators import (
    align, alleles, annotate, assign, baseline, dedup, dossier, epitopes, lookup, reconstruct, route, similar,
)
from receptorium.operators.pairwise import first_rows
from receptorium import session
from receptorium.plans import answer, bridge
from receptorium.sources import alleles as alleles_source, files, germline, records, uploads
from receptorium.streaming import limiter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def _c(name: str, alias: str | None = None):
    c = F.col(name)
    return c.alias(alias) if alias else c


# --- index build -------------------------------------------------------------------------------------

@query
def index_dedup(spark, sf):
    return dedup.dedup_index(bridge.view(spark, sf, "rec")).select(*DEDUP_KEY, "source_record_id")


@query
def source_counts(spark, sf):
    return dedup.source_counts(dedup.dedup_index(bridge.view(spark, sf, "rec")))


@query
def index_metadata(spark, sf):
    index, _ = answer.build_index([bridge.view(spark, sf, "rec")])
    meta = files.index_meta(index, "b1", built_at=F.lit("1998-01-01").cast("date"))
    return meta.select("rows_total", "built_at", "build_id", F.array_join(
        F.transform("per_source", lambda x: F.concat(x["source"], F.lit("="), x["n"].cast("string"))), ",").alias("per_source"))


@query
def index_union(spark, sf):
    """Two sources harmonized apart, united, de-duplicated and described."""
    rec = bridge.view(spark, sf, "rec")
    index, _ = answer.build_index([rec.filter("src_row % 3 = 0"), rec.filter("src_row % 3 <> 0")])
    return index.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("src_row").alias("first_row"))


@query
def latest_build(spark, sf):
    meta = bridge.table(spark, sf, "orders").select(
        F.concat(F.lit(""), (_c("o_orderkey") % 1000).cast("string")).alias("build_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("built_at"),
        F.when(_c("o_orderkey") % 4 == 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T0"), (_c("o_orderkey") % 7).cast("string"))).alias("announced"))
    return files.latest_build(meta)


@query
def index_age(spark, sf):
    meta = bridge.table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("built_at"))
    return lookup.index_warnings(meta, F.lit("1998-08-01").cast("date"), 365)


@query
def refresh_guard(spark, sf):
    status = bridge.table(spark, sf, "nation").select("n_regionkey", (F.col("n_nationkey") % 7 != 0).alias("ok"))
    return files.refresh_decision(status, True)


@query
def vdjdb_rows(spark, sf):
    raw = bridge.view(spark, sf, "slim").withColumnsRenamed({
        "complex_id": "complex.id", "v": "v.segm", "j": "j.segm", "epitope_aa": "antigen.epitope", "antigen": "antigen.gene", "mhc_a": "mhc.a",
        "reference": "reference.id", "score": "vdjdb.score"})
    return records.vdjdb_rows(raw).select("source", "source_record_id", "pairing_key", "species", "chain", "cdr3_aa", "v_gene", "j_gene", "epitope_aa", "antigen", "mhc_a",
                                          "reference_pmid", "external_url", "score", "src_row")


@query
def tcr3d_rows(spark, sf):
    whole = bridge.view(spark, sf, "complexes").withColumnsRenamed({
        "pdb_id": "PDB_ID", "organism": "TCR_organism", "a3": "CDR3_alpha", "b3": "CDR3_beta", "a1": "CDR1_alpha", "b1": "CDR1_beta", "b2": "CDR2_beta",
        "av": "TRAV_gene", "bv": "TRBV_gene", "pubmed": "Pubmed"})
    fills = bridge.view(spark, sf, "fills").withColumnsRenamed({"kind": "tcr_type", "c1": "cdr1_sequences", "c2": "cdr2_sequences"})
    return records.tcr3d_rows(whole, fills).select("source_record_id", "pairing_key", "species", "chain", "cdr3_aa", "v_gene", "cdr1_aa", "cdr2_aa", "reference_pmid",
                                                   "external_url", "src_row")


IEDB_COLUMNS = [("Receptor", "IEDB Receptor ID", "receptor"), ("Epitope", "Name", "epitope"), ("Epitope", "Source Molecule", "antigen"),
                ("Chain 1", "Curated V Gene", "v1"), ("Chain 1", "Calculated V Gene", "w1"), ("Chain 1", "CDR3 Curated", "c1"), ("Chain 1", "CDR3 Calculated", "d1"),
                ("Chain 2", "Curated V Gene", "v2"), ("Chain 2", "CDR3 Calculated", "c2"), ("Chain 1", "Organism IRI", "iri"), ("Chain 2", "Organism IRI", "iri")]


@query
def iedb_rows(spark, sf):
    """The table as a file with two header rows and quoted cells, read back."""
    root = session.shared_path(spark, "iedb")
    heads = [",".join(f'"{c[i]}"' for c in IEDB_COLUMNS) for i in (0, 1)]
    spark.createDataFrame([(h,) for h in heads], "value string").coalesce(1).write.text(f"{root}/0")
    quoted = F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) for _, _, c in IEDB_COLUMNS])
    bridge.view(spark, sf, "paired_cells").select(quoted.alias("value")).write.text(f"{root}/1")
    return records.read_iedb(spark, f"{root}/*").select("source", "source_record_id", "pairing_key", "species", "chain", "cdr3_aa", "v_gene", "epitope_aa", "antigen", "external_url")


@query
def germline_scan(spark, sf):
    """The entries as FASTA files by species and chain, with wrapped lines, read back."""
    root = session.shared_path(spark, "germline")
    kind = F.when(_c("segment") == "V", "V-REGION").when(_c("segment") == "J", "joining").otherwise("CONSTANT")
    text_ = F.concat(F.lit(">X|"), F.lower("allele"), F.lit("|f|"), kind, F.lit("\n"), F.lower(F.substring("nt", 1, 60)), F.lit("\n"), F.expr("substring(nt, 61)"))
    _entries(spark, sf).select(text_.alias("value"), "species", "chain").write.partitionBy("species", "chain").text(root)
    return germline.germline_entries(spark, root, "species=*/chain=*", r"species=([^/]+)/chain=([^/]+)/").select("species", "chain", "segment", "allele", "gene", "nt")


@query
def alphabets(spark, sf):
    seqs = bridge.view(spark, sf, "seqs").select("seq_id", F.when(_c("seq_id") % 3 == 0, F.lower("seq")).when(_c("seq_id") % 7 == 0, F.concat(F.lit(" "), "seq", F.lit("N"))).when(
        _c("seq_id") % 5 == 0, F.concat("seq", F.lit("E"))).when(_c("seq_id") % 11 == 0, F.lit("")).otherwise(_c("seq")).alias("s"), F.when(_c("seq_id") % 4 == 0, F.lit(" Alpha")).when(
        _c("seq_id") % 4 == 1, F.lit("trb")).when(_c("seq_id") % 4 == 2, F.lit("epsilon")).alias("word"))
    return seqs.select("seq_id", text.alphabet(_c("s")).alias("kind"), text.chain_synonym(_c("word")).alias("chain"))


@query
def allele_payloads(spark, sf):
    p = bridge.view(spark, sf, "payloads")
    kinds = [alleles_source.allele_records(p.filter("kind = 0")), alleles_source.allele_records(p.filter("kind = 1"), "HLA", True),
             alleles_source.allele_records(p.filter("kind = 2"), "MHC", True)]
    cells = [k.select("source", "species", "gene_name", "allele_name", "region", "sequence", *[F.col("metadata")[m].alias(m) for m in ("accession", "backend", "protein_seq")]) for k in kinds]
    return cells[0].unionByName(cells[1]).unionByName(cells[2])


@query
def wide_to_long(spark, sf):
    raw = bridge.view(spark, sf, "wide").withColumnsRenamed({
        "CDR3_alpha_aa": "CDR3.alpha.aa", "CDR3_beta_aa": "CDR3.beta.aa", "PubMed_ID": "PubMed.ID"})
    out = records.mcpas_rows(raw)
    return out.select("source_record_id", "pairing_key", "species", "chain", "cdr3_aa", "v_gene", "d_gene", "j_gene",
                      "antigen_organism", "mhc_a", "reference_pmid", "external_url", "src_row")


@query
def labelled_positives(spark, sf):
    return dedup.labelled_positives(bridge.view(spark, sf, "labelled")).drop("src_row")


@query
def label_counts(spark, sf):
    raw = bridge.view(spark, sf, "labelled")
    return dedup.label_counts(raw, dedup.labelled_positives(raw))


# --- fields --------------------------------------------------------------------------------------------

@query
def na_species_norm(spark, sf):
    return bridge.view(spark, sf, "cells").select("rid", text.clean(_c("cell")).alias("cell"), text.species_name(_c("species")).alias("species"))


@query
def taxon_species(spark, sf):
    return bridge.view(spark, sf, "cells").select("rid", text.taxon_species(_c("iri")).alias("species"))


@query
def gene_parts(spark, sf):
    g = _c("gene")
    return bridge.view(spark, sf, "cells").select(
        "rid", text.gene_symbol(g).alias("symbol"), text.gene_base(g).alias("base"), text.chain_code(g).alias("chain"),
        text.chain_label_strict(g).alias("strict_label"), text.alpha_beta_of_genes(g).alias("alpha_beta"),
        text.segment_letter(g).alias("segment"), text.v_family(g).alias("family"), text.germline_gene(g).alias("germline_gene"))


@query
def reference_ids(spark, sf):
    return bridge.view(spark, sf, "cells").select("rid", text.reference_id(_c("ref")).alias("ref"))


@query
def mhc_cross_species(spark, sf):
    return bridge.view(spark, sf, "rec").select("src_row", text.mhc_organism(_c("mhc_a")).alias("organism"),
                                                text.mhc_is_cross_species(_c("mhc_a"), _c("species")).alias("cross_species"))


@query
def score_rank_topk(spark, sf):
    rows = lookup.searchable(bridge.view(spark, sf, "rec"))
    return lookup.ranked_hits(rows, ["cdr3_aa"], 10).select("cdr3_aa", "rank", "source_record_id")


@query
def nonstandard_residues(spark, sf):
    letters = text.nonstandard_residues(F.concat("c_name", "c_mktsegment"))
    return bridge.table(spark, sf, "customer").select("c_custkey", F.array_join(letters, ",").alias("letters"))


@query
def query_echo(spark, sf):
    q = bridge.view(spark, sf, "sentences").withColumn("e", text.query_echo(_c("query"), parsing.classify(_c("query"))["detected_type"]))
    return q.select("qid", "e.value", _c("e.length").cast("long").alias("length"), "e.sha256", "e.detected_type")


@query
def allele_routing(spark, sf):
    gene = F.when(_c("p_partkey") % 4 == 0, F.concat(F.lit("HLA-"), F.lit("A"))).when(_c("p_partkey") % 4 == 1, F.concat(F.lit("Mamu-"), "p_brand")) \
        .when(_c("p_partkey") % 4 == 2, F.lit("B*07")).otherwise(_c("p_brand"))
    return bridge.table(spark, sf, "part").select("p_partkey", text.allele_locus(gene).alias("locus"), text.allele_project(gene).alias("project"),
                                                  text.allele_name_prefix(gene).alias("prefix"))


# --- lookup ----------------------------------------------------------------------------------------------

def _requests(spark, sf):
    kind = _c("qid") % 4
    return bridge.view(spark, sf, "ask").select(
        "qid", F.when(kind < 3, _c("cdr3")).alias("cdr3_aa"), F.when(kind >= 2, _c("v_gene")).alias("v_gene"),
        F.when(kind == 3, _c("j_gene")).alias("j_gene"), F.when(kind != 1, _c("species")).alias("species"))


@query
def exact_lookup(spark, sf):
    out = lookup.retrieve_records(_requests(spark, sf), bridge.view(spark, sf, "rec"), top_k=20, include_neighbours=False)
    return out["exact"].select("qid", "rank", "source_record_id", "score", "concordance").join(out["totals"], "qid")


@query
def text_lookup(spark, sf):
    """Requests that say all in one sentence; what the sentence names wins over the species given beside it."""
    q = bridge.view(spark, sf, "ask").select("qid", F.concat_ws(" ", "species", "cdr3", F.when(_c("qid") % 3 == 0, _c("v_gene"))).alias("query"),
                                             F.when(_c("qid") % 2 == 0, F.lit("mouse")).alias("species"))
    out = lookup.retrieve_records(q, bridge.view(spark, sf, "rec"), top_k=20, include_neighbours=False)
    return out["exact"].select("qid", "rank", "source_record_id").join(out["totals"], "qid")


@query
def id_lookup(spark, sf):
    asked = bridge.table(spark, sf, "orders").select(_c("o_orderkey", "qid"), F.concat(F.lit("r:"), _c("o_orderkey").cast("string"), F.lit(":1")).alias("id_lookup"))
    return lookup.id_hits(asked, bridge.view(spark, sf, "rec")).select("qid", "source_record_id", "cdr3_aa", "species")


@query
def concordance(spark, sf):
    return lookup.concordance(bridge.view(spark, sf, "rec"))


@query
def sources_searched(spark, sf):
    return dedup.sources_searched(bridge.view(spark, sf, "rec")).select(F.array_join("sources", ",").alias("sources"))


@query
def infer_vj(spark, sf):
    rec = bridge.view(spark, sf, "rec")
    asked = rec.select("cdr3_aa", "species").distinct().withColumn("qid", F.concat_ws("/", "cdr3_aa", "species"))
    return lookup.infer_genes(asked, rec)


@query
def paired_reference(spark, sf):
    return similar.paired_reference(bridge.view(spark, sf, "rec")).select(
        "species", "pairing_key", "cdr3_a_aa", "v_a_gene", "cdr3_b_aa", "v_b_gene", "epitope_aa", "antigen", "mhc_a")


def _pair_requests(spark, sf):
    pairs = similar.paired_reference(bridge.view(spark, sf, "rec"))
    one = pairs.groupBy("species", "v_a_gene", "v_b_gene").agg(F.min_by(F.struct("pairing_key", "cdr3_a_aa", "cdr3_b_aa"), "pairing_key").alias("p"))
    return one.select(_c("p.pairing_key", "qid"), _c("p.cdr3_a_aa", "cdr3_aa"), _c("p.cdr3_b_aa", "cdr3_aa_b"), "species")


@query
def pair_query(spark, sf):
    out = lookup.retrieve_records(_pair_requests(spark, sf), bridge.view(spark, sf, "rec"), top_k=500, include_neighbours=False)
    return out["pairs"].select("qid", "pairing_key", "source", "alpha_record_id", "beta_record_id")


@query
def no_pair_warning(spark, sf):
    q = bridge.view(spark, sf, "ask").select("qid", _c("cdr3", "cdr3_aa"), _c("cdr3_b", "cdr3_aa_b"), F.lit(None).cast("string").alias("species"))
    out = lookup.retrieve_records(q, bridge.view(spark, sf, "rec"), top_k=500, include_neighbours=False)
    appended = out["exact"].groupBy("qid").agg(F.count_if(_c("part") == "second_chain").alias("n_second"), F.count_if(_c("part") == "exact").alias("n_first"))
    return out["warnings"].select("qid", "code", "block").join(appended, "qid", "left").fillna(0, ["n_second", "n_first"])


@query
def warnings_log(spark, sf):
    q = bridge.table(spark, sf, "customer").select(_c("c_custkey", "qid"), F.concat("c_mktsegment", F.lit("ASS")).alias("cdr3_aa"), _c("c_name", "cdr3_aa_b"))
    return lookup.request_warnings(q)


# --- similarity --------------------------------------------------------------------------------------------

@query
def blosum_distance(spark, sf):
    p = similar.paired_reference(bridge.view(spark, sf, "rec"))
    pairs = p.select("cdr3_a_aa", "cdr3_b_aa").distinct()
    return pairs.withColumn("distance", similar.blosum_distance(_c("cdr3_a_aa"), _c("cdr3_b_aa")))


@query
def neighbours_top25(spark, sf):
    q = bridge.view(spark, sf, "ask").select("qid", _c("cdr3", "cdr3_aa"), F.when(_c("qid") % 2 == 0, _c("species")).alias("species"))
    out = lookup.retrieve_records(q, bridge.view(spark, sf, "rec"))["neighbours"]
    return out.select("qid", "rank", "source_record_id", "distance", "similarity")


@query
def similar_blosum(spark, sf):
    out = similar.find_similar(bridge.view(spark, sf, "ask"), bridge.view(spark, sf, "rec"), top_k=10, min_similarity=0.5)
    return out["neighbours"].select("qid", "rank", "engine", "cdr3_b_aa", "distance", "similarity", "src_row")


@query
def similar_refused(spark, sf):
    q = bridge.view(spark, sf, "ask").withColumns({"cdr3": F.when(_c("qid") % 3 != 0, _c("cdr3")), "v_gene": F.when(_c("qid") % 4 != 1, _c("v_gene"))})
    out = similar.find_similar(q, bridge.view(spark, sf, "rec"), top_k=1)
    return out["warnings"].filter("code = 'query_incomplete'").select("qid", "code", "message")


@query
def similar_labelled(spark, sf):
    labelled = dedup.labelled_positives(bridge.view(spark, sf, "labelled"))
    out = similar.find_similar(bridge.view(spark, sf, "ask"), labelled, top_k=5)
    return out["neighbours"].select("qid", "rank", "cdr3_b_aa", "distance", "similarity", "cluster_id", "src_row")


@query
def family_block_counts(spark, sf):
    q = bridge.view(spark, sf, "ask").select("qid", _c("species", "scope"), F.coalesce("chain", F.lit("*")).alias("chain"), "v_gene")
    return similar.family_block(q, bridge.view(spark, sf, "rec")).select("qid", "family", "total_candidates")


def _loops(spark, sf):
    return germline.loop_table(bridge.view(spark, sf, "loops").groupBy("organism", "id", "region").agg(F.min("cdrs").alias("cdrs")))


@query
def loop_table(spark, sf):
    return _loops(spark, sf)


@query
def tcrdist_single(spark, sf):
    out = similar.find_similar(bridge.view(spark, sf, "ask"), bridge.view(spark, sf, "rec"), _loops(spark, sf), top_k=10)
    return out["neighbours"].select("qid", "rank", "engine", "cdr3_b_aa", "distance", "similarity", "src_row")


@query
def tcrdist_pairs(spark, sf):
    q = bridge.view(spark, sf, "ask").withColumn("_n", F.floor(_c("qid") / 2))
    one = q.select("_n", *[_c(c).alias(f"{c}_1") for c in ("qid", "cdr3", "v_gene", "species")])
    two = q.select(_c("_n") - 1, *[_c(c).alias(f"{c}_2") for c in ("qid", "cdr3", "v_gene", "species")]).toDF("_n", "qid_2", "cdr3_2", "v_gene_2", "species_2")
    pairs = one.join(two, "_n").select("qid_1", "qid_2", "cdr3_1", _c("v_gene_1", "v_1"), "cdr3_2", _c("v_gene_2", "v_2"), _c("species_1", "species"))
    return similar.tcrdist(pairs, _loops(spark, sf)).select("qid_1", "qid_2", "distance")


@query
def tcrdist_skipped(spark, sf):
    out = similar.find_similar(bridge.view(spark, sf, "ask"), bridge.view(spark, sf, "rec"), _loops(spark, sf), top_k=10)
    return out["warnings"].select("qid", "code", F.nullif(F.regexp_extract("message", r"^(\d+)", 1), F.lit("")).alias("n_skipped"))


@query
def tcrdist_paired(spark, sf):
    q = bridge.view(spark, sf, "ask").select("qid", _c("cdr3_b", "cdr3_a"), "v_a", _c("cdr3", "cdr3_b"), _c("v_gene", "v_b"), "species")
    out = similar.find_similar_paired(q, bridge.view(spark, sf, "rec"), _loops(spark, sf), top_k=10)
    return out["neighbours"].select("qid", "rank", "pairing_key", "distance", "similarity")


# --- sequences and germline -----------------------------------------------------------------------------------

def _entries(spark, sf):
    return bridge.view(spark, sf, "germ")


def _catalog(spark, sf):
    return germline.allele_catalog(_entries(spark, sf))


@query
def translate(spark, sf):
    nt = _c("nt")
    return _entries(spark, sf).select("segment", "ord", *[sequence.translate(nt, f).alias(f"aa{f}") for f in range(3)])


@query
def back_translate(spark, sf):
    return bridge.view(spark, sf, "rec").select("cdr3_aa").distinct().select("cdr3_aa", sequence.back_translate(F.concat("cdr3_aa", F.lit("X*"))).alias("nt"))


@query
def best_frame(spark, sf):
    nt = _c("nt")
    return _entries(spark, sf).select("segment", "ord", sequence.best_frame(nt).cast("long").alias("frame"),
                                      sequence.best_frame(nt, True).cast("long").alias("frame_unknown"))


@query
def cys_cut(spark, sf):
    return _entries(spark, sf).filter("segment = 'V'").select("ord", sequence.cys_cut(_c("nt")).cast("long").alias("cut"))


@query
def j_motif(spark, sf):
    j = _entries(spark, sf).filter("segment = 'J'").select("ord", *sequence.frames(_c("nt")))
    a = j.withColumn("a", sequence.j_anchor([_c(f"aa{f}") for f in range(3)]))
    return a.select("ord", _c("a.frame").cast("long").alias("frame"), _c("a.fw").cast("long").alias("fw"))


@query
def allele_catalog(spark, sf):
    return _catalog(spark, sf).select("species", "chain", "segment", "allele", "gene", "nt", "aa")


@query
def gene_representative(spark, sf):
    return germline.representative_genes(_entries(spark, sf))


@query
def static_regions(spark, sf):
    asked = bridge.view(spark, sf, "rec").groupBy("species", "chain").agg(F.count(F.lit(1)).alias("n"))
    out = asked.join(germline.constant_regions(spark), ["species", "chain"], "left")
    d = germline.d_alleles(spark).groupBy("species").agg(F.count(F.lit(1)).alias("n_d"))
    return out.join(d, "species", "left").select("species", "chain", "n", F.length("constant_aa").cast("long").alias("len"), "constant_source", F.coalesce("n_d", F.lit(0)).alias("n_d"))


@query
def germline_resolve(spark, sf):
    genes = bridge.view(spark, sf, "rec").select("v_gene", "species").distinct().filter("v_gene is not null")
    out = reconstruct.resolve_alleles(genes, _catalog(spark, sf), "V", _c("v_gene"), text.chain_code(_c("v_gene")), _c("species"), ["nt"], "g_")
    return out.select("v_gene", "species", "g_allele_used", "g_nt")


@query
def predict_cdr(spark, sf):
    genes = bridge.view(spark, sf, "rec").select("v_gene", "species").distinct().filter("v_gene is not null")
    return reconstruct.predict_cdr(genes, _catalog(spark, sf)).select("v_gene", "species", "allele", "cdr1_aa", "cdr2_aa", "cdr1_nt", "cdr2_nt")


@query
def reconstruct_chain(spark, sf):
    rec = bridge.view(spark, sf, "rec").select("src_row", "v_gene", "j_gene", "cdr3_aa", "species")
    out = reconstruct.reconstruct(rec, _catalog(spark, sf), germline.constant_regions(spark))
    return out.select("src_row", "v_gene", "j_gene", "v_allele_used", "j_allele_used", "cdr3_nt", "full_nt", "full_aa",
                      F.length("full_chain_aa").cast("long").alias("chain_len"), "v_found", "j_found")


@query
def reconstruct_inferred(spark, sf):
    kind = _c("qid") % 3
    q = bridge.view(spark, sf, "ask").select("qid", _c("cdr3", "cdr3_aa"), F.when(kind == 1, _c("v_gene")).alias("v_gene"),
                                             F.when(kind == 2, _c("j_gene")).alias("j_gene"), "species")
    out = reconstruct.reconstruct_inferred(q, bridge.view(spark, sf, "rec"), _catalog(spark, sf), germline.constant_regions(spark))
    return out.select("qid", "v_gene", "j_gene", "genes_inferred", "inference_support", F.array_join("inference_alternatives", ";").alias("alternatives"),
                      "cdr3_nt", "v_found", "j_found", "full_nt")


@query
def enrich_records(spark, sf):
    out = reconstruct.enrich_records(bridge.view(spark, sf, "rec").withColumns({
        "full_nt": F.lit(None).cast("string"), "full_aa": F.when(_c("src_row") % 5 == 0, F.lit("MKV"))}),
        _catalog(spark, sf), germline.constant_regions(spark))
    return out.select("src_row", "cdr3_nt", "cdr3_nt_kind", "full_aa", "full_aa_kind", "full_nt", "full_nt_kind", "nt_is_synthetic",
                      _c("composition.v_germline_aa").alias("v_germline_aa"), _c("composition.j_region_nt").alias("j_region_nt"))


@query
def kmer_annotate(spark, sf):
    seqs = bridge.view(spark, sf, "seqs").withColumn("seq", F.when(_c("is_protein"), sequence.translate(_c("seq"))).otherwise(_c("seq")))
    out = annotate.annotate_kmer(seqs, germline.representative_genes(_entries(spark, sf)))
    return out.select("seq_id", "v_call", "v_score", "j_call", "j_score", "chain", "confidence", F.array_join("warnings", ",").alias("warnings"))


@query
def assign_alleles(spark, sf):
    seqs = bridge.view(spark, sf, "receptors").withColumns({"species": F.when(_c("seq_id") % 2 == 0, F.initcap("species")).otherwise(_c("species")), "chain": F.lit(None).cast("string"),
                                                            "want_d": _c("seq_id") % 3 == 0})
    catalog = _catalog(spark, sf).unionByName(germline.d_alleles(spark))
    out = assign.assign_alleles(seqs, catalog, bridge.view(spark, sf, "rec"), germline.constant_regions(spark))
    shares = F.array_join(F.transform(F.array_sort(F.map_entries("regions")), lambda r: F.concat_ws("=", r["key"], F.round(r["value"], 6).cast("string"))), ";")
    calls = [c for tag in ("v", "j", "d", "constant") for c in (
        F.array_join(f"{tag}_call.alleles", ",").alias(f"{tag}_alleles"), F.round(f"{tag}_call.identity", 6).alias(f"{tag}_identity"), F.array_join(f"{tag}_call.aligned_span", "-").alias(f"{tag}_span"))]
    return out.select("seq_id", "input_kind", "chain", *calls, shares.alias("regions"), "cdr3_aa", "v_determinable", F.array_join("warnings", ";").alias("warnings"))


# --- parsing and routing -----------------------------------------------------------------------------------------

@query
def route_type(spark, sf):
    s = bridge.view(spark, sf, "sentences")
    words = s.select("qid", F.posexplode(F.split("query", " ")).alias("n", "word")).withColumn("c", parsing.classify(_c("word")))
    whole = s.select("qid", F.lit(-1).alias("n"), _c("query", "word")).withColumn("c", parsing.classify(_c("word")))
    return words.unionByName(whole).select("qid", _c("n").cast("long").alias("n"), "c.detected_type", "c.normalized", _c("c.source", "id_source"), _c("c.code", "code"))


@query
def parse_text(spark, sf):
    return bridge.view(spark, sf, "sentences").withColumn("p", parsing.parse_text(_c("query"))).select(
        "qid", "p.species", "p.cdr3_aa", "p.v_gene", "p.j_gene", "p.record_id")


@query
def keyword_filters(spark, sf):
    return bridge.view(spark, sf, "sentences").withColumn("f", parsing.keyword_filters(_c("query"))).select("qid", "f.*")


@query
def plan_intent(spark, sf):
    return answer.plan_queries(bridge.view(spark, sf, "sentences")).drop("species", "text")


@query
def route_tools(spark, sf):
    s = bridge.view(spark, sf, "sentences").withColumn("force", F.when(_c("qid") % 10 == 0, F.lit("similar")))
    return route.route_queries(s).select("qid", "detected_type", "species", "note", _c("step").cast("long").alias("step"), "tool", "warning")


@query
def allele_search(spark, sf):
    filters = bridge.table(spark, sf, "supplier").select(
        _c("s_suppkey", "qid"), F.concat(F.lit("BRAND#"), (_c("s_suppkey") % 5).cast("string")).alias("gene_name"),
        F.when(_c("s_suppkey") % 3 == 0, F.lit("steel")).alias("region"), F.when(_c("s_suppkey") % 4 == 0, F.lit("Human")).alias("species"),
        F.when(_c("s_suppkey") % 2 == 0, F.lit("acg")).alias("sequence_contains"))
    rows = bridge.view(spark, sf, "uploads")
    found, seeds = rows.filter(_c("ord") % 2 == 0), rows
    return alleles.search_alleles(filters, found, seeds, limit=20, offset=5).select("qid", _c("rank").cast("long").alias("rank"), "allele_name", "ord")


@query
def dna_extract(spark, sf):
    return uploads.dna_runs(bridge.view(spark, sf, "texts"), "value", "doc_id").select("doc_id", _c("n").cast("long").alias("n"), "gene_name", "sequence")


@query
def fasta_headers(spark, sf):
    header = F.concat_ws("|", "allele_name", F.when(_c("ord") % 3 == 0, F.lit("")).otherwise(_c("gene_name")), "region", F.coalesce("species", F.lit("Mus musculus")))
    entries = bridge.view(spark, sf, "uploads").select(header.alias("header"), _c("sequence", "seq"))
    return uploads.fasta_records(entries, "upload").select("species", "gene_name", "allele_name", "region", "sequence", _c("metadata")["record_id"].alias("record_id"))


@query
def upload_rows(spark, sf):
    rows = bridge.view(spark, sf, "uploads").select(_c("gene_name", "gene"), F.when(_c("ord") % 2 == 0, _c("allele_name")).alias("allele"), "region", "species",
                                                    F.when(_c("ord") % 3 != 0, _c("sequence")).alias("sequence"), F.when(_c("ord") % 3 == 1, F.lit("cass")).alias("cdr3"))
    return uploads.table_records(rows, "upload").select("source", "species", "gene_name", "allele_name", "region", "sequence")


@query
def export_rows(spark, sf):
    rows = bridge.view(spark, sf, "rec").select(_c("cdr3_aa", "cdr3"), _c("v_gene", "v_segm"), F.when(_c("species") == "human", "Homo Sapiens").otherwise("Rattus").alias("species"),
                                                "mhc_a", _c("epitope_aa", "antigen_epitope"))
    return uploads.export_records(rows).groupBy("species", "gene_name", "allele_name", "region", "sequence", "antigen_epitope").agg(F.count(F.lit(1)).alias("n"))


@query
def upload_dispatch(spark, sf):
    """How an upload of each name is read, whatever the case of its extension."""
    ending = F.element_at(F.array(*[F.lit(e) for e in ("FASTA", "Fa", "CSV", "csv", "TsV", "txtv", "JSON", "TXT", "")]), (_c("p_partkey") % 9 + 1).cast("int"))
    named = bridge.table(spark, sf, "part").select("p_partkey", F.concat(_c("p_brand"), F.lit(".v1."), ending).alias("file"))
    return named.select("p_partkey", uploads.extension_kind(_c("file")).alias("kind"))


@query
def json_rows(spark, sf):
    up = bridge.view(spark, sf, "uploads")
    row = F.struct("gene_name", "species", F.when(_c("ord") % 3 != 0, _c("sequence")).alias("sequence"), _c("region", "note"))
    value = F.when(_c("ord") % 2 == 0, F.to_json(row)).otherwise(F.concat(F.lit("["), F.to_json(row), F.lit("]")))
    out = uploads.json_records(up.select(value.alias("value")), "upload")
    return out.select("species", "gene_name", "sequence", F.try_element_at("metadata", F.lit("note")).alias("note"))


@query
def cdr3_fasta_rows(spark, sf):
    rec = bridge.view(spark, sf, "rec").select(F.concat("source_record_id", F.lit(" from "), "source").alias("header"),
                                               F.when(_c("src_row") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.lower("cdr3_aa"))).alias("seq"))
    return uploads.cdr3_fasta(rec)


@query
def fasta_sink(spark, sf):
    return bridge.view(spark, sf, "rec").select("src_row", files.fasta_record(_c("source_record_id"), _c("cdr3_aa")))


# --- profiles, alignment statistics, epitopes ------------------------------------------------------------------------

def _usage(spark, sf, segment):
    out = baseline.gene_usage(bridge.view(spark, sf, "rec"), segment)
    return out.select("species", "chain", "gene", F.round("freq", 6).alias("freq"), F.round("std", 5).alias("std"))


@query
def usage_v(spark, sf):
    return _usage(spark, sf, "v")


@query
def usage_j(spark, sf):
    return _usage(spark, sf, "j")


@query
def cdr3_length_dist(spark, sf):
    return baseline.cdr3_lengths(bridge.view(spark, sf, "rec")).withColumn("share", F.round("share", 6)).withColumn("len", _c("len").cast("long"))


@query
def aa_position_freq(spark, sf):
    out = baseline.position_letters(bridge.view(spark, sf, "rec"))
    return out.select("species", "chain", "v", "j", _c("len").cast("long").alias("len"), _c("pos").cast("long").alias("pos"), "aa", "n", F.round("share", 6).alias("share"))


def _aligned(spark, sf):
    """Equally long rows per V gene; G and P stand for gaps, so columns hold gaps too."""
    rec = bridge.view(spark, sf, "rec").filter("v_gene is not null")
    return rec.select(F.concat_ws("|", "v_gene", F.length("cdr3_aa").cast("string")).alias("set_id"), _c("source_record_id", "name"), _c("src_row", "ord"),
                      F.translate("cdr3_aa", "P", "-").alias("aligned"))


@query
def alignment_consensus(spark, sf):
    return align.consensus(_aligned(spark, sf)).select("set_id", "consensus", F.array_join(F.transform("conservation", lambda x: F.format_number(x, 3)), ",").alias("conservation"))


@query
def mean_identity(spark, sf):
    return align.mean_identity(_aligned(spark, sf))


@query
def codon_thread(spark, sf):
    rec = bridge.view(spark, sf, "rec").select("cdr3_aa").distinct()
    gapped = F.replace("cdr3_aa", F.lit("G"), F.lit("-G-"))
    return rec.select("cdr3_aa", sequence.thread_codons(gapped, sequence.back_translate(_c("cdr3_aa"))).alias("threaded"))


@query
def align_germline_sets(spark, sf):
    genes = germline.representative_genes(_entries(spark, sf))
    asked = genes.select("species", "chain", "segment").distinct().select(
        F.concat_ws("/", "species", "chain", "segment").alias("set_id"), "species", "chain", "segment", F.array().cast("array<string>").alias("genes"), F.lit(False).alias("translate"))
    members, _ = align.resolve_sets(asked, genes)
    return align.align_set(members, "nt")


@query
def align_codon_sets(spark, sf):
    genes = germline.representative_genes(_entries(spark, sf))
    asked = genes.select("species", "chain").distinct().select(
        F.concat_ws("/", "species", "chain").alias("set_id"), "species", "chain", F.lit("J").alias("segment"), F.array().cast("array<string>").alias("genes"), F.lit(False).alias("translate"))
    members, _ = align.resolve_sets(asked, genes)
    return align.align_codon(members)


@query
def resolve_align_sets(spark, sf):
    asked = bridge.view(spark, sf, "ask").select(
        _c("qid").cast("string").alias("set_id"), "species", F.lit("TRB").alias("chain"), F.when(_c("qid") % 3 == 0, F.lit("D")).otherwise(F.lit("J")).alias("segment"),
        F.when(_c("qid") % 2 == 0, F.array("v_gene", "j_gene", F.lit("TRBV99"))).otherwise(F.array().cast("array<string>")).alias("genes"), (_c("qid") % 5 == 0).alias("translate"))
    members, warnings = align.resolve_sets(asked, germline.representative_genes(_entries(spark, sf)))
    return members.select("set_id", "name", "seq", F.lit(None).cast("string").alias("code")).unionByName(
        warnings.select(_c("qid", "set_id"), _c("message", "name"), F.lit(None).cast("string").alias("seq"), "code"))


@query
def known_epitopes(spark, sf):
    q = bridge.view(spark, sf, "ask").select("qid", _c("v_gene", "gene"), "species")
    return epitopes.known_epitopes(q, bridge.view(spark, sf, "rec")).withColumn("epitopes", F.array_join("epitopes", ","))


@query
def trailing_count(spark, sf):
    return limiter.trailing_count(bridge.view(spark, sf, "requests")).select("event_id", "key", "n_trailing")


@query
def rate_limit(spark, sf):
    return limiter.limit_batch(bridge.view(spark, sf, "requests"), 3).select("event_id", "accepted")


@query
def dossiers(spark, sf):
    q = bridge.view(spark, sf, "ask").select(
        "qid", F.when(_c("qid") % 3 == 0, _c("v_gene")).otherwise(_c("cdr3")).alias("query"), "species",
        F.when(_c("qid") % 3 == 1, _c("v_gene")).alias("v_gene"), F.when(_c("qid") % 3 == 1, _c("j_gene")).alias("j_gene"))
    out = dossier.build_dossiers(q, _catalog(spark, sf), bridge.view(spark, sf, "rec"), germline.constant_regions(spark))
    return out.select("qid", "status", "summary", "chain", _c("v.call").alias("v_call"), _c("v.allele").alias("v_allele"), _c("junction.cdr3_nt").alias("cdr3_nt"),
                      F.length("full_sequence.aa").cast("long").alias("full_len"), _c("known_epitopes_total"), F.size("records").cast("long").alias("n_records"),
                      F.array_join(F.transform("provenance", lambda p: p["block"]), ",").alias("provenance"),
                      F.array_join(F.transform("warnings", lambda w: w["code"]), ",").alias("warnings"))
