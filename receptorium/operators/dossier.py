"""Per-receptor reports: routing, genes, regions, junction, sequence, epitopes, neighbours, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from receptorium.constants import PROV_EPITOPES, PROV_GERMLINE, PROV_KMER, PROV_NEIGHBOURS, PROV_RECONSTRUCTION
from receptorium.functions import parsing, sequence, text
from receptorium.operators import annotate, lookup
from receptorium.operators.epitopes import known_epitopes
from receptorium.operators.reconstruct import reconstruct, resolve_alleles
from receptorium.operators.similar import find_similar
from receptorium.session import cut_lineage
from receptorium.sources.germline import representative_genes

FIELDS = ["query", "input_type", "species", "mode", "v_gene", "j_gene", "cdr3_aa"]
MAX_RECORDS = 20


def _given(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def _warn(code: str, block: str | None, message: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(block).cast("string").alias("block"), message.alias("message"))


def _prov(block: str, source: str | Column, confidence: str | Column, kind: str) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(block).alias("block"), lit(source).alias("source"), lit(confidence).alias("confidence"), F.lit(kind).alias("kind"))


def build_dossiers(queries: DataFrame, catalog: DataFrame, index: DataFrame, constants: DataFrame,
                   loops: DataFrame | None = None) -> DataFrame:
    """One report per query (qid, query, input_type, species, mode, include, v_gene, j_gene, cdr3_aa).

    Paths: V, J and CDR3 given -> reconstruction; gene or allele -> germline; raw sequence -> k-mer
    annotation; id -> the record of that id; anything else is unresolved. A report is complete only with a V call and no warning.
    """
    q = lookup.with_fields(queries, FIELDS)
    if "include" not in q.columns:
        q = q.withColumn("include", F.array().cast("array<string>"))
    q = q.withColumns({"species": F.coalesce("species", F.lit("human")), "mode": F.coalesce("mode", F.lit("fast")),
                       "v_gene": _given("v_gene"), "j_gene": _given("j_gene"), "cdr3_aa": _given("cdr3_aa"),
                       "include": F.coalesce("include", F.array().cast("array<string>")),
                       "r": parsing.classify_as(F.col("query"), F.col("input_type"))})
    kind, norm = F.col("r.detected_type"), F.col("r.normalized")
    cdr3_in = F.coalesce("cdr3_aa", F.when(kind == "raw_aa", norm))
    full = F.col("v_gene").isNotNull() & F.col("j_gene").isNotNull() & cdr3_in.isNotNull()
    q = q.withColumns({"kind": kind, "norm": norm, "cdr3_in": cdr3_in, "path": (
        F.when(full, "reconstruction").when(kind.isin("gene_name", "allele"), "germline")
        .when(kind.isin("raw_nt", "raw_aa"), "annotation").when(kind == "id", "id").otherwise("unresolved"))})
    q = q.withColumn("germ_gene", F.coalesce(F.when(F.col("path") == "germline", norm), F.col("v_gene")))
    q = cut_lineage(q)

    # germline block of a named gene
    values = catalog.filter("segment = 'V'").withColumn("_l", sequence.cdr_loops(F.col("nt"))).select(
        "species", "chain", "segment", "allele", "gene", "nt", sequence.null_if_empty(sequence.drop_stops(sequence.translate(F.col("nt")))).alias("aa0"), "_l.*")
    q = resolve_alleles(q, values, "V", F.col("germ_gene"), text.chain_code(F.col("germ_gene")), F.col("species"),
                        ["nt", "aa0", "cdr1_aa", "cdr2_aa", "cdr1_nt", "cdr2_nt"], "g_")
    other_segment = text.segment_letter(F.col("germ_gene")).isin("D", "J", "C")
    named = F.col("germ_gene").isNotNull()
    resolved = named & ~F.coalesce(other_segment, F.lit(False)) & F.col("g_allele_used").isNotNull()

    # k-mer block of a raw sequence
    genes = representative_genes(catalog)
    raw = q.filter("path = 'annotation'").select(F.col("qid").alias("seq_id"), F.col("norm").alias("seq"), "species", (F.col("kind") == "raw_aa").alias("is_protein"))
    k = annotate.annotate_kmer(raw, genes).select(F.col("seq_id").alias("qid"), F.struct(
        "v_call", "v_score", "j_call", "j_score", "chain", "confidence", "warnings").alias("k"))
    q = q.join(k, "qid", "left")
    ids = lookup.id_hits(q.filter("path = 'id'").select("qid", F.col("norm").alias("id_lookup")), index)
    ids = ids.groupBy("qid").agg(F.min_by(F.struct("v_gene", "j_gene", "cdr3_aa", "chain"), "src_row").alias("hit"))
    q = q.join(ids, "qid", "left")

    base = lambda c: F.split_part(c, F.lit("*"), F.lit(1))
    null = F.lit(None).cast("string")
    v_call = (F.when(F.col("k.v_call").isNotNull(), F.col("k.v_call")).when(resolved, base(F.col("germ_gene")))
              .when(F.col("path") == "reconstruction", base(F.col("v_gene"))).when(F.col("hit").isNotNull(), F.col("hit.v_gene")))
    j_call = (F.when(F.col("path") == "reconstruction", base(F.col("j_gene"))).when(F.col("k.j_call").isNotNull(), F.col("k.j_call"))
              .when(F.col("hit").isNotNull(), F.col("hit.j_gene")))
    use_germ = resolved & F.col("k.v_call").isNull()
    tried_germ = named & F.col("k.v_call").isNull()
    gene_chain = F.when(tried_germ, text.chain_label(text.chain_code(F.col("germ_gene"))))
    chain = F.coalesce(gene_chain, F.when(F.col("k.chain") != "unknown", F.col("k.chain")), F.col("hit.chain"),
                       text.chain_label(text.chain_code(F.col("j_gene"))), F.lit("unknown"))
    junction_aa = F.when(F.col("path") == "reconstruction", F.col("cdr3_in")) \
        .when((F.col("path") == "annotation") & (F.col("kind") == "raw_aa"), F.col("norm")).when(F.col("path") == "id", F.col("hit.cdr3_aa"))
    want_seq, want_germ = F.array_contains("include", "sequences"), F.array_contains("include", "germline")
    synthetic = junction_aa.isNotNull() & v_call.isNotNull() & j_call.isNotNull() & (F.col("path") != "id")
    q = q.withColumns({"v_call": v_call, "j_call": j_call, "chain": chain, "use_germ": F.coalesce(use_germ, F.lit(False)),
                       "tried_germ": tried_germ, "junction_aa": junction_aa, "synthetic": synthetic,
                       "other_segment": F.coalesce(other_segment, F.lit(False))})
    q = cut_lineage(q.drop("r"))

    built = reconstruct(q.filter("path = 'reconstruction'").select("qid", "v_gene", "j_gene", F.col("cdr3_in").alias("cdr3_aa"), "species"),
                        catalog, constants).select("qid", "full_nt", "full_aa")
    q = q.join(built, "qid", "left")
    hits = known_epitopes(q.filter("v_call is not null").select("qid", F.col("v_call").alias("gene"), "species"), index)
    q = cut_lineage(q.join(hits, "qid", "left"))  # read below and by the report

    near_in = q.select("qid", F.coalesce("cdr3_aa", "junction_aa", F.when(F.col("kind") == "raw_aa", F.col("norm"))).alias("cdr3"),
                       F.coalesce("v_gene", "v_call").alias("v_gene"), F.coalesce("j_gene", "j_call").alias("j_gene"), "species",
                       (F.array_contains("include", "neighbours") | (F.col("mode") == "full")).alias("wanted"),
                       (F.col("cdr3_in").isNotNull() | F.col("v_call").isNotNull() | F.col("j_call").isNotNull()).alias("has_records"))
    near = find_similar(near_in.filter("wanted and cdr3 is not null and v_gene is not null and j_gene is not null")
                        .select("qid", "cdr3", "v_gene", "j_gene", "species"), index, loops)
    context = [c for c in ("cdr3_b_aa", "v_b_gene", "j_b_gene", "distance", "similarity", "epitope_aa") if c in near["neighbours"].columns]
    found = near["neighbours"].groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", *context))).alias("neighbours"))
    near_warn = near["warnings"].groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("code", "block", "message"))).alias("near_warnings"))
    records = lookup.retrieve_records(near_in.filter("has_records").select(
        "qid", F.col("cdr3").alias("cdr3_aa"), "v_gene", "j_gene", "species"), index, MAX_RECORDS, include_neighbours=False)["exact"]
    records = records.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "source_record_id", "concordance"))),
                                                     lambda x: x["source_record_id"]).alias("records"))
    q = q.join(found, "qid", "left").join(near_warn, "qid", "left").join(records, "qid", "left")

    none_warn = F.array().cast("array<struct<code:string,block:string,message:string>>")
    echo = parsing.classify(F.col("query"))
    warnings = F.concat(
        F.array_compact(F.array(
            F.when(F.coalesce("input_type", F.lit("auto")) == "auto", F.when(echo["code"].isNotNull(), F.struct(
                echo["code"].alias("code"), null.alias("block"), echo["message"].alias("message")))),
            F.when(F.col("tried_germ") & F.col("other_segment"), _warn("partial_annotation", "genes", F.concat(
                F.lit("germline regions exist for V genes only; none for "), "germ_gene"))),
            F.when(F.col("tried_germ") & ~F.col("other_segment") & ~F.col("use_germ"), _warn(
                "ambiguous_gene", "genes", F.concat(F.lit("the germline tables have no V gene "), "germ_gene"))),
            F.when((F.col("path") == "id") & F.col("hit").isNull(), _warn("source_unavailable", "annotation", F.concat(
                F.lit("no record has the id "), "norm"))),
            F.when(F.col("path") == "unresolved", _warn("unresolved_input_type", None, F.lit("no form of the query fits, so nothing was looked up"))))),
        F.transform(F.coalesce("k.warnings", F.array().cast("array<string>")), lambda c: F.struct(
            c.alias("code"), F.lit("annotation").alias("block"), text.recode(c, annotate.WARNING_TEXT).alias("message"))),
        F.coalesce("near_warnings", none_warn))
    provenance = F.array_compact(F.array(
        F.when(F.col("use_germ") & (F.col("g_cdr1_aa").isNotNull() | F.col("g_cdr2_aa").isNotNull()), _prov("regions", PROV_GERMLINE, "high", "germline_lookup")),
        F.when(F.col("use_germ"), _prov("germline", PROV_GERMLINE, "high", "germline_lookup")),
        F.when(F.col("k.v_call").isNotNull() | F.col("k.j_call").isNotNull(), _prov("annotation", PROV_KMER, F.col("k.confidence"), "observed")),
        F.when(F.col("hit").isNotNull(), _prov("annotation", F.split_part("norm", F.lit(":"), F.lit(1)), "high", "observed")),
        F.when(F.col("synthetic"), _prov("junction", PROV_RECONSTRUCTION, "medium", "back_translated")),
        F.when(F.col("full_aa").isNotNull(), _prov("full_sequence", PROV_RECONSTRUCTION, "medium", "back_translated")),
        F.when(F.col("total") > 0, _prov("known_epitopes", PROV_EPITOPES, "high", "observed")),
        F.when(F.col("neighbours").isNotNull(), _prov("neighbours", PROV_NEIGHBOURS, "low", "neighbor_inferred"))))
    region = lambda aa, nt: F.when(F.col("use_germ") & F.col(aa).isNotNull(), F.struct(F.col(aa).alias("aa"), F.when(want_seq, F.col(nt)).alias("nt")))
    q = q.withColumns({"warnings": warnings, "provenance": provenance})
    status = F.when(F.col("v_call").isNotNull() & (F.size("warnings") == 0), "complete").otherwise("partial")
    summary = F.format_string("%s TCR, V=%s, J=%s, %d known epitope(s)", F.col("chain"), F.coalesce("v_call", F.lit("NA")),
                              F.coalesce("j_call", F.lit("NA")), F.coalesce(F.size("epitopes"), F.lit(0)))
    return q.select(
        "qid", status.alias("status"), summary.alias("summary"), text.query_echo(F.col("query"), F.col("kind")).alias("query_echo"), "chain", "species",
        F.struct(F.col("v_call").alias("call"), F.when(F.col("use_germ"), F.col("g_allele_used")).alias("allele"), F.col("k.v_score").alias("score"),
                 F.when(F.col("use_germ"), F.col("g_aa0")).alias("germline_aa"),
                 F.when(F.col("use_germ") & want_germ, F.col("g_nt")).alias("germline_nt")).alias("v"),
        F.struct(F.col("j_call").alias("call"), F.col("k.j_score").alias("score")).alias("j"),
        region("g_cdr1_aa", "g_cdr1_nt").alias("cdr1"), region("g_cdr2_aa", "g_cdr2_nt").alias("cdr2"),
        F.when(F.col("junction_aa").isNotNull(), F.struct(
            F.col("junction_aa").alias("cdr3_aa"), F.when(F.col("synthetic"), sequence.back_translate(F.col("junction_aa"))).alias("cdr3_nt"),
            F.col("synthetic").alias("cdr3_nt_is_synthetic"))).alias("junction"),
        F.when(F.col("full_aa").isNotNull(), F.struct(F.col("full_aa").alias("aa"), F.when(want_seq, F.col("full_nt")).alias("nt"))).alias("full_sequence"),
        F.coalesce("epitopes", F.array().cast("array<string>")).alias("known_epitopes"), F.coalesce("total", F.lit(0)).alias("known_epitopes_total"),
        "neighbours", F.coalesce("records", F.array().cast("array<string>")).alias("records"), "provenance", "warnings")
