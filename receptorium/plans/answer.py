"""Sentences answered by report, similarity, or allele search, and the index build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from receptorium.functions import parsing
from receptorium.operators.alleles import search_alleles
from receptorium.operators.dedup import dedup_index, sources_searched, union_sources
from receptorium.operators.dossier import build_dossiers
from receptorium.operators.lookup import index_warnings, retrieve_records
from receptorium.operators.similar import find_similar
from receptorium.session import cut_lineage
from receptorium.sources.files import index_meta, latest_build, read_index, read_meta


def plan_queries(queries: DataFrame) -> DataFrame:
    """(qid, species, query, plan...): what each sentence asks for, with the token fall-backs of a similarity request."""
    q = queries.withColumn("p", parsing.plan_intent(F.col("query")))
    tokens = F.split(F.replace("query", F.lit(","), F.lit(" ")), r"\s+")
    first = lambda prefix: F.coalesce(F.get(F.filter(tokens, lambda t: F.upper(t).startswith(prefix)), F.lit(0)), F.lit(""))
    pick = lambda field, prefix: F.when(F.col("p.intent") == "similar", F.coalesce(F.nullif(f"p.{field}", F.lit("")), first(prefix))) \
        .otherwise(F.col(f"p.{field}"))
    return q.select("qid", "species", F.col("query").alias("text"), F.col("p.intent").alias("intent"), F.lit("heuristic").alias("plan_source"),
                    F.col("p.query").alias("query"), pick("cdr3_aa", "CAS").alias("cdr3_aa"), pick("v_gene", "TRBV").alias("v_gene"),
                    pick("j_gene", "TRBJ").alias("j_gene"))


def answer(queries: DataFrame, catalog: DataFrame, index: DataFrame, constants: DataFrame, alleles: DataFrame,
           loops: DataFrame | None = None) -> dict[str, DataFrame]:
    """Plan every sentence (qid, query, species) and run the three kinds of request, each as one job."""
    plans = cut_lineage(plan_queries(queries))
    dossiers = build_dossiers(plans.filter("intent = 'dossier'").select("qid", "query", "species", "v_gene", "j_gene", "cdr3_aa"),
                              catalog, index, constants, loops)
    near = find_similar(plans.filter("intent = 'similar'").select("qid", F.col("cdr3_aa").alias("cdr3"), "v_gene", "j_gene", "species"), index, loops)
    filters = plans.filter("intent = 'search'").withColumn("f", parsing.keyword_filters(F.col("text"))).select(
        "qid", "f.gene_name", "f.region", "f.sequence_contains", "species")
    return {"plans": plans, "dossiers": dossiers, "neighbours": near["neighbours"], "neighbour_warnings": near["warnings"],
            "alleles": search_alleles(filters, alleles)}


def lookup_stored(spark: SparkSession, root: str, queries: DataFrame, today: Column | None = None, **options) -> dict[str, DataFrame]:
    """Lookup in the latest build under ``root``: the answer of ``retrieve_records`` with ``sources_searched`` and, among the
    warnings, a missing or a stale index (these have no qid)."""
    index, missing = read_index(spark, root)
    out = retrieve_records(queries, index, **options)
    out["sources_searched"] = sources_searched(index)
    warnings = out["warnings"].unionByName(missing.select(F.lit(None).cast(out["warnings"].schema["qid"].dataType).alias("qid"), "code", "block", "message"))
    if missing.isEmpty():
        old = index_warnings(latest_build(read_meta(spark, root)), today).filter("is_stale").select(
            F.lit(None).cast(out["warnings"].schema["qid"].dataType).alias("qid"), F.lit("records_index_stale").alias("code"), F.lit("records").alias("block"),
            F.format_string("the index is %d days old", F.col("age_days").cast("int")).alias("message"))
        warnings = warnings.unionByName(old)
    out["warnings"] = warnings
    return out


def build_index(sources: list[DataFrame], build_id: str = "0") -> tuple[DataFrame, DataFrame]:
    """Union of harmonized sources without duplicates, and its metadata row."""
    index = dedup_index(union_sources(sources))
    return index, index_meta(index, build_id)
