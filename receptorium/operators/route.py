"""Which tools answer a query, and what a sentence asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from receptorium.functions import parsing, text


def route_queries(queries: DataFrame) -> DataFrame:
    """One row per query (qid, query, species, force) and tool, with the reason.

    A forced tool wins; otherwise the detected type decides, then what the text mentions.
    """
    q = queries if "force" in queries.columns else queries.withColumn("force", F.lit(None).cast("string"))
    t = text.strip(F.coalesce("query", F.lit("")))
    q = q.withColumn("text", t).withColumns({"p": parsing.parse_text(F.col("text")), "c": parsing.classify(F.col("text"))})
    kind = F.col("c.detected_type")
    forced = F.col("force").isin("records", "assign", "dossier", "similar")
    ready = F.col("p.cdr3_aa").isNotNull() & F.col("p.v_gene").isNotNull() & F.col("p.j_gene").isNotNull()
    mentions = F.coalesce("p.record_id", "p.cdr3_aa", "p.v_gene", "p.j_gene").isNotNull()
    choice = (
        F.when(forced, F.struct(F.array(F.col("force")).alias("tools"), F.concat(F.lit("forced "), "force").alias("note")))
        .when(kind == "id", _choice(["records"], "database id lookup"))
        .when(kind.isin("gene_name", "allele"), _choice(["records"], "gene lookup"))
        .when(kind == "raw_nt", _choice(["assign"], "nucleotide sequence, germline assignment"))
        .when((kind == "raw_aa") & parsing.is_cdr3_token(F.col("text")), _choice(
            ["records", "assign"], "amino acid CDR3, known records and germline assignment (J only, V needs framework)"))
        .when(kind == "raw_aa", _choice(["assign"], "amino acid sequence, germline assignment"))
        .when(mentions, _choice(["records"], "parsed a phrase into records filters"))
        .otherwise(_choice(["ask"], "free text, routed to ask")))
    q = q.withColumn("r", choice)
    return q.select(
        "qid", kind.alias("detected_type"), F.coalesce("species", "p.species").alias("species"), "r.note",
        F.posexplode("r.tools").alias("step", "tool"),
        F.when(forced & (F.col("force") == "similar") & ~ready, F.lit("similarity needs a CDR3 with V and J genes")).alias("warning"),
        F.col("p.cdr3_aa").alias("cdr3_aa"), F.col("p.v_gene").alias("v_gene"), F.col("p.j_gene").alias("j_gene"), F.col("p.record_id").alias("record_id"))


def _choice(tools: list[str], note: str):
    return F.struct(F.array(*[F.lit(t) for t in tools]).alias("tools"), F.lit(note).alias("note"))
