"""K-mer annotation: V and J calls of raw sequences by shared words with the germline."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from receptorium.constants import CHAIN_LABELS, CHAINS, KMER, PROV_KMER
from receptorium.functions import sequence, text
from receptorium.session import sent_if_small, spread
from receptorium.sources.germline import germline_species

GERMLINE_WORDS, SEQUENCES_PER_TASK = 500_000, 50_000
LIMITED_MESSAGE = "from a protein only the V region is annotated: D and the bases of the junction stay open"
NO_D_MESSAGE = "shared words are too short to tell D segments apart, so D stays open"


def germline_words(genes: DataFrame, k: int = KMER) -> DataFrame:
    """Word list of representative V and J genes, for nucleotide and for protein queries."""
    forms = genes.filter(F.col("segment").isin("V", "J")).select(
        "species", "chain", "segment", "gene", "ord", F.explode(F.array(
            F.struct(F.lit(False).alias("is_protein"), F.col("nt").alias("s")),
            F.struct(F.lit(True).alias("is_protein"), sequence.drop_stops(sequence.translate(F.col("nt"))).alias("s")))).alias("f"))
    words = forms.select("species", "chain", "segment", "gene", "ord", "f.is_protein", sequence.kmers(F.col("f.s"), k).alias("w"))
    return words.select("*", F.size("w").alias("n_words"), F.explode("w").alias("word")).drop("w")


def annotate_kmer(sequences: DataFrame, genes: DataFrame, k: int = KMER) -> DataFrame:
    """V and J call of sequences (seq_id, seq, species, is_protein) against representative genes.

    Score = 100 * shared words / words of the gene. The first gene wins ties inside a chain, the first
    chain wins ties of the rounded V score; J is looked for in the winning chain only. Up to GERMLINE_WORDS words of the
    germline go to every task, and a sequence then meets them in its own task: its words are not shuffled.
    """
    s = sequences.withColumn("_sp", germline_species(F.col("species")))
    # words carry a digest of their sequence, not the sequence
    s = s.withColumn("_id", F.unhex(F.md5(F.concat_ws("|", "_sp", F.col("is_protein").cast("string"), F.coalesce("seq", F.lit(""))))))
    # by two columns: dealt by the digest alone, Spark would keep the tasks of the step before and merge them
    distinct = spread(s.select("_id", "_sp", "seq", "is_protein").dropDuplicates(["_id"]), "_id", "_sp",
                      rows=sequences.count(), per_task=SEQUENCES_PER_TASK)
    words = distinct.select("_id", "_sp", "is_protein", F.explode(sequence.kmers(F.col("seq"), k)).alias("word"))
    germ = sent_if_small(germline_words(genes, k).withColumnRenamed("species", "_sp"), GERMLINE_WORDS)
    shared = words.join(germ, ["_sp", "is_protein", "word"]).groupBy("_id", "_sp", "segment", "chain", "gene", "ord", "n_words") \
        .agg(F.count(F.lit(1)).alias("n"))
    scored = shared.withColumn("score", F.lit(100.0) * F.col("n") / F.col("n_words"))
    by_chain = scored.groupBy("_id", "_sp", "segment", "chain").agg(
        F.max_by(F.struct("gene", F.round("score", 2).alias("score")), F.struct("score", -F.col("ord"))).alias("b"))
    order = F.array_position(F.array(*[F.lit(c) for c in CHAINS]), F.col("chain"))
    v = F.when((F.col("segment") == "V") & (F.col("b.score") > 0), F.struct("chain", "b.gene", "b.score"))
    calls = by_chain.groupBy("_id", "_sp").agg(
        F.max_by(v, F.when(v.isNotNull(), F.struct("b.score", -order))).alias("v"),
        F.map_from_entries(F.collect_list(F.when(F.col("segment") == "J", F.struct("chain", "b")))).alias("j"))
    calls = calls.filter(F.col("v").isNotNull()).select("_id", "_sp", "v", F.try_element_at("j", F.col("v.chain")).alias("jb"))
    out = s.join(calls, ["_id", "_sp"], "left")
    called = F.col("v").isNotNull()
    return out.select(
        "seq_id", F.col("v.gene").alias("v_call"), F.col("v.score").alias("v_score"), F.col("jb.gene").alias("j_call"),
        F.when(called, F.coalesce("jb.score", F.lit(0.0))).alias("j_score"), F.lit(None).cast("string").alias("d_call"),
        F.coalesce(text.recode(F.col("v.chain"), CHAIN_LABELS), F.lit("unknown")).alias("chain"),
        F.lit(PROV_KMER).alias("source"), F.when(F.col("is_protein"), "low").otherwise("medium").alias("confidence"),
        F.array_compact(F.array(
            F.when(F.col("is_protein"), F.lit("aa_annotation_limited")),
            F.when(F.col("v.chain").isin("TRB", "TRD"), F.lit("d_segment_unresolved")))).alias("warnings"))


WARNING_TEXT = {"aa_annotation_limited": LIMITED_MESSAGE, "d_segment_unresolved": NO_D_MESSAGE}
