from pyspark.sql import functions as F

from receptorium.plans.answer import answer
from receptorium.sources import germline
from tests.test_sequences import J1, V1, coding


def test_sentences_reach_their_operator(spark, make_index):
    rows = [("human", "TRB", "V", "TRBV1*01", "TRBV1", coding(V1), 0), ("human", "TRB", "J", "TRBJ1*01", "TRBJ1", "G" + coding(J1), 1)]
    catalog = germline.allele_catalog(spark.createDataFrame(rows, "species string, chain string, segment string, allele string, gene string, nt string, ord long"))
    index = make_index([dict(source="vdjdb", source_record_id="vdjdb:1", species="human", chain="beta", cdr3_aa="CASSLSYEQYF", v_gene="TRBV1", j_gene="TRBJ1", epitope_aa="NLV")])
    alleles = spark.createDataFrame([("HLA-A", "A*01", "exon", "human", "ACGT", 0), ("HLA-B", "B*01", "exon", "human", "ACGT", 1)],
                                    "gene_name string, allele_name string, region string, species string, sequence string, ord long")
    q = spark.createDataFrame([("d", "what does TRBV1 recognise"), ("s", "similar to CASSLSYEQYF TRBV1 TRBJ1"), ("x", "show HLA-A ??"), ("c", "CASSLSYEQYF")], "qid string, query string") \
        .withColumn("species", F.lit("human"))
    out = answer(q, catalog, index, germline.constant_regions(spark), alleles)
    assert {r.qid: r.intent for r in out["plans"].collect()} == {"d": "dossier", "s": "similar", "x": "search", "c": "similar"}
    assert {r.qid: r.v.call for r in out["dossiers"].collect()} == {"d": "TRBV1"}
    near = {r.qid: r for r in out["neighbours"].collect()}
    assert set(near) == {"s", "c"} and near["s"].distance == 0 and near["s"].similarity == 1.0 and near["s"].epitope_aa == "NLV"
    assert {r.code for r in out["neighbour_warnings"].collect()} == {"tcrdist_unavailable"}
    assert [(r.qid, r.allele_name) for r in out["alleles"].collect()] == [("x", "A*01")]
