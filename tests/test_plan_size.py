"""Steps that must be planned once per row, or without a shuffle of the records."""

from receptorium.functions import parsing
from receptorium.operators import annotate, epitopes, lookup, reconstruct
from receptorium.plans import answer
from receptorium.session import spread
from receptorium.sources import germline


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_sentence_is_classified_once(spark):
    q = spark.createDataFrame([(1, "human TCR with CDR3 CASSIRSSYEQYF, TRBV1-1;", None), (2, "similar to CASSL TRBJ2-7", None), (3, None, None),
                               (4, "vdjdb:77 epitope", None)], "qid long, query string, species string")
    plans = answer.plan_queries(q)
    assert _plan(plans).count(parsing.CDR3_PATTERN) == 0 and _plan(plans).count(parsing.AMINO_TEXT_PATTERN) <= 40
    got = {r.qid: (r.intent, r.query, r.cdr3_aa, r.v_gene, r.j_gene) for r in plans.collect()}
    assert got[1] == ("dossier", "TRBV1-1;", "", "TRBV1-1;", "") and got[4] == ("dossier", "vdjdb:77", "", "", "")
    assert got[2] == ("similar", None, "CASSL", "", "TRBJ2-7") and got[3][0] == "search"


def test_records_meet_a_small_catalog_without_a_shuffle(spark, make_index):
    entries = spark.createDataFrame([
        ("human", "TRB", "V", "TRBV1*01", "TRBV1", "GAAACTCTGTTTTGTGCCAGC", 1), ("human", "TRB", "J", "TRBJ1*01", "TRBJ1", "GAGCAGTACTTCGGGCCGGGCACC", 2)],
        "species string, chain string, segment string, allele string, gene string, nt string, ord long")
    rows = make_index([{"species": "human", "v_gene": "TRBV1", "j_gene": "TRBJ1", "cdr3_aa": "CASSEQYF"},
                       {"species": "human", "v_gene": "TRBV1", "j_gene": "TRBJ1", "cdr3_aa": "CASSEQYF", "cdr3_nt": "TGT"}])
    rows = rows.selectExpr("*", "cast(null as string) as full_nt", "cast(null as string) as full_aa") if "full_nt" not in rows.columns else rows
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = reconstruct.enrich_records(rows, germline.allele_catalog(entries), germline.constant_regions(spark))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") <= 1  # the constant regions, whose size is known
        got = {r.src_row: r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got[0].nt_is_synthetic and got[0].v_gene == "TRBV1" and got[0].full_nt_kind == "reconstructed"
    assert not got[1].nt_is_synthetic and got[1].cdr3_nt == "TGT" and got[1].v_gene == "TRBV1" and got[1].composition is None


def _exchanges(df) -> list[str]:
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_tasks_grow_with_the_rows(spark):
    df = spark.range(10)
    assert spread(df, "id", rows=100_000_000).rdd.getNumPartitions() == 400
    assert spread(df, "id").rdd.getNumPartitions() == max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def test_gene_inference_in_tasks_of_its_own_count(spark, make_index):
    index = make_index([{"species": "human", "v_gene": v, "j_gene": "TRBJ1", "cdr3_aa": c} for v, c in (
        ("TRBV1", "CASSF"), ("TRBV1", "CASSF"), ("TRBV2", "CASSF"), ("TRBV3", ""), ("TRBV3", None), (None, "CASSF"))])
    asked = spark.createDataFrame([("a", " cassf", None), ("b", "CASSF", "human"), ("c", "", None), ("d", None, None)], "qid string, cdr3_aa string, species string")
    out = lookup.infer_genes(asked, index)
    own = [x for x in _exchanges(out) if "REPARTITION_BY_NUM" in x]
    assert len(own) == 2 and all("i_cdr3" in x for x in own)  # the CDR3 asked for, and the counted records
    assert sorted((r.qid, r.v_gene, r["count"]) for r in out.collect()) == [("a", "TRBV1", 2), ("a", "TRBV2", 1), ("b", "TRBV1", 2), ("b", "TRBV2", 1)]


def test_words_of_sequences_are_not_shuffled(spark):
    genes = spark.createDataFrame([("human", "TRB", "V", "TRBV1", "GAAACTCTGTTTTGTGCCAGC", 1), ("human", "TRB", "V", "TRBV2", "GAAACTCTGTTTTGTGCCAGT", 2),
                                   ("human", "TRB", "J", "TRBJ1", "GAGCAGTACTTCGGGCCGGGC", 3)], "species string, chain string, segment string, gene string, nt string, ord long")
    seqs = spark.createDataFrame([(1, "GAAACTCTGTTTTGTGCCAGCGAGCAGTACTTC", "human", False), (2, "GAAACTCTGTTTTGTGCCAGCGAGCAGTACTTC", "human", False),
                                  (3, None, "human", False), (4, "ACG", None, False)], "seq_id long, seq string, species string, is_protein boolean")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = annotate.annotate_kmer(seqs, genes)
        exchanges = _exchanges(out)
        assert not any("word" in x for x in exchanges) and any("REPARTITION_BY_NUM" in x for x in exchanges)
        got = {r.seq_id: (r.v_call, r.v_score, r.j_call) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got[1] == got[2] == ("TRBV1", 100.0, "TRBJ1") and got[3] == got[4] == (None, None, None)


def test_records_meet_few_requests_without_a_shuffle(spark, make_index):
    index = make_index([{"species": "human", "chain": "beta", "v_gene": v, "j_gene": "TRBJ1", "cdr3_aa": "CASSF", "epitope_aa": e} for v, e in (("TRBV1", "NLV"), ("TRBV1", "GIL"), ("TRBV2", "NLV"))])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        specs = lookup.search_keys(spark.createDataFrame([("human", None, "TRBV1", None)], "species string, cdr3_aa string, v_gene string, j_gene string"))
        hits = lookup.exact_hits(specs, index)
        known = epitopes.known_epitopes(spark.createDataFrame([(1, "TRBV1", "human")], "qid long, gene string, species string"), index)
        assert "_key" not in "".join(_exchanges(hits)) and "BroadcastHashJoin" in hits._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in known._jdf.queryExecution().executedPlan().toString()
        assert hits.count() == 2 and [(r.epitopes, r.total) for r in known.collect()] == [(["NLV", "GIL"], 2)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
