import random

import pytest
from pyspark.sql import functions as F

from receptorium.constants import AMINO_BY_CODON, BASE_ORDER
from receptorium.operators import align, assign, dossier
from receptorium.operators.reconstruct import reconstruct
from receptorium.sources import germline

BACK = {a: BASE_ORDER[i // 16] + BASE_ORDER[i // 4 % 4] + BASE_ORDER[i % 4] for i, a in enumerate(AMINO_BY_CODON)}


def coding(aa):
    return "".join(BACK[a] for a in aa)


RNG = random.Random(3)
V1 = "".join(RNG.choice("ADEFGHIKLMNPQRSTVWY") for _ in range(104 - 14)) + "YFCASS"
V2 = "".join(RNG.choice("ADEFGHIKLMNPQRSTVWY") for _ in range(104 - 14)) + "YLCAVR"
J1, J2 = "SYEQYFGPGTRLTVT", "NTGELFFGEGSRLTVL"


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [("human", "TRB", "V", "TRBV1*01", coding(V1)), ("human", "TRB", "V", "TRBV1*02", coding(V1)), ("human", "TRA", "V", "TRAV2*01", coding(V2)),
            ("human", "TRB", "J", "TRBJ1*01", "G" + coding(J1)), ("human", "TRA", "J", "TRAJ2*01", coding(J2)),
            ("human", "TRB", "C", "TRBC1*01", coding("EDLNKVFPPEVAVFEPSEAEISHTQKATLV"))]
    e = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "species string, chain string, segment string, allele string, nt string, ord long") \
        .withColumn("gene", F.split_part("allele", F.lit("*"), F.lit(1)))
    return germline.allele_catalog(e).checkpoint() if spark.sparkContext.getCheckpointDir() else germline.allele_catalog(e)


def test_reconstruct(spark, catalog):
    q = spark.createDataFrame([(1, "TRBV1", "TRBJ1", "CASSLSYEQYF", "human"), (2, "TRBV9", "TRBJ1", "CASSLF", "human")], "id int, v_gene string, j_gene string, cdr3_aa string, species string")
    got = {r.id: r for r in reconstruct(q, catalog, germline.constant_regions(spark)).collect()}
    assert got[1].full_aa == V1[:-4] + "CASSLSYEQYF" + "GPGTRLTVT" and got[1].full_chain_aa.startswith(got[1].full_aa + "EDLNKV")
    assert got[1].v_allele_used == "TRBV1*01"
    assert got[2].full_nt is None and not got[2].v_found and got[2].j_found and got[2].cdr3_nt


def test_assignment(spark, catalog, make_index):
    index = make_index([dict(source="vdjdb", species="human", chain="beta", cdr3_aa="CASSLSYEQYF", v_gene="TRBV1", j_gene="TRBJ1")])
    aa = V1[:-4] + "CASSLSYEQYF" + "GPGTRLTVT" + "EDLNKVFPPEVAVFEPSEAEISHTQKATLV"
    nt = coding(aa)
    q = spark.createDataFrame([("aa", aa, None), ("nt", nt, None), ("shift", nt[4:], "beta"), ("cdr3", "CASSLSYEQYF", None), ("part", nt[120:], "gibberish")], "seq_id string, seq string, chain string") \
        .withColumns({"species": F.lit("human"), "want_d": F.lit(True)})
    got = {r.seq_id: r for r in assign.assign_alleles(q, catalog.unionByName(germline.d_alleles(spark)), index, germline.constant_regions(spark)).collect()}
    for k in ("aa", "nt", "shift"):
        assert got[k].chain == "TRB" and got[k].cdr3_aa == "CASSLSYEQYF" and got[k].v_determinable, k
        assert got[k].v_call.alleles == ["TRBV1*01", "TRBV1*02"] and got[k].v_call.identity == 1.0
        assert got[k].j_call.alleles == ["TRBJ1*01"] and got[k].constant_call.alleles == ["TRBC1*01"]
        assert any(w.startswith("ambiguous V allele (2") for w in got[k].warnings)
    assert got["nt"].regions["FR1"] == 1.0 and got["nt"].reconstruction.full_aa.startswith(V1[:-4])
    assert not got["cdr3"].v_determinable and got["cdr3"].v_call is None and got["cdr3"].v_db_inference[0].v_gene == "TRBV1"
    assert "FR1" not in got["part"].regions and any("unrecognized chain" in w for w in got["part"].warnings)


def test_assignment_in_full(spark, make_index):
    """Tie sets, identities, spans, region shares, D and C calls, each worked out allele by allele."""

    from receptorium.constants import D_ALLELES, V_REGION_SPANS
    from receptorium.functions import kernels as K

    rng = random.Random(12)
    bases = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    change = lambda s, *at: "".join({"A": "C", "C": "G", "G": "T", "T": "A"}[c] if i in at else c for i, c in enumerate(s))
    v1, v2 = bases(306) + "TGTGCCAGC", bases(306) + "TGTGCCAGC"
    entries = [("TRB", "V", "TRBV1*01", v1), ("TRB", "V", "TRBV1*02", change(v1, 40, 90)), ("TRB", "V", "TRBV1*03", v1[6:]), ("TRB", "V", "TRBV2*01", v2), ("TRA", "V", "TRAV1*01", bases(310)),
               ("TRB", "J", "TRBJ1*01", "GAGCAGTACTTCGGGCCAGGCACACGG"), ("TRB", "J", "TRBJ2*01", "AACACCGGGGAGCTGTTTTTTGGAGAAGGCTCT"), ("TRB", "C", "TRBC1*01", bases(120))]
    table = spark.createDataFrame([("human", c, s, a, a.split("*")[0], nt, i) for i, (c, s, a, nt) in enumerate(entries)],
                                  "species string, chain string, segment string, allele string, gene string, nt string, ord long")
    catalog = germline.allele_catalog(table).unionByName(germline.d_alleles(spark))
    d = next(nt for sp, c, _, nt in D_ALLELES if sp == "human")
    c = entries[-1][3]
    seqs = {"plain": v1 + "AC" + d + "GT" + entries[5][3] + c, "off": change(v1, 3, 33, 150, 200) + "A" + d[:9] + entries[6][3] + change(c, 10), "late": v1[30:] + d + entries[5][3] + c[:70],
            "other": change(v2, 77)[:-3] + entries[6][3] + c[:40]}
    q = spark.createDataFrame([(k, x) for k, x in seqs.items()], "seq_id string, seq string").withColumns({"species": F.lit("human"), "chain": F.lit(None).cast("string"), "want_d": F.lit(True)})
    got = {r.seq_id: r for r in assign.assign_alleles(q, catalog, make_index([]), germline.constant_regions(spark)).collect()}

    def call(piece, refs):
        scores = K.local_scores(list(refs.values()), [piece])[0]
        names = sorted(n for n, x in zip(refs, scores) if x == scores.max() > 0)
        pairs = {n: K.aligned_pairs([refs[n]], [piece], True)[1][0] for n in names}
        share = max(sum(refs[n][x] == piece[y] for x, y in zip(*pairs[n])) / len(pairs[n][0]) for n in names)
        ts, qs = pairs[names[0]]
        return names, share, [int(qs[0]), int(qs[-1]) + 1], refs[names[0]], list(zip(ts.tolist(), qs.tolist()))

    of = lambda segment: {a: nt for ch, s, a, nt in entries if ch == "TRB" and s == segment}
    ds = {a: nt for sp, ch, a, nt in D_ALLELES if sp == "human"}
    for k, x in seqs.items():
        r = got[k]
        assert r.chain == "TRB" and r.v_determinable
        (vn, vi, vs, ref, pairs), (jn, ji, js, _, _) = call(x, of("V")), call(x, of("J"))
        assert (r.v_call.alleles, r.v_call.aligned_span) == (vn, vs) and abs(r.v_call.identity - vi) < 1e-12
        assert (r.j_call.alleles, r.j_call.aligned_span) == (jn, js) and abs(r.j_call.identity - ji) < 1e-12
        for name, (a, b) in V_REGION_SPANS.items():
            stop = min(3 * b, len(ref))
            inside = [(t, y) for t, y in pairs if 3 * a <= t < stop]
            want = sum(ref[t] == x[y] for t, y in inside) / (stop - 3 * a) if inside else None
            assert r.regions.get(name) == want, (k, name)
        gap, rest = x[vs[1]:js[0]], x[js[1]:]
        if len(rest) >= 60:
            cn, ci, cs, _, _ = call(rest, of("C"))
            assert (r.constant_call.alleles, r.constant_call.aligned_span) == (cn, cs) and abs(r.constant_call.identity - ci) < 1e-12
        else:
            assert r.constant_call is None
        if gap:
            dn, di, dspan, _, _ = call(gap, ds)
            assert (r.d_call.alleles, r.d_call.aligned_span) == (dn, dspan) and abs(r.d_call.identity - di) < 1e-12
    assert got["plain"].v_call.alleles[0] == "TRBV1*01" and got["late"].v_call.alleles == ["TRBV1*01", "TRBV1*03"]


def test_center_star(spark):
    rows = [("s", "a", "ACGTACGTAA", 0), ("s", "b", "ACGTTACGTAA", 1), ("s", "c", "ACGACGTAA", 2), ("t", "x", "MKV", 0), ("u", "p", "ACGT", 0), ("u", "q", "ACGT", 1)]
    m = spark.createDataFrame(rows, "set_id string, name string, seq string, ord long")
    aligned = align.align_set(m, "nt")
    got = {(r.set_id, r.name): r.aligned for r in aligned.collect()}
    assert len({len(v) for k, v in got.items() if k[0] == "s"}) == 1 and ("t", "x") not in got
    assert all(got[(s, n)].replace("-", "") == q for s, n, q, _ in rows if s != "t")
    summary = {r.set_id: r for r in align.alignment_summary(aligned).collect()}
    assert summary["u"].mean_pct_identity == 100.0 and summary["u"].consensus == "ACGT"
    s = [got[("s", n)] for n in "abc"]
    pct = [100 * sum(x == y != "-" for x, y in zip(p, q)) / sum(not x == y == "-" for x, y in zip(p, q)) for i, p in enumerate(s) for q in s[i + 1:]]
    assert summary["s"].mean_pct_identity == round(sum(pct) / 3, 2)
    assert [r.qid for r in align.set_warnings(m, m.select("set_id").distinct()).collect()] == ["t"]


def test_codon_alignment(spark):
    m = spark.createDataFrame([("s", "a", "G" + coding("MKVLLW"), 0), ("s", "b", coding("MKVW"), 1)], "set_id string, name string, seq string, ord long")
    for r in align.align_codon(m).collect():
        assert len(r.aligned_nt) == 3 * len(r.aligned_aa)


def test_dossiers(spark, catalog, make_index):
    index = make_index([dict(source="vdjdb", source_record_id="vdjdb:1", species="human", chain="beta", cdr3_aa="CASSLSYEQYF", v_gene="TRBV1", j_gene="TRBJ1", epitope_aa="NLV")])
    q = spark.createDataFrame([("gene", "TRBV1", None, None), ("recon", "CASSLSYEQYF", "TRBV1", "TRBJ1"), ("j", "TRBJ1", None, None), ("what", "hello ?!", None, None), ("id", "vdjdb:1", None, None)],
                              "qid string, query string, v_gene string, j_gene string")
    got = {r.qid: r for r in dossier.build_dossiers(q, catalog, index, germline.constant_regions(spark)).collect()}
    assert got["gene"].status == "complete" and got["gene"].v.allele == "TRBV1*01" and got["gene"].known_epitopes == ["NLV"] and got["gene"].records == ["vdjdb:1"]
    assert got["recon"].junction.cdr3_nt_is_synthetic and got["recon"].full_sequence.aa.startswith(V1[:-4])
    assert {w.code for w in got["j"].warnings} == {"partial_annotation"} and got["j"].chain == "beta"
    assert "unresolved_input_type" in {w.code for w in got["what"].warnings} and got["what"].status == "partial"
    assert got["id"].junction.cdr3_aa == "CASSLSYEQYF" and got["id"].v.call == "TRBV1"
