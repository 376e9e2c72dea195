"""Lookup, pairing and inference, each on a small index made for the question at hand."""

import pytest

from receptorium.operators import lookup

ASK = "qid string, query string, cdr3_aa string, cdr3_aa_b string, v_gene string, j_gene string, species string"


def receptor(n, cdr3, source="iedb", **more):
    """Record number ``n``; a human beta chain unless told otherwise."""
    return {"source": source, "source_record_id": f"{source}:{n}", "pairing_key": f"own{n}", "species": "human", "chain": "beta", "cdr3_aa": cdr3, **more}


@pytest.fixture
def ask(spark, make_index):
    def run(index, *questions, **options):
        table = spark.createDataFrame([tuple(q.get(c.split()[0]) for c in ASK.split(", ")) for q in questions], ASK)
        return {k: v.collect() for k, v in lookup.retrieve_records(table, make_index(index), **options).items()}
    return run


def found(answer, qid, part="exact"):
    return [r.source_record_id for r in answer[part] if r.qid == qid]


def test_one_receptor_in_three_sources(ask):
    index = [receptor(10, "CSARDRGYTF", "tcr3d", score="1"), receptor(11, "CSARDRGYTF", "iedb", score="3"), receptor(12, "CSARDRGYTF", "mcpas"), receptor(13, "CSVRDRGYTF")]
    out = ask(index, {"qid": "q", "cdr3_aa": " csarDRGYTF"})
    rows = sorted(out["exact"], key=lambda r: r["rank"])
    assert [r.source_record_id for r in rows] == ["iedb:11", "tcr3d:10", "mcpas:12"]  # by score, then source
    assert {r.concordance for r in rows} == {3}
    near = out["neighbours"]
    assert [r.source_record_id for r in near] == ["iedb:13"] and near[0].match_kind == "neighbour"


def test_top_k_cuts_rows_but_not_totals(ask):
    out = ask([receptor(n, "CSARDRGYTF", score=str(n % 4)) for n in range(7)], {"qid": "q", "cdr3_aa": "CSARDRGYTF"}, top_k=2, include_neighbours=False)
    assert found(out, "q") == ["iedb:3", "iedb:2"] or set(found(out, "q")) == {"iedb:3", "iedb:2"}
    assert [(t.total_exact, t.total_matches) for t in out["totals"]] == [(2, 7)]


def test_species_and_foreign_mhc(ask):
    index = [receptor(1, "CTSADNSPLYF", species="mouse"), receptor(2, "CTSAEPNTLYF", species="mouse", mhc_a="HLA-B*07:02"), receptor(3, "CTSAEPNTLYF", species=None)]
    questions = [{"qid": "wrong", "cdr3_aa": "CTSADNSPLYF", "species": "human"}, {"qid": "right", "cdr3_aa": "CTSADNSPLYF", "species": "Mouse"},
                 {"qid": "foreign", "cdr3_aa": "CTSAEPNTLYF", "species": "mouse"}, {"qid": "any", "cdr3_aa": "CTSAEPNTLYF"}]
    strict, wide = ask(index, *questions), ask(index, *questions, include_cross_species=True)
    assert (found(strict, "wrong"), found(strict, "right"), found(strict, "foreign")) == ([], ["iedb:1"], [])
    assert sorted(found(strict, "any")) == ["iedb:2", "iedb:3"]
    flagged = [r for r in wide["exact"] if r.qid == "foreign"]
    assert [r.source_record_id for r in flagged] == ["iedb:2"] and flagged[0].mhc_is_cross_species and flagged[0].mhc_organism == "human"


def test_genes_narrow_a_search(ask):
    index = [receptor(n, f"CSA{x}GYTF", v_gene=v, j_gene=j) for n, (x, v, j) in enumerate(
        [("RD", "TRBV20-1*02", "TRBJ1-2"), ("RE", "TRBV20-1", "TRBJ2-1"), ("RD", "TRBV29-1", "TRBJ1-2"), ("RQ", None, None)])]
    out = ask(index, {"qid": "v", "v_gene": "TRBV20-1"}, {"qid": "all", "cdr3_aa": "CSARDGYTF", "v_gene": "TRBV20-1*01", "j_gene": "TRBJ1-2"},
              {"qid": "text", "query": "TRBV29-1"}, include_neighbours=False)
    assert sorted(found(out, "v")) == ["iedb:0", "iedb:1"] and found(out, "all") == ["iedb:0"] and found(out, "text") == ["iedb:2"]


def test_free_text_and_ids(ask):
    index = [receptor(5, "CAWSVGQFYEQYF", species="mouse"), receptor(6, "CAWSVGQFYEQYF")]
    out = ask(index, {"qid": "text", "query": "murine, please: CAWSVGQFYEQYF (mouse)"}, {"qid": "id", "query": "iedb:6"})
    assert found(out, "text") == ["iedb:5"] and found(out, "id") == ["iedb:6"] and found(out, "id", "neighbours") == []


def test_second_chain(ask):
    index = [receptor(1, "CSARDRGYTF", pairing_key="cell"), receptor(2, "CIVRGDSNTF", chain="alpha", pairing_key="cell"), receptor(3, "CAWSVGQFYEQYF")]
    out = ask(index, {"qid": "both", "cdr3_aa": "CIVRGDSNTF", "cdr3_aa_b": "CSARDRGYTF"}, {"qid": "strangers", "cdr3_aa": "CAWSVGQFYEQYF", "cdr3_aa_b": "CIVRGDSNTF"},
              {"qid": "half", "cdr3_aa_b": "CSARDRGYTF"})
    assert [(p.qid, p.alpha_record_id, p.beta_record_id) for p in out["pairs"]] == [("both", "iedb:2", "iedb:1")]
    assert sorted(found(out, "strangers")) == ["iedb:2", "iedb:3"] and found(out, "half") == []
    assert [(w.qid, w.code) for w in out["warnings"]] == [("strangers", "no_pairing_found")]


def test_odd_letters_are_named(ask):
    out = ask([receptor(1, "CSARDRGYTF")], {"qid": "q", "cdr3_aa": "CSABDRGJTF"})
    assert [w.code for w in out["warnings"]] == ["nonstandard_residues"] and "B, J" in out["warnings"][0].message


def test_inferred_genes_by_support(spark, make_index):
    index = [receptor(n, "CSARDRGYTF", v_gene=v, j_gene="TRBJ1-2") for n, v in enumerate(["TRBV20-1", "TRBV20-1", "TRBV29-1"])]
    asked = spark.createDataFrame([("any", "CSARDRGYTF", None), ("none", "CSARDRGYTF", "mouse")], "qid string, cdr3_aa string, species string")
    got = sorted((r.qid, r["rank"], r.v_gene, r["count"]) for r in lookup.infer_genes(asked, make_index(index)).collect())
    assert got == [("any", 1, "TRBV20-1", 2), ("any", 2, "TRBV29-1", 1)]
