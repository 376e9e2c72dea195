import zipfile

from receptorium.sources import alleles, files, germline, records, uploads


def test_vdjdb_numbers_and_skips(spark, tmp_path):
    p = tmp_path / "vdjdb-1.zip"
    body = "gene\tcdr3\tspecies\tcomplex.id\tv.segm\treference.id\tvdjdb.score\n" \
           "TRA\tcav\tHomoSapiens\t7\ttrav1*01\tPMID:12\t1\nTRG\tCAA\tHomoSapiens\t0\tx\t\t\nTRB\tCASS\tMusMusculus\t0\tTRBV1\thttp\t0\nTRB\t\tMusMusculus\t0\tTRBV1\t\t\n"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("d/vdjdb.slim.txt", body)
    got = records.present_sources(spark, str(tmp_path), str(tmp_path / "staging"))["vdjdb"].orderBy("src_row").collect()
    assert [(r.source_record_id, r.pairing_key, r.chain, r.species, r.cdr3_aa, r.v_gene, r.reference_pmid) for r in got] == [
        ("vdjdb:0", "vdjdb:c7", "alpha", "human", "CAV", "TRAV1*01", "12"), ("vdjdb:2", "vdjdb:u2", "beta", "mouse", "CASS", "TRBV1", None)]


def test_mcpas_quoted_line_breaks(spark, tmp_path):
    p = tmp_path / "mcpas.csv"
    p.write_bytes('﻿CDR3.alpha.aa,CDR3.beta.aa,Species,Remarks,TRBD,CDR3.alpha.nt\nCAV,CASS,Human,"a\nb",D1,TGT\nNA,CASR,Mouse,-,D2,NA\n'.encode())
    got = records.read_mcpas(spark, str(p)).orderBy("src_row").collect()
    assert [(r.source_record_id, r.chain, r.cdr3_aa, r.cdr3_nt, r.d_gene) for r in got] == [
        ("mcpas:0", "alpha", "CAV", "TGT", None), ("mcpas:0", "beta", "CASS", None, "D1"), ("mcpas:1", "beta", "CASR", None, "D2")]


def test_iedb_two_header_rows(spark, tmp_path):
    top = ["Receptor", "Receptor", "Epitope", "Assay"] + ["Chain 1"] * 4 + ["Chain 2"] * 4
    chain = ["Curated V Gene", "Calculated V Gene", "CDR3 Calculated", "Organism IRI"]
    second = ["IEDB Receptor ID", "Group IRI", "Name", "MHC Allele Names", *chain, *chain]
    lines = [top, second, ["5", "", "NLV", "HLA-A2", "", "TRAV1", "CAV", "http://x/NCBITaxon_9606", "TRGV1", "", "CAS", ""],
             ["6", "http://r/6", "GIL", "", "TRBV2", "", "CASS", "http://x/NCBITaxon_10090/", "", "TRAV3", "", ""]]
    p = tmp_path / "iedb_tcr.csv"
    p.write_text("\n".join(",".join(x) for x in lines) + "\n")
    got = records.read_iedb(spark, str(p)).orderBy("src_row").collect()
    assert [(r.source_record_id, r.chain, r.cdr3_aa, r.species, r.external_url) for r in got] == [
        ("iedb:5", "alpha", "CAV", "human", "https://www.iedb.org/receptor/5"), ("iedb:6", "beta", "CASS", "mouse", "http://r/6")]


def test_tcr3d_fill_keeps_last(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("PDB_ID\tTCR_organism\tCDR1_alpha\tCDR3_alpha\tCDR3_beta\tTRAV_gene\n1ao7\tHomo sapiens\t\tCAV\tCASS\tTRAV1\n")
    (tmp_path / "ch.tsv").write_text("pdb_id\ttcr_type\tcdr1_sequences\tcdr2_sequences\n1ao7\tAlpha\tAAA\tB\n1ao7\talpha\tCCC\tD\n")
    got = {r.chain: r for r in records.read_tcr3d(spark, str(tmp_path / "c.tsv"), str(tmp_path / "ch.tsv")).collect()}
    assert got["alpha"].cdr1_aa == "CCC" and got["beta"].cdr1_aa is None and got["alpha"].source_record_id == "tcr3d:1ao7:alpha"


def test_germline_fasta_and_representative(spark, tmp_path):
    folder = tmp_path / "HUMAN"
    folder.mkdir()
    (folder / "TRB.fasta").write_text(">a|TRBV1*02|h|~VARIABLE\nacg\ntaa\n>b|TRBV1*01|h|~VARIABLE\nTTT\n>c|TRBJ1*01|h|~JOINING\nGGG\n>d|TRBV1*01|h|~LEADER\nCCC\n>e\nAAA\n")
    e = germline.germline_entries(spark, str(tmp_path))
    assert sorted((r.chain, r.species, r.segment, r.allele, r.nt) for r in e.collect()) == [
        ("TRB", "human", "J", "TRBJ1*01", "GGG"), ("TRB", "human", "V", "TRBV1*01", "TTT"), ("TRB", "human", "V", "TRBV1*02", "ACGTAA")]
    assert {r.gene: r.nt for r in germline.representative_genes(e).collect()} == {"TRBV1": "TTT", "TRBJ1": "GGG"}


def test_uploads_by_extension(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">AL|G1|V-REGION|Homo sapiens\nacgt\nac\n")
    (tmp_path / "b.csv").write_text("gene_name,sequence\nG2,acg\nG3,\n")
    (tmp_path / "c.json").write_text('[{"gene": "G4", "sequence": "tt"}, {"gene": "G5"}]')
    (tmp_path / "d.txt").write_text("see ACGTACGTACGTA and acgtacgtacgg\n")
    got = uploads.ingest_uploads(spark, str(tmp_path), "upload", "mouse").collect()
    assert sorted((r.species, r.gene_name, r.sequence) for r in got) == [
        ("human", "G1", "ACGTAC"), ("mouse", "G2", "ACG"), ("mouse", "G4", "TT"), ("mouse", "text-seq-1", "ACGTACGTACGTA"), ("mouse", "text-seq-2", "ACGTACGTACGG")]


def test_uploads_with_capital_extensions_and_json_keys(spark, tmp_path):
    (tmp_path / "A.FASTA").write_text(">AL|G1|V-REGION|Homo sapiens\nacgt\n")
    (tmp_path / "b.CSV").write_text("gene,sequence\nG2,acg\n")
    (tmp_path / "C.Json").write_text('{"gene": "G3", "sequence": "tt", "clone": "x7", "reads": 12}')
    (tmp_path / "d.Fa").write_text(">AL|G4|V-REGION|Homo sapiens\nacgt\n")
    got = {r.gene_name: r for r in uploads.ingest_uploads(spark, str(tmp_path), "upload").collect()}
    assert set(got) == {"G1", "G2", "G3", "G4"} and got["G3"].metadata == {"gene": "G3", "sequence": "tt", "clone": "x7", "reads": "12"}


def test_refresh_keeps_the_index_from_partial_sources(spark, tmp_path, make_index):
    root, one = str(tmp_path / "index"), make_index([dict(source="vdjdb", cdr3_aa="CA")])
    assert files.refresh_index(spark, root, {"vdjdb": one, "iedb": None}, "9").filter("built").count() == 2  # nothing to lose yet
    assert files.refresh_index(spark, root, {"vdjdb": make_index([dict(source="vdjdb", cdr3_aa="CB")]), "iedb": None}, "10").filter("not built").count() == 2
    assert [r.cdr3_aa for r in files.read_index(spark, root)[0].collect()] == ["CA"]
    files.refresh_index(spark, root, {"vdjdb": make_index([dict(source="vdjdb", cdr3_aa="CC")])}, "10")
    assert [r.cdr3_aa for r in files.read_index(spark, root)[0].collect()] == ["CC"]
    assert spark.read.json(f"{root}/status").count() == 5


def test_lookup_in_a_stored_index(spark, tmp_path, make_index):
    from pyspark.sql import functions as F

    from receptorium.plans.answer import lookup_stored

    asked = spark.createDataFrame([("q", "CSARDRGYTF", None)], "qid string, cdr3_aa string, species string")
    root = str(tmp_path / "index")
    none = lookup_stored(spark, root, asked, include_neighbours=False)
    assert [(w.qid, w.code) for w in none["warnings"].collect()] == [(None, "records_index_unavailable")]
    files.write_index(make_index([dict(source="tcr3d", cdr3_aa="CSARDRGYTF"), dict(source="iedb", cdr3_aa="CAWSV")]), root, "9")
    out = lookup_stored(spark, root, asked, F.lit("2999-01-01").cast("date"), include_neighbours=False)
    assert out["exact"].count() == 1 and out["sources_searched"].first().sources == ["iedb", "tcr3d"]
    assert [w.code for w in out["warnings"].collect()] == ["records_index_stale"]
    assert lookup_stored(spark, root, asked, include_neighbours=False)["warnings"].isEmpty()


def test_allele_payload(spark):
    one = spark.createDataFrame([('{"accession":"H1","name":"A*01:01","class":"I","sequence":{"coding":"ATG","genomic":"AAAA","protein":"M"}}',)], "value string")
    r = alleles.allele_records(one).first()
    assert (r.gene_name, r.sequence, r.metadata["genomic_seq_len"], r.species) == ("HLA-A", "ATG", "4", "human")


def test_index_on_disk(spark, tmp_path, make_index):
    root = str(tmp_path / "index")
    empty, warning = files.read_index(spark, root)
    assert empty.count() == 0 and warning.first().code == "records_index_unavailable"
    files.write_index(make_index([dict(source="vdjdb", cdr3_aa="CA")]), root, "2024-01-01")
    files.write_index(make_index([dict(source="vdjdb", cdr3_aa="CB"), dict(source="mcpas", cdr3_aa="CC")]), root, "2024-02-01")
    index, warning = files.read_index(spark, root)
    assert {r.cdr3_aa for r in index.collect()} == {"CB", "CC"} and warning.count() == 0
