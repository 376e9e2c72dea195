"""Receptor-shaped views of the generic test tables, so that SQL can check the operators.

One text serves both engines: table names stand in braces for Spark and are plain names for SQL.
Every view reads its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def _digits(x: str, letters: str = "SGTLQAPNRY") -> str:
    return f"translate(cast({x} as varchar(20)), '0123456789', '{letters}')"


def _bases(key: str) -> str:
    k = f"cast({key} as varchar(20))"
    return f"translate(concat(md5({k}), md5(concat('b', {k})), md5(concat('c', {k}))), '0123456789abcdef', 'ACGTTGCAACGTGCTA')"


def _str(x: str) -> str:
    return f"cast({x} as varchar(20))"


VIEWS = {
    "rec": f"""
select case l_returnflag when 'A' then 'vdjdb' when 'N' then 'iedb' else 'mcpas' end as source,
  concat('r:', {_str('l_orderkey')}, ':', {_str('n')}) as source_record_id, concat('k:', {_str('l_orderkey')}) as pairing_key,
  case when l_orderkey % 3 = 0 then 'mouse' else 'human' end as species,
  case when n % 2 = 0 then 'alpha' else 'beta' end as chain,
  concat('CAS', {_digits('l_partkey * 7')}, case when l_suppkey % 2 = 0 then 'EQYF' else 'GELFF' end) as cdr3_aa,
  case when l_linenumber = 5 then 'TGTGCC' else null end as cdr3_nt,
  case when l_linenumber = 7 then null else concat(case when n % 2 = 0 then 'TRAV' else 'TRBV' end, {_str('l_suppkey % 12 + 1')},
    case when l_suppkey % 5 = 0 then '*01' else '-1' end) end as v_gene,
  case when l_linenumber = 6 then null else concat(case when n % 2 = 0 then 'TRAJ' else 'TRBJ' end, {_str('l_suppkey % 7 + 1')}) end as j_gene,
  case when l_partkey % 11 = 0 then null else {_digits('100000 + l_partkey % 50', 'GILFVTLMAK')} end as epitope_aa,
  case when l_partkey % 13 = 0 then null else concat('antigen ', {_str('l_partkey % 17')}) end as antigen,
  case l_linenumber % 4 when 0 then 'HLA-A*02:01' when 1 then 'H2-Db' when 2 then 'HLA-B*07:02' else null end as mhc_a,
  case when l_linenumber = 3 then null when l_linenumber = 2 and l_suppkey % 4 = 0 then 'n/a'
    else {_str('cast(l_quantity as int) % 4')} end as score,
  l_orderkey * 1000 + n as src_row
from (select *, row_number() over (partition by l_orderkey
        order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as n from {{lineitem}}) li""",
    "ask": f"""
select s_suppkey as qid,
  concat('CAS', {_digits('s_suppkey * 21')}, case when s_suppkey % 2 = 0 then 'EQYF' else 'GELFF' end) as cdr3,
  concat('TRBV', {_str('s_suppkey % 12 + 1')}, case when s_suppkey % 5 = 0 then '*01' else '-1' end) as v_gene,
  concat('TRBJ', {_str('s_suppkey % 7 + 1')}) as j_gene,
  case when s_suppkey % 3 = 0 then 'mouse' else 'human' end as species,
  case s_suppkey % 4 when 0 then 'alpha' when 1 then 'beta' else null end as chain,
  concat('CAS', {_digits('s_suppkey * 14')}, 'EQYF') as cdr3_b,
  concat('TRAV', {_str('(s_suppkey + 1) % 12 + 1')}, '-1') as v_a
from {{supplier}}""",
    "germ": f"""
select case when p_size % 5 < 2 then 'mouse' else 'human' end as species, case p_partkey % 2 when 0 then 'TRA' else 'TRB' end as chain,
  'V' as segment, concat(case p_partkey % 2 when 0 then 'TRAV' else 'TRBV' end, {_str('p_partkey % 12 + 1')},
    case when p_size % 2 = 0 then '-1' else '' end, '*0', {_str('p_size % 3 + 1')}) as allele,
  concat(case p_partkey % 2 when 0 then 'TRAV' else 'TRBV' end, {_str('p_partkey % 12 + 1')}, case when p_size % 2 = 0 then '-1' else '' end) as gene,
  case when p_partkey % 7 = 0 then {_bases('p_partkey')} else concat({_bases('p_partkey')}, 'TGTGCC') end as nt, p_partkey as ord from {{part}}
union all
select case when p_size % 5 < 2 then 'mouse' else 'human' end, case p_partkey % 2 when 0 then 'TRA' else 'TRB' end,
  'J', concat(case p_partkey % 2 when 0 then 'TRAJ' else 'TRBJ' end, {_str('p_partkey % 7 + 1')}, '*0', {_str('p_size % 2 + 1')}),
  concat(case p_partkey % 2 when 0 then 'TRAJ' else 'TRBJ' end, {_str('p_partkey % 7 + 1')}),
  concat(substr({_bases('p_partkey')}, 1, cast(9 + p_partkey % 3 as int)), case p_size % 3 when 0 then 'GAGCAGTACTTC' when 1 then 'GGAGAGCTGTTCTTC'
    else 'CATCTTACT' end, case when p_partkey % 11 = 0 then 'CCCCCCAAG' else 'GGTCAAGGTACC' end), p_partkey from {{part}}
union all
select case when p_size % 5 < 2 then 'mouse' else 'human' end, case p_partkey % 2 when 0 then 'TRA' else 'TRB' end,
  'C', case p_partkey % 2 when 0 then 'TRAC*01' else 'TRBC1*01' end, case p_partkey % 2 when 0 then 'TRAC' else 'TRBC1' end,
  translate({_bases('p_partkey')}, 'ACGT', 'GTCA'), p_partkey from {{part}}""",
    "seqs": f"""
select o_orderkey as seq_id, substr({_bases('o_custkey')}, cast(o_orderkey % 10 + 1 as int), 50) as seq,
  case when o_orderkey % 3 = 0 then 'mouse' else 'human' end as species, o_orderkey % 4 = 0 as is_protein from {{orders}}""",
    "receptors": f"""
select c_custkey as seq_id, concat({_bases('c_custkey')}, 'TGTGCCAGCAGC', substr({_bases('c_custkey')}, 1, 9),
  case c_custkey % 2 when 0 then 'GAGCAGTACTTC' else 'GGAGAGCTGTTCTTC' end, 'GGTCAAGGTACC') as seq,
  case when c_custkey % 3 = 0 then 'mouse' else 'human' end as species from {{customer}}""",
    "sentences": f"""
select c_custkey as qid, concat(case c_custkey % 6 when 0 then 'souris ' when 1 then 'human TCR with CDR3 ' when 2 then 'similar to '
    when 3 then 'HLA exon for Homo sapiens ' when 4 then '' else 'vdjdb epitope ' end,
  case c_custkey % 5 when 0 then '' when 1 then concat('iedb:', {_str('c_custkey')}, ' ')
    else concat('CAS', {_digits('c_custkey * 7')}, 'EQYF, ') end,
  case c_custkey % 4 when 0 then concat('TRBV', {_str('c_custkey % 12 + 1')}, '-1;') when 1 then 'trbj2-7 TRAV1' when 2 then '' else 'ACGTACGTACGT' end) as query,
  case when c_custkey % 7 = 0 then 'mouse' else null end as species from {{customer}}""",
    "cells": f"""
select l_orderkey * 1000 + n as rid, case l_linenumber % 5 when 0 then ' NA ' when 1 then '-' when 2 then concat('  ', l_returnflag, ' x ') when 3 then 'nan' else '' end as cell,
  case l_linenumber % 4 when 0 then 'Homo Sapiens' when 1 then 'MusMusculus' when 2 then ' Macaca mulatta' else null end as species,
  case l_linenumber % 4 when 0 then 'http://purl.obolibrary.org/obo/NCBITaxon_9606' when 1 then 'http://x.org/obo/NCBITaxon_10090/'
    when 2 then concat('http://x.org/Tax', l_returnflag) else 'na' end as iri,
  case l_linenumber % 4 when 0 then concat('PMID:', {_str('l_partkey')}) when 1 then concat('10.1000/', {_str('l_partkey')}) when 2 then 'unpublished' else concat('PMID', {_str('l_suppkey')}) end as ref,
  concat(case l_suppkey % 6 when 0 then 'trav' when 1 then 'TRBV' when 2 then 'TRGV' when 3 then 'TRDJ' when 4 then ' IGHV' else 'TRAC' end, {_str('l_suppkey % 12 + 1')},
    case when l_suppkey % 3 = 0 then '-DV9' else '-1' end, case when l_linenumber % 2 = 0 then '*02' else '' end) as gene
from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as n from {{lineitem}}) li""",
    "wide": f"""
select o_orderkey as row, case o_orderkey % 4 when 0 then 'NA' when 1 then '' else concat('cav', {_digits('o_custkey')}, 'f') end as CDR3_alpha_aa,
  case o_orderkey % 5 when 0 then '-' else concat(' CAS', {_digits('o_custkey * 3')}, 'YF ') end as CDR3_beta_aa,
  case o_orderkey % 3 when 0 then 'Human' else 'Mouse' end as Species, o_orderpriority as Pathology,
  concat('TRAV', {_str('o_custkey % 9 + 1')}) as TRAV, 'NA' as TRAJ, concat('trbv', {_str('o_custkey % 7 + 1')}) as TRBV, 'TRBD1' as TRBD, 'TRBJ1-1' as TRBJ,
  concat('PMID:', {_str('o_custkey')}) as PubMed_ID, 'HLA-A*02' as MHC from {{orders}}""",
    "slim": f"""
select r.src_row as row, case r.src_row % 4 when 0 then 'TRA' when 1 then 'trb' when 2 then ' TRB ' else 'TRG' end as gene,
  case r.src_row % 9 when 0 then 'NA' when 1 then '' when 2 then concat(' ', lower(r.cdr3_aa)) else r.cdr3_aa end as cdr3, r.v_gene as v, lower(r.j_gene) as j,
  case r.src_row % 3 when 0 then 'HomoSapiens' when 1 then 'MusMusculus' else 'Macaca Mulatta' end as species, r.epitope_aa, r.antigen, r.mhc_a,
  case r.src_row % 5 when 0 then '0' when 1 then '' else {_str('r.src_row % 1000')} end as complex_id,
  case r.src_row % 3 when 0 then concat('PMID:', {_str('r.src_row')}) when 1 then 'https://x.org/y' else concat('10.1/', {_str('r.src_row')}) end as reference, r.score from (<rec>) r""",
    "complexes": f"""
select o_orderkey as row, case when o_orderkey % 11 = 0 then '' else concat('P', {_str('o_custkey % 500')}) end as pdb_id, case o_orderkey % 2 when 0 then 'Human' else 'mouse' end as organism,
  case o_orderkey % 4 when 0 then '-' else concat('CAV', {_digits('o_custkey')}, 'F') end as a3, concat('CAS', {_digits('o_custkey * 3')}, 'YF') as b3,
  case o_orderkey % 3 when 0 then 'NA' else 'AVSG' end as a1, case o_orderkey % 5 when 0 then '' else 'LGHN' end as b1, case o_orderkey % 7 when 0 then 'nan' else 'YNNK' end as b2,
  concat('TRAV', {_str('o_custkey % 9 + 1')}) as av, concat('trbv', {_str('o_custkey % 7 + 1')}) as bv, concat('PMID', {_str('o_custkey')}) as pubmed from {{orders}}""",
    "fills": f"""
select c_custkey as row, concat('P', {_str('c_custkey % 400')}) as pdb_id, case c_custkey % 4 when 0 then 'ALPHA' when 1 then 'beta' when 2 then 'gamma' else 'Alpha' end as kind,
  concat('F', {_digits('c_custkey')}) as c1, case c_custkey % 6 when 0 then 'NA' else concat('G', {_digits('c_custkey * 7')}) end as c2 from {{customer}}""",
    "paired_cells": f"""
select o_orderkey as n, case when o_orderkey % 13 = 0 then '' else {_str('o_custkey')} end as receptor, concat('GIL', {_digits('o_custkey')}) as epitope, case o_orderkey % 3 when 0 then 'NA' else concat('source "', o_orderstatus, '"') end as antigen,
  case o_orderkey % 4 when 0 then '' else concat('TRAV', {_str('o_custkey % 9 + 1')}) end as v1, concat('trav', {_str('o_custkey % 5 + 1')}) as w1,
  case o_orderkey % 5 when 0 then '-' else concat('CAV', {_digits('o_custkey')}, 'F') end as c1, concat('CAG', {_digits('o_custkey * 3')}, 'F') as d1,
  case o_orderkey % 6 when 0 then 'IGHV1' else concat('TRBV', {_str('o_custkey % 7 + 1')}) end as v2, concat(' cas', {_digits('o_custkey * 7')}, 'yf') as c2,
  case o_orderkey % 3 when 0 then 'http://x.org/obo/NCBITaxon_9606' when 1 then 'http://x.org/obo/NCBITaxon_10090' else '' end as iri from {{orders}}""",
    "payloads": f"""
select p_partkey as ord, p_size % 3 as kind, concat('{{{{"accession":"A', {_str('p_partkey')}, '","name":"', case p_size % 3 when 0 then 'A*01:' when 1 then 'HLA-B*07:' else 'Mamu-A1*' end, {_str('p_size')}, '","class":"',
  case p_size % 2 when 0 then 'I' else 'II' end, '","locus":"L', {_str('p_size')}, '","sequence":{{{{"coding":"', {_bases('p_partkey')}, '","protein":"', translate({_bases('p_partkey')}, 'ACGT', 'MKVL'), '"}}}},"organism":{{{{"commonName":"',
  case p_size % 4 when 0 then 'Human' else 'Rhesus' end, '"}}}}}}}}') as value from {{part}}""",
    "labelled": """
select r.cdr3_aa as cdr3_b_aa, r.v_gene as v_b_gene, r.j_gene as j_b_gene, r.epitope_aa, r.mhc_a, r.antigen, r.src_row % 97 as cluster_id,
  l.quality as label, r.src_row from (<rec>) r join {labels} l on cast(floor(r.src_row / 1000) as bigint) % 997 = l.doc_id""",
    "loops": f"""
select species as organism, allele as id, 'V' as region, concat({_digits('ord', 'DEFGHIKLMN')}, substr('ACDEFGHIKL', 1, cast(ord % 3 + 3 as int)), ';',
  {_digits('ord * 3', 'QRSTVWYACD')}, 'G.S;P', {_digits('ord * 7', 'QRSTVWYACD')}) as cdrs from (<germ>) g where segment = 'V' and ord % 6 <> 5""",
    "requests": "select event_id, cast(user_id as varchar(20)) as key, ts from {events}",
    "texts": f"select doc_id, concat(text, ' ', substr({_bases('doc_id')}, 1, 20), ' and ', lower(substr({_bases('doc_id + 7')}, 1, cast(8 + doc_id % 9 as int)))) as value from {{documents}}",
    "uploads": f"""
select p_partkey as ord, p_brand as gene_name, concat(p_brand, '*', {_str('p_size')}) as allele_name, p_type as region,
  case when p_size % 4 = 0 then 'human' when p_size % 4 = 1 then 'other' else null end as species, {_bases('p_partkey')} as sequence from {{part}}""",
}


def text(name: str, spark: bool = False) -> str:
    body = VIEWS[name]
    for inner in ("rec", "germ"):
        body = body.replace(f"<{inner}>", VIEWS[inner])
    return body if spark else body.format(**{t: t for t in TABLES})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    body = text(name, spark=True)
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in body}
    return spark.sql(body, **used)
