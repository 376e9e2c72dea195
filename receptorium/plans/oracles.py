"""SQL for the named queries, written from the operator rules; runs on the generic test tables."""

from __future__ import annotations

from itertools import product

from receptorium.constants import (
    AMINO_BY_CODON, BACK_CODON, BASE_ORDER, BLOSUM62, CONSTANT_REGIONS, DEDUP_KEY, IEDB_WORDS, MHC_PROJECT_PREFIXES, MHC_WORDS,
    REGION_WORDS, SIMILAR_WORDS, TCR_WORDS, VDJDB_WORDS,
)
from receptorium.operators.lookup import NO_PAIR_MESSAGE  # noqa: F401
from receptorium.plans import alignment_sql, bridge

ORACLES: dict[str, str] = {}


def oracle(name: str, views: str, body: str, **ctes: str) -> None:
    parts = [f"{v} as ({bridge.text(v)})" for v in views.split()] + [f"{k} as ({v})" for k, v in ctes.items()]
    ORACLES[name] = (f"with {', '.join(parts)} " if parts else "") + body


# --- shared expressions --------------------------------------------------------------------------------

CODONS = "MAP {" + ", ".join(f"'{''.join(c)}': '{a}'" for c, a in zip(product(BASE_ORDER, repeat=3), AMINO_BY_CODON)) + "}"
BACK = "MAP {" + ", ".join(f"'{a}': '{c}'" for a, c in BACK_CODON.items()) + "}"


def aa(nt: str, frame: int | str = 0) -> str:
    return (f"array_to_string(list_transform(range(0, greatest(length({nt}) - {frame}, 0) // 3), "
            f"lambda i: coalesce({CODONS}[substr({nt}, {frame} + i * 3 + 1, 3)], '?')), '')")


def back(s: str) -> str:
    return f"array_to_string(list_transform(range(1, length({s}) + 1), lambda i: coalesce({BACK}[substr({s}, i, 1)], 'NNN')), '')"


def stops(a: str, ch: str = "*") -> str:
    return f"(length({a}) - length(replace({a}, '{ch}', '')))"


def base(g: str) -> str:
    return f"coalesce(split_part(upper(trim({g})), '*', 1), '')"


def chain(g: str) -> str:
    h = f"substr(upper(split_part(trim({g}, '*'), '*', 1)), 1, 4)"
    return f"case when {h} in ('TRAV','TRAJ') then 'TRA' when {h} in ('TRGV','TRGJ') then 'TRG' when {h} in ('TRDV','TRDJ') then 'TRD' else 'TRB' end"


def label(code: str) -> str:
    return f"case {code} when 'TRA' then 'alpha' when 'TRB' then 'beta' when 'TRG' then 'gamma' when 'TRD' then 'delta' end"


ORGANISM = "case when upper(trim(mhc_a)) like 'HLA%' then 'human' when upper(trim(mhc_a)) like 'H2%' or upper(trim(mhc_a)) like 'H-2%' then 'mouse' end"
SCORE = "coalesce(try_cast(score as double), '-infinity'::double)"
LETTERS = "ARNDCQEGHILKMFPSTWYV"
_ROWS = [[int(v) for v in line.split()] for line in BLOSUM62.strip().splitlines()]


def _sub(i: int, j: int) -> int:
    return _ROWS[max(i, j)][min(i, j)]


COST = "[" + ",".join(str(_sub(i, i) - _sub(i, j)) for i in range(20) for j in range(20)) + "]"
TLETTERS = LETTERS + "."
TCOST = "[" + ",".join(str(0 if i == j else 4 if 20 in (i, j) else min(4, 4 - _sub(i, j))) for i in range(21) for j in range(21)) + "]"


def _pick(table: str, letters: str, x: str, y: str) -> str:
    return f"{table}[(strpos('{letters}', {x}) - 1) * {len(letters)} + strpos('{letters}', {y})]"


def blosum(q: str, c: str) -> str:
    """Distance of query q to candidate c (columns)."""
    tq, tc = (f"coalesce(nullif(substr({s}, 4, greatest(length({s}) - 5, 0)), ''), {s})" for s in (q, c))
    short, long_ = f"(case when length({tq}) <= length({tc}) then {tq} else {tc} end)", f"(case when length({tq}) <= length({tc}) then {tc} else {tq} end)"
    gap = f"abs(length({q}) - length({c}))"
    cell = _pick(COST, LETTERS, f"substr({short}, i, 1)", f"substr({long_}, i + o, 1)")
    return (f"cast(list_min(list_transform(range(0, length({long_}) - length({short}) + 1), lambda o: coalesce(list_sum(list_transform("
            f"range(1, length({short}) + 1), lambda i: {cell})), 0))) + 8 * {gap} as double)")


def tcr(a: str, b: str, trim_n: int, trim_c: int, fixed: bool) -> str:
    la, lb, sh = f"length({a})", f"length({b})", f"least(length({a}), length({b}))"
    cell = lambda x, y: _pick(TCOST, TLETTERS, f"substr({a}, {x}, 1)", f"substr({b}, {y}, 1)")
    equal = f"coalesce(list_sum(list_transform(range({trim_n} + 1, {la} - {trim_c} + 1), lambda i: {cell('i', 'i')})), 0)"
    widen = f"cast(greatest(ceil((10 - {sh}) / 2.0), 0) as int)"
    lo, hi = (f"cast(least(6, 3 + floor(({sh} - 5) / 2.0)) as int)",) * 2 if fixed else (f"(5 - {widen})", f"({sh} - 5 + {widen})")
    left = f"coalesce(list_sum(list_transform(range({trim_n} + 1, g + 1), lambda i: {cell('i', 'i')})), 0)"
    right = f"coalesce(list_sum(list_transform(range({trim_c}, {sh} - g), lambda i: {cell(f'{la} - i', f'{lb} - i')})), 0)"
    return (f"cast(case when {la} = {lb} then {equal} else list_min(list_transform(range({lo}, {hi} + 1), lambda g: {left} + {right})) "
            f"+ 4 * abs({la} - {lb}) end as double)")


# --- index build ------------------------------------------------------------------------------------------

DEDUP = f"select * from (select *, row_number() over (partition by {', '.join(DEDUP_KEY)} order by src_row) as rn from rec) x where rn = 1"
oracle("index_dedup", "rec", f"select {', '.join(DEDUP_KEY)}, source_record_id from d", d=DEDUP)
oracle("source_counts", "rec", "select source, count(*) as n_rows from d group by 1", d=DEDUP)
oracle("index_metadata", "rec", "select cast(sum(n) as bigint) as rows_total, '1998-01-01' as built_at, 'b1' as build_id, "
       "string_agg(source || '=' || n, ',' order by source) as per_source from c", d=DEDUP, c="select source, count(*) as n from d group by 1")
oracle("index_age", "", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as built_at, date_diff('day', cast(o_orderdate as date), date '1998-08-01') as age_days, "
       "date_diff('day', cast(o_orderdate as date), date '1998-08-01') > 365 as is_stale from orders")
oracle("refresh_guard", "", "select false as build, 'partial download; kept the existing index' as reason, "
       "(count(*) filter (where n_nationkey % 7 <> 0)) = count(*) as complete from nation")


def clean(x: str) -> str:
    return f"case when lower(trim({x})) not in ('', 'na', 'nan', '-') then trim({x}) end"


oracle("wide_to_long", "wide", f"""
select 'mcpas:' || row as source_record_id, 'mcpas:' || row as pairing_key, lower(Species) as species, chain, upper(cdr3) as cdr3_aa,
  upper({clean('v')}) as v_gene, d as d_gene, upper({clean('j')}) as j_gene, Pathology as antigen_organism, MHC as mhc_a,
  replace(PubMed_ID, 'PMID:', '') as reference_pmid, 'https://friedmanlab.weizmann.ac.il/McPAS-TCR/' as external_url, row * 2 + pos as src_row
from l where cdr3 is not null""", l=f"""
select row, Species, Pathology, PubMed_ID, MHC, 'alpha' as chain, 0 as pos, {clean('CDR3_alpha_aa')} as cdr3, TRAV as v, null as d, TRAJ as j from wide
union all select row, Species, Pathology, PubMed_ID, MHC, 'beta', 1, {clean('CDR3_beta_aa')}, TRBV, TRBD, TRBJ from wide""")
_NAME = "case replace(lower(trim({x})), ' ', '') when 'homosapiens' then 'human' when 'musmusculus' then 'mouse' else replace(lower(trim({x})), ' ', '') end"
oracle("vdjdb_rows", "slim", f"""select 'vdjdb' as source, 'vdjdb:' || row as source_record_id, case when cx is null or cx = '0' then 'vdjdb:u' || row else 'vdjdb:c' || cx end as pairing_key,
  {_NAME.format(x='species')} as species, case upper(trim(gene)) when 'TRA' then 'alpha' else 'beta' end as chain, upper(s) as cdr3_aa, upper(v) as v_gene, upper(j) as j_gene, epitope_aa, antigen,
  mhc_a, case when regexp_matches(ref, '^[0-9]+$') or (ref like '10.%' and contains(ref, '/')) then ref end as reference_pmid, 'https://vdjdb.cdr3.net/search' as external_url,
  {clean('score')} as score, row as src_row
  from (select *, {clean('cdr3')} as s, {clean('complex_id')} as cx, replace(trim(reference), 'PMID:', '') as ref from slim) x where s is not null and upper(trim(gene)) in ('TRA', 'TRB')""")
oracle("tcr3d_rows", "complexes fills", f"""select 'tcr3d:' || id || ':' || chain as source_record_id, 'tcr3d:' || id as pairing_key, lower(organism) as species, chain, upper(c3) as cdr3_aa, upper(v) as v_gene,
  coalesce(own1, f1) as cdr1_aa, coalesce(own2, f2) as cdr2_aa, replace(pubmed, 'PMID', '') as reference_pmid, 'https://www.rcsb.org/structure/' || id as external_url, row * 2 + pos as src_row
  from l left join last on last.pdb_id = l.id and last.of = l.chain and last.k = 1 where c3 is not null and id is not null""",
       last=f"select pdb_id, lower(kind) as of, {clean('c1')} as f1, {clean('c2')} as f2, row_number() over (partition by pdb_id, lower(kind) order by row desc) as k from fills",
       l=f"select row, {clean('pdb_id')} as id, organism, pubmed, 'alpha' as chain, 0 as pos, {clean('a3')} as c3, av as v, {clean('a1')} as own1, null as own2 from complexes "
         f"union all select row, {clean('pdb_id')}, organism, pubmed, 'beta', 1, {clean('b3')}, bv, {clean('b1')}, {clean('b2')} from complexes")
oracle("iedb_rows", "paired_cells", f"""select 'iedb' as source, 'iedb:' || id as source_record_id, 'iedb:' || id as pairing_key,
  case when iri = '' then '' when iri like '%9606' then 'human' else 'mouse' end as species, chain, upper(trim(cdr3)) as cdr3_aa, upper(v) as v_gene, epitope as epitope_aa, {clean('antigen')} as antigen,
  'https://www.iedb.org/receptor/' || id as external_url from l where id is not null and chain is not null and cdr3 is not null""",
       l=f"select {clean('receptor')} as id, epitope, antigen, iri, 'alpha' as chain, coalesce({clean('c1')}, {clean('d1')}) as cdr3, coalesce({clean('v1')}, {clean('w1')}) as v from paired_cells "
         f"union all select {clean('receptor')}, epitope, antigen, iri, case when v2 like 'TRB%' then 'beta' end, {clean('c2')}, v2 from paired_cells")
oracle("germline_scan", "germ", "select species, chain, segment, allele, split_part(allele, '*', 1) as gene, nt from germ")
oracle("alphabets", "seqs", """select seq_id, case when seq_id % 3 = 0 or seq_id % 7 = 0 then 'nucleotide' when seq_id % 5 = 0 or seq_id % 11 = 0 then 'amino_acid' else 'nucleotide' end as kind,
  case seq_id % 4 when 0 then 'TRA' when 1 then 'TRB' end as chain from seqs""")
oracle("allele_payloads", "payloads", """select case kind when 0 then 'hla' else 'mhc' end as source, case when kind < 2 or contains(value, '"commonName":"Human"') then 'human' else 'other' end as species,
  case kind when 0 then 'HLA-A' when 1 then 'HLA-B' else 'Mamu-A1' end as gene_name, value ->> '$.name' as allele_name, 'coding' as region, value ->> '$.sequence.coding' as sequence,
  value ->> '$.accession' as accession, case kind when 0 then 'ebi-imgt-hla' else 'ebi-ipd-mhc' end as backend, left(value ->> '$.sequence.protein', case kind when 0 then 60 else 80 end) as protein_seq
  from (select kind, cast(value as json) as value from (select kind, value from payloads) y) x""".replace("contains(value,", "contains(cast(value as varchar),"))
LABELLED_KEPT = """select * from (select *, row_number() over (partition by cdr3_b_aa, v_b_gene, j_b_gene, epitope_aa, mhc_a order by src_row) as rn
  from labelled where label = 1 and cdr3_b_aa is not null and v_b_gene is not null and j_b_gene is not null and epitope_aa is not null) x where rn = 1"""
oracle("labelled_positives", "labelled", "select cdr3_b_aa, v_b_gene, j_b_gene, epitope_aa, mhc_a, antigen, cluster_id from k", k=LABELLED_KEPT)
oracle("label_counts", "labelled", "select (select count(*) from labelled) as rows_total, (select count(*) from labelled where label = 0) as rows_dropped_negative, "
       "(select count(*) from k) as rows_kept", k=LABELLED_KEPT)

# --- fields ---------------------------------------------------------------------------------------------------

oracle("na_species_norm", "cells", f"""select rid, {clean('cell')} as cell,
  case k when 'homosapiens' then 'human' when 'musmusculus' then 'mouse' else k end as species
  from (select *, replace(lower(trim(coalesce(species, ''))), ' ', '') as k from cells) x""")
oracle("taxon_species", "cells", """select rid, case when t is null then '' when tax = '9606' then 'human' when tax = '10090' then 'mouse' else lower(t) end as species
  from (select rid, t, string_split(t, '_')[-1] as tax from (select rid, case when lower(trim(iri)) not in ('', 'na', 'nan', '-')
    then string_split(rtrim(trim(iri), '/'), '/')[-1] end as t from cells) y) x""")
oracle("gene_parts", "cells", f"""select rid, upper(trim(gene)) as symbol, {base('gene')} as base, {chain('gene')} as chain,
  case when length(u) >= 4 and substr(u, 1, 3) in ('TRA','TRB','TRG','TRD') then {label('c')} end as strict_label,
  case when substr(u, 1, 3) in ('TRA','TRB') then {label('c')} end as alpha_beta,
  case when length(u) >= 4 and u like 'TR%' and substr(u, 4, 1) in ('V','D','J','C') then substr(u, 4, 1) end as segment,
  split_part(split_part(gene, '*', 1), '-', 1) as family, regexp_replace({base('gene')}, '-DV([0-9])', '/DV\\1', 'g') as germline_gene
  from (select *, upper(trim(gene)) as u, {chain('upper(trim(gene))')} as c from cells) x""")
oracle("reference_ids", "cells", r"""select rid, case when regexp_matches(s, '^[0-9]+$') or (lower(s) like '10.%' and contains(s, '/')) then s end as ref
  from (select rid, trim(replace(replace(trim(ref), 'PMID:', ''), 'PMID', '')) as s from cells) x""")
oracle("mhc_cross_species", "rec", f"select src_row, {ORGANISM} as organism, coalesce({ORGANISM} <> lower(trim(species)), false) as cross_species from rec")
oracle("score_rank_topk", "rec", f"""select cdr3_aa, rank, source_record_id from (select *, row_number() over (partition by cdr3_aa
  order by {SCORE} desc, source, src_row) as rank from rec) x where rank <= 10""")
oracle("nonstandard_residues", "", "select c_custkey, coalesce(array_to_string(list_sort(list_distinct(list_filter(string_split(upper(concat(c_name, c_mktsegment)), ''), "
       "lambda x: not contains('ACDEFGHIKLMNPQRSTVWY', x)))), ','), '') as letters from customer")


def classify(q: str, extra: str) -> str:
    """Subquery text: ``extra`` columns plus kind, norm, id_source, code of column q of table src."""
    return f"""select {extra}, case when is_id then 'id' when is_gene and contains(t, '*') then 'allele' when is_gene then 'gene_name' when okay and aaonly then 'raw_aa'
      when okay and frac >= 0.9 then 'raw_nt' when okay then 'raw_aa' else 'unknown' end as kind,
    case when is_id then t when is_gene then upper(t) when okay then s else t end as norm, case when is_id then lower(split_part(t, ':', 1)) end as id_source,
    case when is_id or is_gene then null when okay and not aaonly and frac < 0.9 then 'ambiguous_alphabet' when not okay then 'unresolved_input_type' end as code
  from (select *, regexp_matches(t, '(?i)^(vdjdb|iedb):\\w+$') as is_id, regexp_matches(t, '(?i)^TR[ABGD][VDJC][0-9]+(-[0-9]+)?(\\*[0-9]+)?$') as is_gene,
    regexp_matches(s, '^[ACDEFGHIKLMNPQRSTVWYZX*]+$') as okay, regexp_matches(s, '[EFILPQZX*]') as aaonly,
    length(regexp_replace(s, '[^ACGT]', '', 'g')) / nullif(length(s), 0) as frac
    from (select *, trim({q}) as t, replace(upper(trim({q})), ' ', '') as s from src) a) b"""


oracle("query_echo", "sentences", "select qid, case when length(query) <= 40 then query end as value, case when length(query) > 40 then length(query) end as length, "
       "case when length(query) > 40 then sha256(query) end as sha256, kind as detected_type from c", src="select * from sentences", c=classify("query", "qid, query"))
oracle("allele_routing", "", f"""select p_partkey, case when lower(g) = 'hla-a' then 'A' else replace(upper(g), 'HLA-', '') end as locus,
  case when regexp_matches(replace(replace(lower(g), '-', ''), '_', ''), '^({'|'.join(MHC_PROJECT_PREFIXES)})') then 'MHC'
    when upper(g) like 'HLA%' or (length(g) <= 5 and contains(g, '*')) then 'HLA' else 'MHC' end as project,
  case when upper(g) like 'HLA-%' then substr(g, 5) else g end as prefix
  from (select p_partkey, case p_partkey % 4 when 0 then 'HLA-A' when 1 then concat('Mamu-', p_brand) when 2 then 'B*07' else p_brand end as g from part) x""")

# --- lookup ----------------------------------------------------------------------------------------------------

IX = f"select *, upper(cdr3_aa) as ic, {base('v_gene')} as iv, {base('j_gene')} as ij, {ORGANISM} as org, {SCORE} as sc from rec"
SCOPE = "(q.species is null or (ix.species = q.species and (ix.org is null or ix.org = q.species)))"
REQ = f"""select qid, case when qid % 4 < 3 then upper(cdr3) end as ck, case when qid % 4 >= 2 then {base('v_gene')} end as vk,
  case when qid % 4 = 3 then {base('j_gene')} end as jk, case when qid % 4 <> 1 then species end as species from ask"""
HITS = f"""select q.qid, q.species as qs, ix.* from q join ix on (q.ck is null or ix.ic = q.ck) and (q.vk is null or ix.iv = q.vk) and (q.jk is null or ix.ij = q.jk) and {SCOPE}"""
oracle("exact_lookup", "rec ask", """
select t.qid, t.rank, t.source_record_id, try_cast(t.score as double) as score, n.concordance, s.total_exact, s.total_matches
from t join n on n.ic = t.ic and n.qs is not distinct from t.qs join s on s.qid = t.qid""",
       ix=IX, q=REQ, h=HITS, t="select * from (select *, row_number() over (partition by qid order by sc desc, source, src_row) as rank from h) z where rank <= 20",
       s="select h.qid, count(*) as total_matches, least(count(*), 20) as total_exact from h group by 1",
       n=f"select k.ic, k.qs, count(distinct ix.source) as concordance from (select distinct ic, qs, qs as species from t) k join ix on ix.ic = k.ic "
         f"and (k.species is null or (ix.species = k.species and (ix.org is null or ix.org = k.species))) group by 1, 2")
oracle("text_lookup", "rec ask", """select t.qid, t.rank, t.source_record_id, s.total_exact, s.total_matches from t join s on s.qid = t.qid""", ix=IX,
       q=f"select qid, upper(cdr3) as ck, case when qid % 3 = 0 then {base('v_gene')} end as vk, null::varchar as jk, species from ask", h=HITS,
       t="select * from (select *, row_number() over (partition by qid order by sc desc, source, src_row) as rank from h) z where rank <= 20",
       s="select h.qid, count(*) as total_matches, least(count(*), 20) as total_exact from h group by 1")
oracle("id_lookup", "rec", "select o.o_orderkey as qid, r.source_record_id, r.cdr3_aa, r.species from orders o join rec r on r.source_record_id = 'r:' || o.o_orderkey || ':1'")
oracle("concordance", "rec", "select upper(cdr3_aa) as cdr3_key, greatest(count(distinct source), 1) as concordance from rec group by 1")
oracle("sources_searched", "rec", "select string_agg(source, ',' order by source) as sources from (select distinct source from rec) x")
VJ = f"""select c.cdr3_aa, c.species, {base('v_gene')} as v, {base('j_gene')} as j, count(*) as n from rec c
  where {base('v_gene')} <> '' and {base('j_gene')} <> '' group by all"""
oracle("infer_vj", "rec", f"""select cdr3_aa || '/' || species as qid, rank, {label("substr(v, 1, 3)")} as chain, v as v_gene, j as j_gene, n as count
  from (select *, row_number() over (partition by cdr3_aa, species order by n desc, v, j) as rank from vj) x where rank <= 5""", vj=VJ)
PAIRED = """select a.species, a.pairing_key, a.cdr3_aa as cdr3_a_aa, a.v_gene as v_a_gene, b.cdr3_aa as cdr3_b_aa, b.v_gene as v_b_gene,
  coalesce(b.epitope_aa, a.epitope_aa) as epitope_aa, coalesce(b.antigen, a.antigen) as antigen, coalesce(b.mhc_a, a.mhc_a) as mhc_a, a.src_row
  from f a join f b on a.species = b.species and a.pairing_key = b.pairing_key where a.chain = 'alpha' and b.chain = 'beta'"""
FIRST = "select * from (select *, row_number() over (partition by species, pairing_key, chain order by src_row) as rn from rec where pairing_key is not null and cdr3_aa is not null) x where rn = 1"
oracle("paired_reference", "rec", "select species, pairing_key, cdr3_a_aa, v_a_gene, cdr3_b_aa, v_b_gene, epitope_aa, antigen, mhc_a from p", f=FIRST, p=PAIRED)
oracle("pair_query", "rec", """
select a.qid, a.pairing_key, a.source, case a.chain when 'alpha' then a.source_record_id else b.source_record_id end as alpha_record_id,
  case a.chain when 'beta' then a.source_record_id else b.source_record_id end as beta_record_id
from a join ix b on a.pairing_key = b.pairing_key and b.ic = a.b_cdr3 and b.species = a.species and (b.org is null or b.org = a.species) and a.chain <> b.chain""",
       f=FIRST, p=PAIRED, ix=IX, q="select pairing_key as qid, cdr3_a_aa, cdr3_b_aa, species from (select *, row_number() over (partition by species, v_a_gene, v_b_gene order by pairing_key) as k from p) x where k = 1",
       a="select * from (select q.qid, q.cdr3_b_aa as b_cdr3, ix.*, row_number() over (partition by q.qid order by ix.sc desc, ix.source, ix.src_row) as rank "
         "from q join ix on ix.ic = q.cdr3_a_aa and ix.species = q.species and (ix.org is null or ix.org = q.species)) z where rank <= 500")
oracle("no_pair_warning", "rec ask", """
select q.qid, 'no_pairing_found' as code, 'pairs' as block, (select count(*) from ix where ix.ic = q.cdr3_b) as n_second, (select count(*) from a where a.qid = q.qid) as n_first
from ask q where not exists (select 1 from a join ix b on a.pairing_key = b.pairing_key and b.ic = q.cdr3_b and a.chain <> b.chain where a.qid = q.qid)""",
       ix=IX, a="select * from (select q.qid, ix.*, row_number() over (partition by q.qid order by ix.sc desc, ix.source, ix.src_row) as rank from ask q join ix on ix.ic = q.cdr3) z where rank <= 500")
_BAD = ("list_sort(list_distinct(list_filter(string_split(upper(seq), ''), lambda x: not contains('ACDEFGHIKLMNPQRSTVWY', x))))")
oracle("warnings_log", "", f"""select qid, 'nonstandard_residues' as code, 'records' as block, label || ' has letters outside the standard residues: ' || array_to_string(bad, ', ')
  || '; matches may be incomplete.' as message from (select *, {_BAD} as bad from s) x where len(bad) > 0""",
       s="select c_custkey as qid, 'cdr3' as label, concat(c_mktsegment, 'ASS') as seq from customer union all select c_custkey, 'cdr3_b', c_name from customer")

# --- similarity ---------------------------------------------------------------------------------------------------

oracle("blosum_distance", "rec", f"select *, {blosum('cdr3_a_aa', 'cdr3_b_aa')} as distance from (select distinct cdr3_a_aa, cdr3_b_aa from p) x", f=FIRST, p=PAIRED)
PAIR_D = f"select q, c, {blosum('q', 'c')} as d from (select q, c from (select distinct cdr3 as q from ask) a, (select distinct cdr3_aa as c from rec) b) x"
oracle("neighbours_top25", "rec ask", """
select qid, rank, source_record_id, d as distance, round(1 - d / greatest(mx, 1), 4) as similarity
from (select *, max(d) over (partition by qid) as mx, row_number() over (partition by qid order by d, src_row) as rank from n) z where rank <= 25""",
       ix=IX, q="select qid, cdr3 as ck, case when qid % 2 = 0 then species end as species from ask",
       ch=f"select distinct q.qid, ix.chain from q join ix on ix.ic = q.ck and {SCOPE}", pd=PAIR_D,
       n=f"""select q.qid, ix.source_record_id, ix.src_row, pd.d from q join ix on {SCOPE} and ix.ic <> q.ck join pd on pd.q = q.ck and pd.c = ix.ic
         where not exists (select 1 from ch where ch.qid = q.qid) or exists (select 1 from ch where ch.qid = q.qid and ch.chain = ix.chain)""")


def family(g: str) -> str:
    return f"coalesce(split_part(split_part({g}, '*', 1), '-', 1), '')"


BLOCK = f"""select q.qid, q.cdr3, q.v_gene, q.species, r.* exclude (species, v_gene), r.v_gene as rv, {family('q.v_gene')} = {family('r.v_gene')} as fam
  from ask q join rec r on r.species = q.species and (q.chain is null or r.chain = q.chain)"""
CHOSEN = "select * from (select *, count(*) filter (where fam) over (partition by qid) as nf from b) x where nf < 5 or fam"
TOP10 = """select qid, rank, engine, cdr3_b_aa, distance, round(sim, 4) as similarity, src_row from (select *, row_number() over (partition by qid order by distance, src_row) as rank
  from (select *, 1 - distance / greatest(max(distance) over (partition by qid), 1) as sim from s) y where sim >= {cut}) z where rank <= {k}"""
oracle("similar_blosum", "rec ask", TOP10.format(cut=0.5, k=10), pd=PAIR_D, b=BLOCK, c=CHOSEN,
       s="select c.qid, 'blosum_cdr3' as engine, c.cdr3_aa as cdr3_b_aa, pd.d as distance, c.src_row from c join pd on pd.q = c.cdr3 and pd.c = c.cdr3_aa")
oracle("similar_labelled", "labelled ask", """select qid, rank, cdr3_b_aa, distance, round(sim, 4) as similarity, cluster_id, src_row from (select *, row_number() over (partition by qid order by distance, src_row) as rank
  from (select *, 1 - distance / greatest(max(distance) over (partition by qid), 1) as sim from s) y) z where rank <= 5""",
       k=LABELLED_KEPT, b=f"select q.qid, q.cdr3, k.*, {family('q.v_gene')} = {family('k.v_b_gene')} as fam from ask q, k where q.species = 'human'", c=CHOSEN,
       pd=f"select q, c, {blosum('q', 'c')} as d from (select q, c from (select distinct cdr3 as q from ask) a, (select distinct cdr3_b_aa as c from k) b) x",
       s="select c.*, pd.d as distance from c join pd on pd.q = c.cdr3 and pd.c = c.cdr3_b_aa")
oracle("family_block_counts", "rec ask", f"""select q.qid, case when nf >= 5 then {family('q.v_gene')} else '*' end as family, case when nf >= 5 then nf else coalesce(na, 0) end as total_candidates
  from ask q left join (select qid, count(*) filter (where fam) as nf, count(*) as na from b group by 1) n on n.qid = q.qid""", b=BLOCK)
LT = """select lower(organism) as organism, id, string_split(cdrs, ';')[1] as cdr1, string_split(cdrs, ';')[2] as cdr2, string_split(cdrs, ';')[3] as cdr25
  from (select organism, id, min(cdrs) as cdrs from loops group by 1, 2) x where len(string_split(cdrs, ';')) >= 3"""
oracle("loop_table", "loops", "select * from lt", lt=LT)
LOOPS = ("cdr1", "cdr2", "cdr25")


def loops_of(table: str, gene: str, species: str, tag: str) -> str:
    pick = ", ".join(f"case when e{tag}.id is not null then e{tag}.{c} else g{tag}.{c} end as {tag}{c}" for c in LOOPS)
    joins = (f"left join lt e{tag} on e{tag}.organism = {table}.{species} and e{tag}.id = {table}.{gene} "
             f"left join lt g{tag} on g{tag}.organism = {table}.{species} and g{tag}.id = split_part({table}.{gene}, '*', 1) || '*01'")
    return pick + "@" + joins


def with_loops(source: str, gene: str, species: str, tag: str) -> str:
    pick, joins = loops_of("t", gene, species, tag).split("@")
    return f"select t.*, {pick} from {source} t {joins}"


PAIR_T = f"select q, c, {tcr('q', 'c', 3, 2, False)} * 3 as d from (select q, c from (select distinct cdr3 as q from ask) a, (select distinct cdr3_aa as c from rec) b) x"
LOOP_T = "select x, y, {d} as d from (select a.s as x, b.s as y from (select cdr1 as s from lt union select cdr2 from lt union select cdr25 from lt) a, " \
         "(select cdr1 as s from lt union select cdr2 from lt union select cdr25 from lt) b) z".replace("{d}", tcr("x", "y", 0, 0, True))
TCR_STEPS = dict(lt=LT, b=BLOCK, c=CHOSEN, ql=with_loops("ask", "v_gene", "species", "q_"), rl=with_loops("rec", "v_gene", "species", "r_"),
                 u="select c.qid, c.cdr3, c.cdr3_aa, c.src_row, ql.q_cdr1, ql.q_cdr2, ql.q_cdr25, rl.r_cdr1, rl.r_cdr2, rl.r_cdr25 from c join ql on ql.qid = c.qid join rl on rl.src_row = c.src_row",
                 fit="select qid, bool_or(q_cdr1 is not null and r_cdr1 is not null) as fit, count(*) filter (where r_cdr1 is null) as n_skipped from u group by 1")
oracle("tcrdist_single", "rec ask loops", TOP10.format(cut=0, k=10), **TCR_STEPS, pt=PAIR_T, pd=PAIR_D, lp=LOOP_T,
       s="""select u.qid, 'tcrdist' as engine, u.cdr3_aa as cdr3_b_aa, pt.d + l1.d + l2.d + l3.d as distance, u.src_row from u join fit on fit.qid = u.qid and fit.fit
  join pt on pt.q = u.cdr3 and pt.c = u.cdr3_aa join lp l1 on l1.x = u.q_cdr1 and l1.y = u.r_cdr1 join lp l2 on l2.x = u.q_cdr2 and l2.y = u.r_cdr2
  join lp l3 on l3.x = u.q_cdr25 and l3.y = u.r_cdr25
  union all select u.qid, 'blosum_cdr3', u.cdr3_aa, pd.d, u.src_row from u join fit on fit.qid = u.qid and not fit.fit join pd on pd.q = u.cdr3 and pd.c = u.cdr3_aa""")
oracle("tcrdist_pairs", "ask loops", f"""select qid_1, qid_2, {tcr('q', 'c', 3, 2, False)} * 3 + {tcr('q_cdr1', 'r_cdr1', 0, 0, True)} + {tcr('q_cdr2', 'r_cdr2', 0, 0, True)} + {tcr('q_cdr25', 'r_cdr25', 0, 0, True)} as distance
  from two""", lt=LT, pair="select a.qid as qid_1, b.qid as qid_2, a.cdr3 as q, b.cdr3 as c, a.v_gene as v1, b.v_gene as v2, a.species from ask a join ask b on floor(b.qid / 2) = floor(a.qid / 2) + 1",
       one=with_loops("pair", "v1", "species", "q_"), two=with_loops("one", "v2", "species", "r_"))
oracle("tcrdist_skipped", "rec ask loops", """select qid, 'tcrdist_candidates_skipped' as code, cast(n_skipped as varchar) as n_skipped from fit where fit and n_skipped > 0
  union all select qid, 'tcrdist_unavailable', null from fit where not fit
  union all select qid, 'no_reference_candidates', null from ask where qid not in (select qid from fit)""", **TCR_STEPS)
oracle("tcrdist_paired", "rec ask loops", """select qid, rank, pairing_key, d as distance, round(1 - d / greatest(mx, 1), 4) as similarity
  from (select *, max(d) over (partition by qid) as mx, row_number() over (partition by qid order by d, src_row) as rank from s) z where rank <= 10""",
       lt=LT, f=FIRST, p=PAIRED, pa=with_loops("p", "v_a_gene", "species", "pa_"), pb=with_loops("pa", "v_b_gene", "species", "pb_"),
       qa=with_loops("ask", "v_a", "species", "qa_"), qb=with_loops("qa", "v_gene", "species", "qb_"),
       **{f"t{side}": f"select q, c, {tcr('q', 'c', 3, 2, False)} * 3 as d from (select q, c from (select distinct {cq} as q from qb where qa_cdr1 is not null and qb_cdr1 is not null) a, "
                      f"(select distinct {cp} as c from pb where pa_cdr1 is not null and pb_cdr1 is not null) b) x" for side, cq, cp in (("a", "cdr3_b", "cdr3_a_aa"), ("b", "cdr3", "cdr3_b_aa"))},
       **{f"l{side}": f"select a.*, b.*, " + " + ".join(tcr(f"q{side}_{c}", f"p{side}_{c}", 0, 0, True) for c in LOOPS) + " as d from "
                      f"(select distinct q{side}_cdr1, q{side}_cdr2, q{side}_cdr25 from qb where q{side}_cdr1 is not null) a, (select distinct p{side}_cdr1, p{side}_cdr2, p{side}_cdr25 from pb where p{side}_cdr1 is not null) b"
          for side in "ab"},
       s="select qb.qid, pb.pairing_key, pb.src_row, ta.d + tb.d + la.d + lb.d as d from qb join pb on pb.species = qb.species "
         "join ta on ta.q = qb.cdr3_b and ta.c = pb.cdr3_a_aa join tb on tb.q = qb.cdr3 and tb.c = pb.cdr3_b_aa "
         + " ".join(f"join l{side} on " + " and ".join(f"l{side}.{o}{side}_{c} = {t}.{o}{side}_{c}" for o, t in (("q", "qb"), ("p", "pb")) for c in LOOPS) for side in "ab"))

# --- sequences and germline ------------------------------------------------------------------------------------

oracle("translate", "germ", f"select segment, ord, {aa('nt')} as aa0, {aa('nt', 1)} as aa1, {aa('nt', 2)} as aa2 from germ")
oracle("back_translate", "rec", f"select cdr3_aa, {back('s')} as nt from (select distinct cdr3_aa, concat(cdr3_aa, 'X*') as s from rec) x")
FRAMES = f"select *, {aa('nt')} as a0, {aa('nt', 1)} as a1, {aa('nt', 2)} as a2 from germ"


def fewest(p: list[str]) -> str:
    return f"case when {p[0]} <= {p[1]} and {p[0]} <= {p[2]} then 0 when {p[1]} <= {p[2]} then 1 else 2 end"


STOPS = [stops(f"a{f}") for f in range(3)]
BAD_CODONS = [f"({stops(f'a{f}')} + {stops(f'a{f}', '?')})" for f in range(3)]
oracle("best_frame", "germ", f"select segment, ord, {fewest(STOPS)} as frame, {fewest(BAD_CODONS)} as frame_unknown from f", f=FRAMES)


def cut(nt: str, a: str) -> str:
    p = f"strpos(reverse(right({a}, 8)), 'C')"
    return f"case when {p} > 0 then (length({a}) - {p}) * 3 else length({nt}) - length({nt}) % 3 - 3 end"


oracle("cys_cut", "germ", f"select ord, {cut('nt', 'a0')} as cut from f where segment = 'V'", f=FRAMES)


def motif(a: str) -> str:
    """0-based residue of the anchor in frame translation a, NULL when unusable."""
    tight, loose = f"regexp_extract({a}, '[FW]G.G')", f"regexp_extract({a}, '[FW].{{0,2}}?G.G')"
    at = f"(case when {tight} <> '' then strpos({a}, {tight}) when {loose} <> '' then strpos({a}, {loose}) end)"
    return f"(case when {at} is not null and strpos(left({a}, cast({at} - 1 as int)), '*') = 0 then {at} - 1 end)"


ANCHOR = f"""select *, case when c is not null then c else {fewest(STOPS)} end as frame, case c when 0 then m0 * 3 when 1 then m1 * 3 + 1 when 2 then m2 * 3 + 2 else -1 end as fw
  from (select *, case when m0 is not null and {STOPS[0]} = 0 then 0 when m1 is not null and {STOPS[1]} = 0 then 1 when m2 is not null and {STOPS[2]} = 0 then 2
    when m0 is not null then 0 when m1 is not null then 1 when m2 is not null then 2 end as c
  from (select *, {motif('a0')} as m0, {motif('a1')} as m1, {motif('a2')} as m2 from f) y) x"""
oracle("j_motif", "germ", "select ord, frame, fw from an where segment = 'J'", f=FRAMES, an=ANCHOR)
ALLELES = "select * from (select *, row_number() over (partition by species, chain, segment, allele order by ord) as rn from an) x where rn = 1"


def unstop(a: str) -> str:
    return f"case when {a} like '%*' then left({a}, length({a}) - 1) else {a} end"


oracle("allele_catalog", "germ", f"""select species, chain, segment, allele, gene, nt, case segment when 'V' then {unstop('a0')}
  when 'C' then {unstop('cbest')} else (case frame when 0 then a0 when 1 then a1 else a2 end) end as aa from (select *, case {fewest(STOPS)} when 0 then a0 when 1 then a1 else a2 end as cbest from al) x""",
       f=FRAMES, an=ANCHOR, al=ALLELES)
REPRESENTATIVE = """select species, chain, segment, gene, ord, coalesce(last01, first) as nt from (select species, chain, segment, gene, min(ord) as ord,
  arg_max(nt, ord) filter (where contains(allele, '*01')) as last01, arg_min(nt, ord) as first from germ group by all) x"""
oracle("gene_representative", "germ", "select * from rg", rg=REPRESENTATIVE)
_FIXED = " union all ".join(f"select '{s}' as species, '{c}' as chain, {len(q)} as len, '{src}' as src" for s, c, q, src in CONSTANT_REGIONS)
oracle("static_regions", "rec", "select r.species, r.chain, n, len, src as constant_source, case r.species when 'human' then 3 else 0 end as n_d "
       "from (select species, chain, count(*) as n from rec group by 1, 2) r left join k using (species, chain)", k=_FIXED)


def resolved(gene: str, species: str, source: str, tag: str, chain_of: str, segment: str = "V") -> str:
    """source with {tag}_allele: the requested allele if it exists, else *01, else the lowest name of the gene."""
    return f"""select s.*, coalesce(e.allele, d.allele) as {tag}_allele from {source} s
  left join (select * from al where segment = '{segment}') e on e.species = s.{species} and e.chain = {chain('s.' + chain_of)} and e.allele = concat({base('s.' + gene)}, '*', split_part(upper(s.{gene}), '*', 2))
  left join (select species, chain, gene, coalesce(min(allele) filter (where allele = gene || '*01'), min(allele)) as allele from al where segment = '{segment}' group by 1, 2, 3) d
    on d.species = s.{species} and d.chain = {chain('s.' + chain_of)} and d.gene = {base('s.' + gene)}"""


GENES = "select distinct v_gene, species from rec where v_gene is not null"
oracle("germline_resolve", "germ rec", "select r.v_gene, r.species, r.v_allele as g_allele_used, al.nt as g_nt from r left join al on al.segment = 'V' and al.species = r.species and al.allele = r.v_allele",
       f=FRAMES, an=ANCHOR, al=ALLELES, g=GENES, r=resolved("v_gene", "species", "g", "v", "v_gene"))
oracle("predict_cdr", "germ rec", """select r.v_gene, r.species, r.v_allele as allele, nullif(rtrim(substr(a0, 27, 12), '*'), '') as cdr1_aa, nullif(rtrim(substr(a0, 56, 10), '*'), '') as cdr2_aa,
  nullif(substr(nt, 79, 36), '') as cdr1_nt, nullif(substr(nt, 166, 30), '') as cdr2_nt from r left join al on al.segment = 'V' and al.species = r.species and al.allele = r.v_allele""",
       f=FRAMES, an=ANCHOR, al=ALLELES, g=GENES, r=resolved("v_gene", "species", "g", "v", "v_gene"))


def overlap(a: str, cdr3: str) -> str:
    """[k, end] of the longest usable overlap, NULL when none."""
    head = f"left({a}, 15)"
    opts = (f"list_filter(list_transform(range(cast(least(length({cdr3}), length({head})) as int), 0, -1), lambda k: [k, strpos({head}, right({cdr3}, k)) - 1 + k]), "
            f"lambda p: strpos({head}, right({cdr3}, p[1])) > 0 and strpos(left({head}, p[2]), '*') = 0)")
    return f"{opts}[1]"


def rebuilt(source: str) -> dict[str, str]:
    """CTEs from source(v_gene, j_gene, cdr3_aa, species) to rb with the assembled sequences."""
    return dict(
        rv=resolved("v_gene", "species", source, "v", "v_gene"), rj=resolved("j_gene", "species", "rv", "j", "v_gene", "J"),
        rw=f"""select rj.*, v.nt as v_nt, v.a0 as v_aa, j.nt as j_nt, j.frame, j.fw, j.a0, j.a1, j.a2, {back('rj.cdr3_aa')} as cdr3_n, left(v.nt, cast({cut('v.nt', 'v.a0')} as int)) as vp,
  {overlap('j.a0', 'rj.cdr3_aa')} as o0, {overlap('j.a1', 'rj.cdr3_aa')} as o1, {overlap('j.a2', 'rj.cdr3_aa')} as o2 from rj
  left join al v on v.segment = 'V' and v.species = rj.species and v.allele = rj.v_allele left join al j on j.segment = 'J' and j.species = rj.species and j.allele = rj.j_allele""",
        rx="""select *, case when ko = o0[1] then 0 when ko = o1[1] then 1 else 2 end as of from (select *, greatest(o0[1], o1[1], o2[1]) as ko from rw) x""",
        ry="""select *, substr(j_nt, 1 + (case when ko is not null then of + 3 * (case of when 0 then o0[2] when 1 then o1[2] else o2[2] end) when fw >= 0 then fw + 3 else frame end)) as js from rx""",
        rz="select *, case when v_nt is not null and j_nt is not null then concat(vp, cdr3_n, js) end as nt_full from ry",
        rb=f"select *, nullif(rtrim({aa('nt_full')}, '*'), '') as aa_full, case when nt_full is not null then {aa('vp')} end as vp_aa from rz")


GERM = dict(f=FRAMES, an=ANCHOR, al=ALLELES)
_CONST_LEN = "case {c} when 'TRB' then (case species when 'mouse' then %d else %d end) when 'TRA' then (case species when 'mouse' then %d else %d end) end" % tuple(
    len(next(q for s, c, q, _ in CONSTANT_REGIONS if (s, c) == k)) for k in (("mouse", "beta"), ("human", "beta"), ("mouse", "alpha"), ("human", "alpha")))
oracle("reconstruct_chain", "germ rec", f"""select src_row, {base('v_gene')} as v_gene, {base('j_gene')} as j_gene, v_allele as v_allele_used, j_allele as j_allele_used, cdr3_n as cdr3_nt,
  nt_full as full_nt, aa_full as full_aa, length(aa_full) + {_CONST_LEN.format(c=chain('v_gene'))} as chain_len, v_nt is not null as v_found, j_nt is not null as j_found from rb""",
       **GERM, **rebuilt("rec"))
oracle("enrich_records", "germ rec", """select src_row, coalesce(cdr3_nt, case when ok then cdr3_n end) as cdr3_nt, case when cdr3_nt is not null then 'deposited' when ok then 'reconstructed' end as cdr3_nt_kind,
  coalesce(dep_aa, case when ok then aa_full end) as full_aa, case when dep_aa is not null then 'deposited' when ok and aa_full is not null then 'reconstructed' end as full_aa_kind,
  case when ok then nt_full end as full_nt, case when ok then 'reconstructed' end as full_nt_kind, ok as nt_is_synthetic, case when ok then vp_aa end as v_germline_aa, case when ok then js end as j_region_nt
  from (select *, case when src_row % 5 = 0 then 'MKV' end as dep_aa, coalesce(v_gene is not null and j_gene is not null and cdr3_nt is null and nt_full is not null, false) as ok from rb) x""",
       **GERM, **rebuilt("rec"))
oracle("reconstruct_inferred", "germ rec ask", f"""select qid, coalesce({base('v_gene')}, '') as v_gene, {base('j_gene')} as j_gene, n is not null as genes_inferred, n as inference_support, alts as alternatives,
  case when v0 is null and j0 is null and n is null or (v0 is null or j0 is null) and n is null then '' else cdr3_n end as cdr3_nt,
  case when (v0 is null or j0 is null) and n is null then v0 is not null else v_nt is not null end as v_found,
  case when (v0 is null or j0 is null) and n is null then j0 is not null else j_nt is not null end as j_found,
  case when (v0 is null or j0 is null) and n is null then null else nt_full end as full_nt from rb""",
       **GERM, vj=VJ, q0="select qid, cdr3 as cdr3_aa, case when qid % 3 = 1 then v_gene end as v0, case when qid % 3 = 2 then j_gene end as j0, species from ask",
       op=f"""select q0.qid, t.v, t.j, t.n, t.rank from q0 join (select *, row_number() over (partition by cdr3_aa, species order by n desc, v, j) as rank from vj) t
         on t.cdr3_aa = q0.cdr3_aa and t.species = q0.species and t.rank <= 5 where (v0 is null or {base('v0')} = t.v) and (j0 is null or {base('j0')} = t.j)""",
       ag="select qid, arg_min(v, rank) as bv, arg_min(j, rank) as bj, arg_min(n, rank) as n, string_agg(v || '/' || j || ' (n=' || n || ')', ';' order by rank) as alts from op group by 1",
       src="select q0.*, coalesce(v0, bv) as v_gene, coalesce(j0, bj) as j_gene, n, alts from q0 left join ag using (qid)", **rebuilt("src"))
WORDS = "list_distinct(list_transform(range(1, greatest(length({s}) - 5, 1)), lambda i: substr({s}, i, 7)))"
KMER_STEPS = dict(
    gf=f"select species, chain, segment, gene, ord, false as p, nt as s from rg where segment in ('V','J') union all select species, chain, segment, gene, ord, true, rtrim({aa('nt')}, '*') from rg where segment in ('V','J')",
    gw=f"select species, chain, segment, gene, ord, p, unnest({WORDS.format(s='s')}) as w, len({WORDS.format(s='s')}) as n from gf where length(s) >= 7",
    sw=f"select seq_id, species, is_protein, unnest({WORDS.format(s='seq')}) as w from sq where length(seq) >= 7",
    sc="select sw.seq_id, gw.segment, gw.chain, gw.gene, gw.ord, 100.0 * count(*) / gw.n as x from sw join gw on gw.species = sw.species and gw.p = sw.is_protein and gw.w = sw.w group by 1, 2, 3, 4, 5, gw.n",
    jb="select seq_id, chain, gene, cast(round(x, 2) as double) as sc from (select *, row_number() over (partition by seq_id, chain order by x desc, ord) as k from sc where segment = 'J') y where k = 1",
    vb="select seq_id, chain, gene, cast(round(x, 2) as double) as sc from (select *, row_number() over (partition by seq_id, chain order by x desc, ord) as k from sc where segment = 'V') y where k = 1",
    v="select * from (select *, row_number() over (partition by seq_id order by sc desc, chain) as k from vb where sc > 0) y where k = 1")
oracle("kmer_annotate", "germ seqs", """select s.seq_id, v.gene as v_call, v.sc as v_score, j.gene as j_call, case when v.gene is not null then coalesce(j.sc, 0) end as j_score,
  coalesce(case v.chain when 'TRA' then 'alpha' when 'TRB' then 'beta' end, 'unknown') as chain, case when s.is_protein then 'low' else 'medium' end as confidence,
  concat_ws(',', case when s.is_protein then 'aa_annotation_limited' end, case when v.chain = 'TRB' then 'd_segment_unresolved' end) as warnings
  from sq s left join v on v.seq_id = s.seq_id left join jb j on j.seq_id = s.seq_id and j.chain = v.chain""",
       rg=REPRESENTATIVE, sq=f"select seq_id, species, is_protein, case when is_protein then {aa('seq')} else seq end as seq from seqs",
       **KMER_STEPS)

# a third of the requests names a gene, a third gives V, J and CDR3, a third is a raw CDR3
oracle("dossiers", "germ rec ask", f"""select w.qid, case when vc is not null and warned = '' then 'complete' else 'partial' end as status,
  ch || ' TCR, V=' || coalesce(vc, 'NA') || ', J=' || coalesce(jc, 'NA') || ', ' || least(coalesce(total, 0), 5) || ' known epitope(s)' as summary, ch as chain, vc as v_call,
  case when used then g_allele end as v_allele, case when made then {back('cdr3_aa')} end as cdr3_nt, length(aa_full) as full_len, coalesce(total, 0) as known_epitopes_total, coalesce(m, 0) as n_records,
  concat_ws(',', case when used and looped then 'regions' end, case when used then 'germline' end, case when kv is not null or kj is not null then 'annotation' end, case when made then 'junction' end,
    case when aa_full is not null then 'full_sequence' end, case when total > 0 then 'known_epitopes' end) as provenance, warned as warnings
  from w left join e on e.qid = w.qid left join n on n.qid = w.qid""",
       f=FRAMES, an=ANCHOR, al=ALLELES, rg=REPRESENTATIVE.replace("from germ", "from al"),
       d0="select qid, species, case when qid % 3 = 0 then upper(v_gene) end as named, case when qid % 3 = 1 then v_gene end as v_gene, case when qid % 3 = 1 then j_gene end as j_gene, "
          "case when qid % 3 > 0 then upper(cdr3) end as cdr3_aa from ask",
       gg="select *, coalesce(named, v_gene) as germ_gene from d0", r=resolved("germ_gene", "species", "gg", "g", "germ_gene"),
       sq="select qid as seq_id, species, true as is_protein, cdr3_aa as seq from d0 where qid % 3 = 2", **KMER_STEPS,
       full_="select qid, species, v_gene, j_gene, cdr3_aa from d0 where qid % 3 = 1", **rebuilt("full_"),
       u=f"""select r.*, v.gene as kv, j.gene as kj, v.chain as kc, rb.aa_full, r.germ_gene is not null and r.g_allele is not null as used,
  a.allele is not null and (nullif(rtrim(substr(a.a0, 27, 12), '*'), '') is not null or nullif(rtrim(substr(a.a0, 56, 10), '*'), '') is not null) as looped
  from r left join v on v.seq_id = r.qid left join jb j on j.seq_id = r.qid and j.chain = v.chain left join rb on rb.qid = r.qid
  left join al a on a.segment = 'V' and a.species = r.species and a.chain = {chain('r.germ_gene')} and a.allele = r.g_allele""",
       w=f"""select *, vc is not null and jc is not null and cdr3_aa is not null as made,
  concat_ws(',', case when germ_gene is not null and not used then 'ambiguous_gene' end, case when qid % 3 = 2 then 'aa_annotation_limited' end, case when kc = 'TRB' then 'd_segment_unresolved' end) as warned
  from (select *, coalesce(kv, case when used or v_gene is not null then split_part(germ_gene, '*', 1) end) as vc, coalesce(split_part(j_gene, '*', 1), kj) as jc,
    case when germ_gene is not null then {label(chain('germ_gene'))} when kc is not null then {label('kc')} else {label(chain('j_gene'))} end as ch from u) x""",
       e=f"select w.qid, count(*) as total from w join rec on rec.epitope_aa is not null and rec.species = w.species and {base('rec.v_gene')} = {base('vc')} and vc is not null group by 1",
       ix=IX, q=f"select qid, cdr3_aa as ck, case when coalesce(v_gene, vc) is not null then {base('coalesce(v_gene, vc)')} end as vk, case when coalesce(j_gene, jc) is not null then {base('coalesce(j_gene, jc)')} end as jk, species "
                  "from w where cdr3_aa is not null or vc is not null or jc is not null",
       h=HITS, n="select h.qid, least(count(*), 20) as m from h group by 1")

# --- parsing and routing --------------------------------------------------------------------------------------------

oracle("route_type", "sentences", "select qid, n, kind as detected_type, norm as normalized, id_source, code from c",
       src="select qid, generate_subscripts(string_split(query, ' '), 1) - 1 as n, unnest(string_split(query, ' ')) as word from sentences union all select qid, -1, query from sentences", c=classify("word", "qid, n"))
TOK = r"list_filter(regexp_split_to_array(trim(query), '[\s,;]+'), lambda x: x <> '')"
WORDL = "regexp_split_to_array(lower(query), '[^a-z]+')"
_SPW = "list_filter({w}, lambda x: x in ('mouse','murine','souris','human','humain','homo'))[1]".format(w=WORDL)
PARSED = f"""select *, case when {_SPW} in ('mouse','murine','souris') then 'mouse' when {_SPW} is not null then 'human' end as p_species,
  list_filter({TOK}, lambda x: regexp_matches(upper(x), '^C[ACDEFGHIKLMNPQRSTVWY]{{7,21}}$'))[1] as p_cdr3, list_filter({TOK}, lambda x: regexp_matches(upper(x), '^TR[ABGD]V.'))[1] as p_v,
  list_filter({TOK}, lambda x: regexp_matches(upper(x), '^TR[ABGD]J.'))[1] as p_j, list_filter({TOK}, lambda x: regexp_matches(lower(x), '^(vdjdb|iedb|mcpas|tcr3d):'))[1] as p_id from sentences"""
oracle("parse_text", "sentences", "select qid, p_species as species, p_cdr3 as cdr3_aa, p_v as v_gene, p_j as j_gene, p_id as record_id from p", p=PARSED)


def any_of(words: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower(query), '{w}')" for w in words) + ")"


oracle("keyword_filters", "sentences", f"""select qid, source, species, region, gene_name, sequence_contains, case when pep is distinct from sequence_contains then pep end as antigen_epitope from (select *,
  case when contains(lower(query), 'hla') then 'hla' when {any_of(MHC_WORDS)} then 'mhc' when {any_of(IEDB_WORDS)} then 'iedb' when {any_of(VDJDB_WORDS)} then 'vdjdb' when {any_of(TCR_WORDS)} then 'tcr' end as source,
  case when {any_of(['human', 'homo sapiens'])} then 'human' when {any_of(['mouse', 'mus musculus'])} then 'mouse' end as species,
  case {' '.join(f"when contains(lower(query), '{r}') then '{r}'" for r in REGION_WORDS)} end as region,
  nullif(regexp_extract(query, '\\b([A-Z]{{2,6}}[A-Z0-9-]*\\*?[0-9:]*)\\b', 1), '') as gene_name, nullif(regexp_extract(upper(query), '\\b([ACGT]{{8,}})\\b', 1), '') as sequence_contains,
  nullif(regexp_extract(upper(query), '\\b([ACDEFGHIKLMNPQRSTVWY]{{8,15}})\\b', 1), '') as pep from (select qid, query from sentences) s) x""")
oracle("plan_intent", "sentences", f"""select qid, 'heuristic' as plan_source, intent, case when intent = 'dossier' and (v <> '' or j <> '') then coalesce(nullif(cdr3, ''), nullif(v, ''), j) when intent = 'dossier' then plain
    when intent = 'search' then query end as query,
  case when intent = 'similar' then coalesce(nullif(cdr3, ''), list_filter(t2, lambda x: upper(x) like 'CAS%')[1], '') else cdr3 end as cdr3_aa,
  case when intent = 'similar' then coalesce(nullif(v, ''), list_filter(t2, lambda x: upper(x) like 'TRBV%')[1], '') else v end as v_gene,
  case when intent = 'similar' then coalesce(nullif(j, ''), list_filter(t2, lambda x: upper(x) like 'TRBJ%')[1], '') else j end as j_gene
  from (select *, case when {any_of(SIMILAR_WORDS)} then 'similar' when v <> '' or j <> '' then 'dossier' when cdr3 <> '' then 'similar' when plain is not null then 'dossier' else 'search' end as intent,
    regexp_split_to_array(replace(query, ',', ' '), '\\s+') as t2 from (select s.qid, s.query, coalesce(k.cdr3, '') as cdr3, coalesce(k.v, '') as v, coalesce(k.j, '') as j, k.plain from sentences s left join k on k.qid = s.qid) y) x""",
       src=r"select qid, generate_subscripts(regexp_split_to_array(trim(query), '\s+'), 1) as n, unnest(regexp_split_to_array(trim(query), '\s+')) as word from sentences",
       c=classify("word", "qid, n, word"),
       k="""select qid, arg_min(word, n) filter (where kind = 'raw_aa' and length(word) between 8 and 22) as cdr3, arg_min(word, n) filter (where regexp_matches(upper(word), '^TR[ABGD]V.')) as v,
         arg_min(word, n) filter (where regexp_matches(upper(word), '^TR[ABGD]J.')) as j, arg_min(word, n) filter (where kind <> 'unknown' and code is null) as plain from c where word <> '' group by 1""")
oracle("route_tools", "sentences", """select qid, kind as detected_type, coalesce(species, p_species) as species, note, step - 1 as step, tool,
  case when forced and not (p_cdr3 is not null and p_v is not null and p_j is not null) then 'similarity needs a CDR3 with V and J genes' end as warning
  from (select *, unnest(string_split(tools, ',')) as tool, generate_subscripts(string_split(tools, ','), 1) as step from r) z""",
       p=PARSED, src="select *, trim(query) as word from p", c=classify("word", "qid, query, species, p_species, p_cdr3, p_v, p_j, p_id, word"),
       r="""select *, qid % 10 = 0 as forced, case when qid % 10 = 0 then 'similar' when kind in ('id', 'gene_name', 'allele') then 'records' when kind = 'raw_nt' then 'assign' when kind = 'raw_aa' and cd then 'records,assign'
  when kind = 'raw_aa' then 'assign' when coalesce(p_id, p_cdr3, p_v, p_j) is not null then 'records' else 'ask' end as tools,
  case when qid % 10 = 0 then 'forced similar' when kind = 'id' then 'database id lookup' when kind in ('gene_name', 'allele') then 'gene lookup' when kind = 'raw_nt' then 'nucleotide sequence, germline assignment'
  when kind = 'raw_aa' and cd then 'amino acid CDR3, known records and germline assignment (J only, V needs framework)' when kind = 'raw_aa' then 'amino acid sequence, germline assignment'
  when coalesce(p_id, p_cdr3, p_v, p_j) is not null then 'parsed a phrase into records filters' else 'free text, routed to ask' end as note
  from (select *, regexp_matches(upper(word), '^C[ACDEFGHIKLMNPQRSTVWY]{7,21}$') as cd from c) y""")
FLT = """select s_suppkey as qid, concat('brand#', s_suppkey % 5) as g, case when s_suppkey % 3 = 0 then 'steel' end as r, case when s_suppkey % 4 = 0 then 'human' end as sp,
  case when s_suppkey % 2 = 0 then 'acg' end as sq from supplier"""
oracle("allele_search", "uploads", """select qid, rank - 5 + 5 as rank, allele_name, ord from (select *, row_number() over (partition by qid order by part, ord) as rank from u) z where rank between 6 and 25""", flt=FLT,
       m="""select f.qid, u.* from flt f join uploads u on contains(lower(u.gene_name), f.g) and (f.r is null or contains(lower(u.region), f.r)) and (f.sp is null or f.sp = lower(coalesce(u.species, '')))
         and (f.sq is null or contains(lower(u.sequence), f.sq))""",
       u="select *, 0 as part from m where ord % 2 = 0 union all select m.*, 1 from m where not exists (select 1 from m x where x.ord % 2 = 0 and x.qid = m.qid and x.allele_name = m.allele_name)")
oracle("dna_extract", "texts", r"""select doc_id, n, concat('text-seq-', n) as gene_name, upper(s) as sequence from (select doc_id, unnest(l) as s, generate_subscripts(l, 1) as n
  from (select doc_id, regexp_extract_all(value, '(?i)\b[ACGT]{12,}\b') as l from texts) y) x""")
oracle("fasta_headers", "uploads", """select case when contains(h, 'homo sapiens') or contains(h, 'human') then 'human' when contains(h, 'mus musculus') or contains(h, 'mouse') then 'mouse' else 'other' end as species,
  case when ord % 3 = 0 then coalesce(nullif(regexp_extract(header, '\\b([A-Z]{1,4}[A-Z0-9-]*\\*?[0-9:]*)\\b', 1), ''), 'unknown') else gene_name end as gene_name, allele_name, region, upper(sequence) as sequence,
  regexp_split_to_array(header, '\\s+')[1] as record_id
  from (select *, lower(header) as h from (select *, concat_ws('|', allele_name, case when ord % 3 = 0 then '' else gene_name end, region, coalesce(species, 'Mus musculus')) as header from uploads) y) x""")
oracle("upload_rows", "uploads", """select 'upload' as source, coalesce(species, 'other') as species, gene_name, case when ord % 2 = 0 then allele_name end as allele_name, region,
  case when ord % 3 <> 0 then sequence else 'CASS' end as sequence from uploads where ord % 3 <> 0""")
oracle("export_rows", "rec", """select case species when 'human' then 'human' else 'other' end as species, coalesce(v_gene, 'unknown') as gene_name, mhc_a as allele_name, 'CDR3' as region, cdr3_aa as sequence,
  epitope_aa as antigen_epitope, count(*) as n from rec group by all""")
oracle("fasta_sink", "rec", "select src_row, '>' || source_record_id || chr(10) || cdr3_aa as value from rec")

# --- profiles, alignment statistics, epitopes ---------------------------------------------------------------------------

GEN = f"select species, chain, source, cdr3_aa, {base('v_gene')} as v, {base('j_gene')} as j from rec where {base('v_gene')} <> '' and {base('j_gene')} <> ''"
for _seg in "vj":
    oracle(f"usage_{_seg}", "rec", """select species, chain, gene, round(sum(n) / any_value(total), 6) as freq, round(coalesce(stddev_samp(share), 0), 5) as std from y group by 1, 2, 3""",
           g=f"select species, chain, source, {base(_seg + '_gene')} as {_seg} from rec where {base(_seg + '_gene')} <> ''", s=f"select distinct species, chain, source from g", ge=f"select distinct species, chain, {_seg} as gene from g",
           x=f"select s.species, s.chain, s.source, ge.gene, count(g.source) as n from s join ge on ge.species = s.species and ge.chain = s.chain left join g on g.species = s.species and g.chain = s.chain "
             f"and g.source = s.source and g.{_seg} = ge.gene group by 1, 2, 3, 4",
           y="select *, cast(n as double) / sum(n) over (partition by species, chain, source) as share, sum(n) over (partition by species, chain) as total from x")
LEN = "select species, chain, v, j, length(cdr3_aa) as len, cdr3_aa from g where length(cdr3_aa) between 7 and 22"
oracle("cdr3_length_dist", "rec", "select *, round(n / sum(n) over (partition by species, chain, v, j), 6) as share from c", g=GEN, l=LEN, c="select species, chain, v, j, len, count(*) as n from l group by 1, 2, 3, 4, 5")
oracle("aa_position_freq", "rec", "select *, round(n / sum(n) over (partition by species, chain, v, j, len, pos), 6) as share from c", g=GEN, l=LEN,
       c="select species, chain, v, j, len, pos, aa, count(*) as n from (select species, chain, v, j, len, unnest(string_split(cdr3_aa, '')) as aa, unnest(range(0, length(cdr3_aa))) as pos from l) x group by all")
ALN = "select concat_ws('|', v_gene, cast(length(cdr3_aa) as varchar)) as set_id, src_row as ord, translate(cdr3_aa, 'P', '-') as aligned from rec where v_gene is not null"
CELL = "select set_id, ord, unnest(string_split(aligned, '')) as ch, unnest(range(0, length(aligned))) as pos from aln"
oracle("alignment_consensus", "rec", """select set_id, string_agg(case when ch is null then '-' when n > nrows / 2.0 then ch else 'X' end, '' order by pos) as consensus,
  string_agg(printf('%.3f', round(coalesce(n, 0) / nrows, 3)), ',' order by pos) as conservation
  from (select t.set_id, t.pos, t.nrows, b.ch, b.n from t left join b on b.set_id = t.set_id and b.pos = t.pos) x group by 1""", aln=ALN, ce=CELL,
       t="select set_id, pos, count(*) as nrows from ce group by 1, 2", k="select set_id, pos, ch, count(*) as n, min(ord) as fo from ce where ch <> '-' group by 1, 2, 3",
       b="select * from (select *, row_number() over (partition by set_id, pos order by n desc, fo) as r from k) z where r = 1")
oracle("mean_identity", "rec", """select z.set_id, case when nrows < 2 then 100.0 else round(coalesce(sum(tot), 0) / (nrows * (nrows - 1) / 2.0), 2) end as mean_pct_identity
  from z left join pp on pp.set_id = z.set_id group by z.set_id, nrows""", aln=ALN,
       pt="select *, regexp_replace(aligned, '[^-]', 'x', 'g') as pat, length(aligned) as len from aln", z="select set_id, count(*) as nrows from aln group by 1",
       ce="select set_id, pat, len, unnest(string_split(aligned, '')) as ch, unnest(range(0, len)) as pos from pt",
       k="select set_id, pat, len, pos, ch, count(*) as n from ce where ch <> '-' group by all",
       gap="select a.set_id, a.pat as p1, b.pat as p2, a.len - list_sum(list_transform(range(1, a.len + 1), lambda i: case when substr(a.pat, i, 1) = '-' and substr(b.pat, i, 1) = '-' then 1 else 0 end)) as cols "
           "from (select distinct set_id, pat, len from pt) a join (select distinct set_id, pat from pt) b on a.set_id = b.set_id and a.pat <= b.pat",
       pp="select gap.set_id, 100.0 * sum(case when p1 = p2 then a.n * (a.n - 1) / 2.0 else a.n * b.n end) / any_value(cols) as tot from gap join k a on a.set_id = gap.set_id and a.pat = p1 "
          "join k b on b.set_id = gap.set_id and b.pat = p2 and a.pos = b.pos and a.ch = b.ch group by gap.set_id, p1, p2")
oracle("codon_thread", "rec", f"""select cdr3_aa, array_to_string(list_transform(string_split(cdr3_aa, ''), lambda x: case x when 'G' then '---' || {BACK}[x] || '---' else {BACK}[x] end), '') as threaded
  from (select distinct cdr3_aa from rec) x""")
oracle("resolve_align_sets", "germ ask", f"""
select cast(qid as varchar) as set_id, r.gene as name, case when qid % 5 = 0 then best else r.nt end as seq, null as code from nm join r on r.species = nm.species and r.gene = nm.b and r.chain = substr(b, 1, 3) and r.segment = substr(b, 4, 1)
union all select cast(qid as varchar), 'gene ' || g || ' not resolvable from germline', null, 'ambiguous_gene' from nm where not exists (select 1 from r where r.species = nm.species and r.gene = nm.b and r.chain = substr(b, 1, 3))
union all select cast(qid as varchar), r.gene, case when qid % 5 = 0 then best else r.nt end, null from ask join r on r.species = ask.species and r.chain = 'TRB' and r.segment = 'J' where qid % 2 <> 0 and qid % 3 <> 0
union all select cast(qid as varchar), 'segment D not available in the germline source for TRB/' || species, null, 'segment_unavailable' from ask where qid % 2 <> 0 and qid % 3 = 0""",
       rg=REPRESENTATIVE, r=f"select *, case {fewest(BAD_CODONS)} when 0 then a0 when 1 then a1 else a2 end as best from (select *, {aa('nt')} as a0, {aa('nt', 1)} as a1, {aa('nt', 2)} as a2 from rg) x",
       nm=f"select *, {base('g')} as b from (select qid, species, unnest([v_gene, j_gene, 'TRBV99']) as g from ask where qid % 2 = 0) x")
_SETS = "select concat_ws('/', {key}) as set_id, gene as name, dense_rank() over (partition by {key} order by gene) as ord, {seq} as seq"
oracle("align_germline_sets", "germ", "select set_id, name, ord, aligned from aligned", rg=REPRESENTATIVE,
       members=f"select *, seq as safe from ({_SETS.format(key='species, chain, segment', seq='nt')} from rg where segment in ('V', 'J', 'C')) x",
       **alignment_sql.star(alignment_sql.NT_SCORE, alignment_sql.NT_GAPS))
oracle("align_codon_sets", "germ", """select a.set_id, a.name, a.ord, a.aligned as aligned_aa, array_to_string(list_transform(range(1, length(aligned) + 1), lambda i: case when substr(aligned, i, 1) = '-' then '---'
  else substr(coding, 3 * (i - 1 - (length(left(aligned, i)) - length(replace(left(aligned, i), '-', '')))) + 1, 3) end), '') as aligned_nt from aligned a join members using (set_id, ord)""",
       rg=REPRESENTATIVE, framed=f"select *, {fewest(BAD_CODONS)} as fr from (select *, {aa('nt')} as a0, {aa('nt', 1)} as a1, {aa('nt', 2)} as a2 from rg where segment = 'J') x",
       coded="select *, substr(nt, fr + 1, (length(nt) - fr) // 3 * 3) as coding from framed",
       members=f"select *, regexp_replace(seq, '[^ARNDCQEGHILKMFPSTWYVBZX*]', 'X', 'g') as safe from ({_SETS.format(key='species, chain', seq=aa('coding'))}, coding from coded) x",
       **alignment_sql.star(alignment_sql.AA_SCORE, alignment_sql.AA_GAPS))
oracle("known_epitopes", "rec ask", """select qid, string_agg(epitope_aa, ',' order by src_row) filter (where k <= 5) as epitopes, count(*) as total from (select q.qid, r.epitope_aa, r.src_row,
  row_number() over (partition by q.qid order by r.src_row) as k from ask q join rec r on r.epitope_aa is not null and r.species = q.species and split_part(r.v_gene, '*', 1) = split_part(q.v_gene, '*', 1)) x group by 1""")
oracle("trailing_count", "requests", """select event_id, key, count(*) over (partition by key order by ts range between interval 60 seconds preceding and current row) as n_trailing from requests""")
# the log of the last accepted requests of every key, request by request; micros between 60 s are still inside
oracle("rate_limit", "requests", """select event_id, accepted from log""",
       turn="select event_id, key, epoch_us(ts) as t, row_number() over (partition by key order by ts, event_id) as n from requests",
       log="""select * from (with recursive log as (select key, n, event_id, true as accepted, [t] as kept from turn where n = 1 union all
  select key, n, event_id, len(inside) < 3, case when len(inside) < 3 then list_append(inside, t) else inside end
  from (select t.key, t.n, t.event_id, t.t, list_filter(log.kept, lambda x: t.t - x <= 60000000) as inside from log join turn t on t.key = log.key and t.n = log.n + 1) y) select * from log) z""")
oracle("index_union", "rec", """select source, count(*) as n, min(src_row) as first_row from
  (select *, row_number() over (partition by <key> order by src_row) as k from rec) x where k = 1 group by 1""".replace("<key>", ", ".join(DEDUP_KEY)))
oracle("latest_build", "", """select build_id, built_at, announced from (select cast(o_orderkey % 1000 as varchar) as build_id, strftime(o_orderdate, '%Y-%m-%d') as built_at,
  case when o_orderkey % 4 = 0 then strftime(o_orderdate, '%Y-%m-%d') || 'T0' || (o_orderkey % 7) end as announced from orders) x
  order by coalesce(announced, '') desc, built_at desc, cast(build_id as double) desc limit 1""")
oracle("similar_refused", "ask", """select qid, 'query_incomplete' as code, 'not searched; missing: ' || concat_ws(', ', case when cdr3 is null or qid % 3 = 0 then 'cdr3' end,
  case when qid % 4 = 1 or v_gene is null then 'v_gene' end, case when j_gene is null then 'j_gene' end) as message from ask
  where cdr3 is null or qid % 3 = 0 or qid % 4 = 1 or v_gene is null or j_gene is null""")
oracle("upload_dispatch", "", """select p_partkey, case p_partkey % 9 when 0 then 'fasta' when 1 then 'fasta' when 2 then 'csv' when 3 then 'csv' when 4 then 'tsv' when 5 then 'tsv' when 6 then 'json'
  else 'text' end as kind from part""")
oracle("json_rows", "uploads", """select coalesce(species, 'other') as species, gene_name, upper(sequence) as sequence, region as note from uploads where ord % 3 <> 0""")
oracle("cdr3_fasta_rows", "rec", "select source_record_id as id, upper(cdr3_aa) as seq from rec where src_row % 5 <> 0 and cdr3_aa is not null and source_record_id is not null and source is not null")
