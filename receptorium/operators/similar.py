"""Nearest-neighbour search by CDR3 distance, single chain and paired."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from receptorium.constants import FAMILY_MIN, INDEX_COLUMNS, LABELLED_COLUMNS
from receptorium.functions import nearest, text
from receptorium.operators.nearest_pieces import nearest_candidates
from receptorium.operators.pairwise import first_rows
from receptorium.session import broadcastable, cut_lineage, sent_if_small, shared_path

WORDS_SENT = 4_000_000  # hashes of candidates that go to every task, so that only rows of these are shuffled
LOOPS = ["cdr1", "cdr2", "cdr25"]
UNAVAILABLE = "tcrdist scoring unavailable; used the substitution-matrix CDR3 distance."


def blosum_distance(queries: Column, candidates: Column) -> Column:
    """Matrix-based CDR3 distance of two columns, query first (it is not symmetric)."""
    return _blosum_udf(queries, candidates)


@F.pandas_udf(DoubleType())
def _blosum_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pair_by_pair(a, b, "blosum")


def tcrdist_cdr3(queries: Column, candidates: Column) -> Column:
    return _tcrdist_cdr3_udf(queries, candidates)


def tcrdist_loop(queries: Column, candidates: Column) -> Column:
    return _tcrdist_loop_udf(queries, candidates)


@F.pandas_udf(DoubleType())
def _tcrdist_cdr3_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pair_by_pair(a, b, "tcrdist")


@F.pandas_udf(DoubleType())
def _tcrdist_loop_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pair_by_pair(a, b, "loop")


def _pair_by_pair(a: pd.Series, b: pd.Series, engine: str) -> pd.Series:
    """Distances row by row."""
    out = np.full(len(a), np.nan)
    known = (a.notna() & b.notna()).to_numpy()
    out[known] = nearest.pair_distances([str(x) for x in a[known]], [str(x) for x in b[known]], engine)
    return pd.Series(out).where(known, None)


# --- search --------------------------------------------------------------------------------------

def _blocks(rows: DataFrame) -> DataFrame:
    """Every block an index row belongs to: its species or any, its chain or any, its family or any."""
    out = rows
    for name, own in (("scope", "own"), ("block_chain", "chain"), ("family", "i_family")):
        out = out.withColumn(name, F.explode(F.array_compact(F.array(F.lit("*"), F.col(own)))))
    return out.withColumn("block", F.concat_ws("|", "scope", "block_chain", "family"))


def _counted(rows: DataFrame, *counts: Column) -> DataFrame:
    """Block sums of ``counts``: rows alike are counted once and the sums copied into the blocks."""
    alike = rows.groupBy("own", "chain", "i_family").agg(*counts)
    names = alike.columns[3:]
    return _blocks(alike).groupBy("block").agg(*[F.sum(n).alias(n) for n in names])


def block_name(scope: Column, chain: Column, family: Column) -> Column:
    return F.concat_ws("|", scope, chain, family)


def _search_frame(index: DataFrame, mhc_gate: bool = False) -> DataFrame:
    def col(name):
        return F.col(name) if name in index.columns else F.lit(None).cast("string")
    rows = index.select(
        "*", F.upper(F.coalesce("cdr3_aa", F.lit(""))).alias("i_cdr3"),
        text.species_key(col("species")).alias("i_species"),
        text.mhc_organism(col("mhc_a")).alias("mhc_organism"),
        text.v_family(F.col("v_gene")).alias("i_family"))
    species = F.col("i_species")
    own = F.when((species != "") & (species != "*"), species)
    return rows.withColumn("own", F.when(F.col("mhc_organism").isNull() | (F.col("mhc_organism") == species), own) if mhc_gate else own)


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: a fraction of a checkpoint's bytes."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _alike(frame: DataFrame, loops: list[str]) -> DataFrame:
    """Rows that no search can tell apart, as one row: their number and the first of them."""
    return frame.groupBy("own", "chain", "i_family", "i_cdr3", *loops).agg(F.count(F.lit(1)).alias("n"), F.min("src_row").alias("first_row"))


def nearest_records(probes: DataFrame, index: DataFrame, k: int, mhc_gate: bool = False,
                    skip_identical: bool = False, engine: str = "blosum",
                    min_similarity: float = 0.0, alike: DataFrame | None = None) -> DataFrame:
    """Nearest k index rows of every query, ties by index order.

    probes: qid, scope, chain, family (``*`` for any), cdr3 (+ loops and v for tcrdist); a query may have several
    rows, its blocks are then merged. The index needs src_row (+ loops for tcrdist). ``alike``: its rows by what searches
    can tell apart, where they were counted before.
    """
    loops = LOOPS if engine == "tcrdist" else []
    probes = probes.withColumn("block", block_name(F.col("scope"), F.col("chain"), F.col("family"))) \
        .withColumn("probe", F.concat_ws("|", "cdr3", *loops))
    asked = probes.select("block", "probe", "cdr3", *loops).distinct()
    blocks = sent_if_small(asked.select("block").distinct())
    frame = _search_frame(index, mhc_gate)
    pool = _blocks(_alike(frame, loops) if alike is None else alike).join(blocks, "block", "left_semi") \
        .groupBy("block", F.col("i_cdr3").alias("cdr3"), *loops).agg(F.min("first_row").alias("first_row"), F.sum("n").alias("n"))
    near = nearest_candidates(asked, pool, k, engine, "block", ["cdr3"], loops, skip_identical)

    # A query takes at most k rows: a candidate counts only where those nearer have fewer rows. Of each, only its first k rows can matter.
    nearer = Window.partitionBy("block", "probe").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("_nearer", F.coalesce(F.sum("n").over(nearer), F.lit(0))).filter(F.col("_nearer") < k).drop("_nearer", "n")
    wanted = near.select("block", "candidate").distinct()
    keep = [c for c in (*INDEX_COLUMNS, *LABELLED_COLUMNS) if c in index.columns]
    keep = list(dict.fromkeys(keep)) + ["src_row", "mhc_organism"]
    rows = frame.withColumn("candidate", F.concat_ws("|", "i_cdr3", *loops)).withColumn("_word", F.xxhash64("candidate"))
    words = sent_if_small(wanted.select(F.xxhash64("candidate").alias("_word")).distinct(), WORDS_SENT)
    rows = _blocks(rows.join(words, "_word", "left_semi").drop("_word"))
    members = first_rows(rows.join(wanted, ["block", "candidate"], "left_semi"),
                         ["block", "candidate"], [F.col("src_row")], k).select("block", "candidate", *keep)
    per_query = probes.select("qid", "block", "probe").join(near, ["block", "probe"])
    per_query = per_query.withColumn("max_distance", F.max("max_distance").over(Window.partitionBy("qid")))
    out = per_query.drop("probe", "first_row").join(members, ["block", "candidate"])
    if min_similarity > 0:
        out = out.filter(text.similarity(F.col("distance"), F.col("max_distance")) >= min_similarity)
    return first_rows(out, ["qid"], [F.col("distance"), F.col("src_row")], k).drop("block", "candidate")


def with_loops(df: DataFrame, loops: DataFrame, gene: str, species: Column, prefix: str = "", few: bool = False) -> DataFrame:
    """Germline loops of a V gene: the exact allele, else the ``*01`` allele of the gene; NULL if neither.

    loops: organism, id, cdr1, cdr2, cdr25; a ``few`` are sent to every task, so that rows are not shuffled by their few genes.
    """
    def side(tag):
        # of repeated (organism, id) the last row counts; without an ordinal the largest loops do
        order = F.col("ord") if "ord" in loops.columns else F.struct(*LOOPS)
        kept = loops.groupBy(F.lower("organism").alias(f"_o{tag}"), F.col("id").alias(f"_i{tag}")).agg(F.max_by(F.struct(*LOOPS), order).alias("_l"))
        return kept.select(f"_o{tag}", f"_i{tag}", *[F.col(f"_l.{c}").alias(f"_{c}{tag}") for c in LOOPS])
    organism = F.lower(F.trim(species))
    gene_col = F.col(gene)
    out = df.withColumn("_org", organism).withColumn("_gene01", F.concat(F.split_part(gene_col, F.lit("*"), F.lit(1)), F.lit("*01")))
    exact, default = (F.broadcast(side(tag)) if few else side(tag) for tag in "ed")
    out = out.join(exact, (F.col("_org") == F.col("_oe")) & (gene_col == F.col("_ie")), "left") \
        .join(default, (F.col("_org") == F.col("_od")) & (F.col("_gene01") == F.col("_id")), "left")
    out = out.withColumns({f"{prefix}{c}": F.when(F.col("_ie").isNotNull(), F.col(f"_{c}e")).otherwise(F.col(f"_{c}d"))
                           for c in LOOPS})
    return out.drop("_org", "_gene01", *[f"_{x}{t}" for t in "ed" for x in ("o", "i", *LOOPS)])


def tcrdist(pairs: DataFrame, loops: DataFrame) -> DataFrame:
    """``pairs`` (cdr3_1, v_1, cdr3_2, v_2, species, and any others) with their single-chain distance: the weighted CDR3 part plus the
    three loops of both V genes. NULL where a CDR3 is absent or a V gene is not in the table."""
    organism = F.coalesce(F.nullif(text.species_key(F.col("species")), F.lit("")), F.lit("human"))
    both = with_loops(with_loops(pairs, loops, "v_1", organism, "_1"), loops, "v_2", organism, "_2")
    parts = tcrdist_cdr3(F.upper("cdr3_1"), F.upper("cdr3_2"))
    for c in LOOPS:
        parts = parts + tcrdist_loop(F.col(f"_1{c}"), F.col(f"_2{c}"))
    return both.withColumn("distance", parts).select(*pairs.columns, "distance")


def family_block(queries: DataFrame, index: DataFrame, alike: DataFrame | None = None) -> DataFrame:
    """Choose the candidates of every query: its V family when that has at least five rows, else all.

    queries: qid, scope, chain (``*`` for any), v_gene. Adds family and total_candidates. ``alike`` as for ``nearest_records``.
    """
    q = queries.withColumn("family", text.v_family(F.col("v_gene")))
    q = q.withColumn("_near", block_name(F.col("scope"), F.col("chain"), F.col("family"))) \
        .withColumn("_all", block_name(F.col("scope"), F.col("chain"), F.lit("*")))
    asked = q.select(F.col("_near").alias("block")).union(q.select(F.col("_all").alias("block"))).distinct()
    counts = (_counted(_search_frame(index), F.count(F.lit(1)).alias("n")) if alike is None else _counted(alike, F.sum("n").alias("n"))).join(asked, "block", "left_semi")
    out = q.join(counts.select(F.col("block").alias("_near"), F.col("n").alias("family_rows")), "_near", "left") \
        .join(counts.select(F.col("block").alias("_all"), F.col("n").alias("all_rows")), "_all", "left")
    own = F.coalesce(F.col("family_rows") >= FAMILY_MIN, F.lit(False))
    return out.withColumn("total_candidates", F.coalesce(F.when(own, F.col("family_rows")).otherwise(F.col("all_rows")), F.lit(0)).cast("long")) \
        .withColumn("family", F.when(own, F.col("family")).otherwise(F.lit("*"))) \
        .drop("_near", "_all", "family_rows", "all_rows")


def labelled_as_index(labelled: DataFrame) -> DataFrame:
    """The labelled layout under the index names: human beta only."""
    names = {"cdr3_b_aa": "cdr3_aa", "v_b_gene": "v_gene", "j_b_gene": "j_gene"}
    return labelled.withColumnsRenamed(names).withColumn("species", F.lit("human")).withColumn("chain", F.lit("beta"))


def find_similar(queries: DataFrame, index: DataFrame, loops: DataFrame | None = None, top_k: int = 10,
                 min_similarity: float = 0.0) -> dict[str, DataFrame]:
    """Nearest records of every query.

    queries: qid, cdr3, v_gene, j_gene, species (NULL: any), chain (NULL: any). With a loops table, queries of a
    supported species whose V resolves are scored by tcrdist; all others, and those for which no candidate
    can be scored, by the matrix distance, with a warning. Returns neighbours, summary, warnings.
    """
    labelled = "cdr3_b_aa" in index.columns
    q = queries if "chain" in queries.columns else queries.withColumn("chain", F.lit(None).cast("string"))
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in ("cdr3", "v_gene", "j_gene")]))
    incomplete, q = q.filter(F.size(missing) > 0), q.filter(F.size(missing) == 0)
    species = F.nullif(text.species_key(F.col("species")), F.lit(""))
    q = q.withColumn("cdr3", F.upper("cdr3")).withColumn("organism", F.coalesce(species, F.lit("human")))
    warnings = [_warn(incomplete, "query_incomplete", F.concat(F.lit("not searched; missing: "), F.array_join(missing, ", ")))]
    if labelled:
        refused = q.filter(F.col("organism") != "human")
        warnings.append(_warn(refused, "species_unsupported", F.format_string(
            "similarity index is human beta only; species '%s' not supported", F.col("organism"))))
        q = q.filter(F.col("organism") == "human").withColumn("scope", F.lit("*")).withColumn("chain", F.lit("*"))
        index = labelled_as_index(index)
    else:
        q = q.withColumn("scope", F.coalesce(species, F.lit("*"))) \
            .withColumn("chain", F.coalesce(F.nullif(F.col("chain"), F.lit("")), F.lit("*")))
    if loops is not None:
        loops = cut_lineage(loops)
        index = with_loops(index, loops, "v_gene", F.coalesce(F.col("species"), F.lit("human")), few=broadcastable(loops))
    alike = _kept(_alike(_search_frame(index), [] if loops is None else LOOPS), "alike")  # read by every count and search below
    q = cut_lineage(family_block(q, index, alike))
    warnings.append(_warn(q.filter("total_candidates = 0"), "no_reference_candidates",
                          F.lit("no reference candidates for this query")))
    q = q.filter("total_candidates > 0")
    probe = ["qid", "scope", "chain", "family", "cdr3"]
    results = []
    if loops is None:
        by_matrix = q.withColumn("n_skipped", F.lit(0).cast("long"))
    else:
        q = with_loops(q, loops, "v_gene", F.col("organism"))
        q = q.withColumn("block", block_name(F.col("scope"), F.col("chain"), F.col("family")))
        has = F.col("cdr1").isNotNull()
        tally = _counted(alike, F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_scored"),
                         F.sum(F.when(has, 0).otherwise(F.col("n"))).alias("n_skipped")).join(q.select("block").distinct(), "block", "left_semi")
        q = q.join(tally, "block", "left")
        fit = F.col("organism").isin("human", "mouse") & F.col("cdr1").isNotNull() & (F.col("n_scored") > 0)
        q = cut_lineage(q.withColumn("_fit", F.coalesce(fit, F.lit(False))))
        by_tcrdist, by_matrix = q.filter("_fit"), q.filter("not _fit")
        results.append(nearest_records(by_tcrdist.select(*probe, *LOOPS), index.filter(has), top_k, engine="tcrdist",
                                       min_similarity=min_similarity, alike=alike.filter(has)).withColumn("engine", F.lit("tcrdist")))
        warnings.append(_warn(by_tcrdist.filter("n_skipped > 0"), "tcrdist_candidates_skipped", F.format_string(
            "%d candidate(s) skipped: V gene not in the tcrdist reference table", F.col("n_skipped"))))
    results.append(nearest_records(by_matrix.select(*probe), index.drop(*LOOPS), top_k, min_similarity=min_similarity, alike=alike)
                   .withColumn("engine", F.lit("blosum_cdr3")))
    warnings.append(_warn(by_matrix, "tcrdist_unavailable", F.lit(UNAVAILABLE)))
    near = results[0] if len(results) == 1 else results[0].unionByName(results[1])
    context = [c for c in ("epitope_aa", "mhc_class", "mhc_a", "antigen", "antigen_organism", "cluster_id")
               if c in near.columns]
    near = near.select(
        "qid", "rank", "engine", F.col("cdr3_aa").alias("cdr3_b_aa"), F.col("v_gene").alias("v_b_gene"),
        F.col("j_gene").alias("j_b_gene"), F.round("distance", 4).alias("distance"),
        F.round(text.similarity(F.col("distance"), F.col("max_distance")), 4).alias("similarity"),
        *context, "src_row")
    all_warnings = warnings[0]
    for w in warnings[1:]:
        all_warnings = all_warnings.unionByName(w)
    return {"neighbours": near, "summary": q.select("qid", "total_candidates"), "warnings": all_warnings}


def _warn(df: DataFrame, code: str, message: Column) -> DataFrame:
    return df.select("qid", F.lit(code).alias("code"), F.lit("neighbours").alias("block"), message.alias("message"))


# --- pairs ---------------------------------------------------------------------------------------

PAIR_CONTEXT = ["epitope_aa", "antigen", "antigen_organism", "mhc_class", "mhc_a"]


def paired_reference(index: DataFrame) -> DataFrame:
    """One row per species and pairing key that has an alpha and a beta row; the first row of each chain counts.

    Context comes from the beta row, else the alpha row.
    """
    context = [c for c in PAIR_CONTEXT if c in index.columns]
    rows = index.filter(F.col("chain").isin("alpha", "beta") & F.col("pairing_key").isNotNull() & F.col("cdr3_aa").isNotNull())
    value = F.struct("src_row", "cdr3_aa", "v_gene", *context)
    side = rows.withColumn("species", text.species_key(F.col("species"))).groupBy("species", "pairing_key").agg(
        F.min_by(F.when(F.col("chain") == "alpha", value), F.when(F.col("chain") == "alpha", F.col("src_row"))).alias("a"),
        F.min_by(F.when(F.col("chain") == "beta", value), F.when(F.col("chain") == "beta", F.col("src_row"))).alias("b"))
    return side.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).select(
        "species", "pairing_key", F.col("a.cdr3_aa").alias("cdr3_a_aa"), F.col("a.v_gene").alias("v_a_gene"),
        F.col("b.cdr3_aa").alias("cdr3_b_aa"), F.col("b.v_gene").alias("v_b_gene"),
        *[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in context],
        F.col("a.src_row").alias("src_row"))


PAIR_LOOPS = [f"{side}_{c}" for side in "ab" for c in LOOPS]


def find_similar_paired(queries: DataFrame, index: DataFrame, loops: DataFrame | None, top_k: int = 10,
                        min_similarity: float = 0.0) -> dict[str, DataFrame]:
    """Nearest pairs by the sum of the alpha and beta tcrdist; there is no other engine.

    queries: qid, cdr3_a, v_a, cdr3_b, v_b, species. Without a loops table every query is answered by a warning.
    """
    q = queries.withColumn("organism", F.coalesce(F.nullif(text.species_key(F.col("species")), F.lit("")), F.lit("human")))
    if loops is None:
        return {"warnings": _warn(q, "tcrdist_unavailable", F.lit("paired similarity requires a germline loop table"))}
    loops = cut_lineage(loops)
    few = broadcastable(loops)
    bad_species = q.filter(~F.col("organism").isin("human", "mouse"))
    q = q.filter(F.col("organism").isin("human", "mouse"))
    q = with_loops(with_loops(q, loops, "v_a", F.col("organism"), "a_", few), loops, "v_b", F.col("organism"), "b_", few)
    unresolved = F.col("a_cdr1").isNull() | F.col("b_cdr1").isNull()
    no_loops = q.filter(unresolved)
    q = q.filter(~unresolved).withColumn("a_cdr3", F.upper("cdr3_a")).withColumn("b_cdr3", F.upper("cdr3_b"))
    pairs = _kept(paired_reference(index).withColumnRenamed("species", "organism"), "pairs")  # read by the counts, the search and the answer
    pairs = with_loops(with_loops(pairs, loops, "v_a_gene", F.col("organism"), "a_", few), loops, "v_b_gene", F.col("organism"), "b_", few)
    lacking = F.col("a_cdr1").isNull() | F.col("b_cdr1").isNull()
    tally = pairs.groupBy("organism").agg(F.count(F.lit(1)).alias("total_candidates"), F.count_if(lacking).alias("n_skipped"))
    q = cut_lineage(q.join(tally, "organism", "left").fillna(0, ["total_candidates", "n_skipped"]))

    parts = ["a_cdr3", "b_cdr3", *PAIR_LOOPS]
    q = q.withColumn("probe", F.concat_ws("|", *parts))
    scored = pairs.filter(~lacking).withColumn("a_cdr3", F.upper("cdr3_a_aa")).withColumn("b_cdr3", F.upper("cdr3_b_aa")) \
        .withColumn("candidate", F.concat_ws("|", *parts))
    pool = scored.groupBy("organism", *parts).agg(F.min("src_row").alias("first_row"), F.count(F.lit(1)).alias("n"))
    asked = q.select("organism", "probe", *parts).distinct()
    near = nearest_candidates(asked, pool, top_k, "tcrdist", "organism", ["a_cdr3", "b_cdr3"], PAIR_LOOPS).drop("first_row", "n")
    words = sent_if_small(near.select(F.xxhash64("candidate").alias("_word")).distinct(), WORDS_SENT)
    scored = scored.withColumn("_word", F.xxhash64("candidate")).join(words, "_word", "left_semi")
    context = [c for c in PAIR_CONTEXT if c in pairs.columns]
    members = first_rows(scored.join(near.select("organism", "candidate").distinct(), ["organism", "candidate"], "left_semi"),
                         ["organism", "candidate"], [F.col("src_row")], top_k) \
        .select("organism", "candidate", "pairing_key", "cdr3_a_aa", "v_a_gene", "cdr3_b_aa", "v_b_gene", *context, "src_row")
    out = q.select("qid", "organism", "probe").join(near, ["organism", "probe"]).join(members, ["organism", "candidate"])
    sim = text.similarity(F.col("distance"), F.col("max_distance"))
    out = first_rows(out.filter(sim >= min_similarity), ["qid"], [F.col("distance"), F.col("src_row")], top_k)
    out = out.select("qid", "rank", "pairing_key", "cdr3_a_aa", "v_a_gene", "cdr3_b_aa", "v_b_gene",
                     F.round("distance", 4).alias("distance"), F.round(sim, 4).alias("similarity"), *context)
    warnings = _warn(bad_species, "tcrdist_unavailable", F.lit("paired similarity requires a supported species (human or mouse).")) \
        .unionByName(_warn(no_loops, "tcrdist_unavailable", F.lit("a query V gene is not in the tcrdist reference table"))) \
        .unionByName(_warn(q.filter("total_candidates = 0"), "no_reference_candidates",
                           F.lit("no paired (alpha and beta) reference candidates for this species"))) \
        .unionByName(_warn(q.filter("n_skipped > 0"), "tcrdist_candidates_skipped", F.format_string(
            "%d paired candidate(s) skipped: a V gene not in the tcrdist reference table", F.col("n_skipped")))) \
        .unionByName(_warn(q.filter("total_candidates > 0 and n_skipped = total_candidates"), "no_reference_candidates",
                           F.lit("no paired candidate could be scored under tcrdist for this query")))
    return {"neighbours": out, "summary": q.select("qid", "total_candidates", "n_skipped"), "warnings": warnings}
