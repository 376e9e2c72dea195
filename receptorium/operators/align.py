"""Multiple alignment of sets: centre choice, merging on the centre, and column statistics.

A set may be of any size. The quadratic part (summed pair scores, pair identities) runs in bounded
pieces and returns sums, never pairs.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from receptorium.functions import kernels, sequence, text
from receptorium.operators.pairwise import meet
from receptorium.session import spread
from receptorium.sources.germline import germline_species

MEMBERS_PER_TASK, PAIRS_AT_ONCE, TRACES_AT_ONCE = 256, 512, 32
PATTERNS_PER_TASK = 256

# --- fixed values: gap costs of the global alignment ------------------------------------------------
AA_GAPS, NT_GAPS = (-10.0, -0.5), (-5.0, -0.5)


def _cost(seq_type: str) -> dict:
    if seq_type == "aa":
        return {"scores": kernels.blosum(), "opening": AA_GAPS[0], "extend": AA_GAPS[1]}
    return {"scores": None, "opening": NT_GAPS[0], "extend": NT_GAPS[1]}


def _safe(seq_type: str) -> Column:
    return sequence.alignable(F.col("seq")) if seq_type == "aa" else F.col("seq")


def summed_scores(members: DataFrame, seq_type: str) -> DataFrame:
    """(set_id, safe, score): sum of the alignment scores of a sequence against all other rows of its set."""
    distinct = members.withColumn("safe", _safe(seq_type)).groupBy("set_id", "safe").agg(F.count(F.lit(1)).alias("n"))
    cost = _cost(seq_type)

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        columns = ["set_id", "safe", "part"]
        if a.empty or b.empty:
            return pd.DataFrame(columns=columns)
        b = b.sort_values("safe")
        left, right, n_left, n_right = a["safe"].tolist(), b["safe"].tolist(), a["n"].to_numpy(), b["n"].to_numpy()
        own, theirs = np.zeros(len(left)), np.zeros(len(right))
        for i, s in enumerate(left):  # the cost is symmetric: of two sequences the lesser one meets the other
            for start in range(bisect_left(right, s), len(right), PAIRS_AT_ONCE):
                part = slice(start, start + PAIRS_AT_ONCE)
                others = right[part]
                d = kernels.global_scores([s] * len(others), others, **cost).astype("float64")
                same = np.array([o == s for o in others])
                own[i] += float((d * (n_right[part] - same)).sum())  # a row is not compared with itself
                theirs[part] += np.where(same, 0, d * n_left[i])
        return pd.DataFrame({"set_id": a["set_id"].iat[0], "safe": left + right, "part": np.concatenate([own, theirs])})

    met = meet(distinct, distinct, ["set_id"], ["safe"], ["safe"], MEMBERS_PER_TASK, MEMBERS_PER_TASK,
               score, "set_id string, safe string, part double")
    return met.groupBy("set_id", "safe").agg(F.sum("part").alias("score"))


def choose_centers(members: DataFrame, seq_type: str) -> DataFrame:
    """(set_id, center): the row with the largest summed score, the first row among equals."""
    scored = members.withColumn("safe", _safe(seq_type)).join(summed_scores(members, seq_type), ["set_id", "safe"])
    return scored.groupBy("set_id").agg(F.max_by("seq", F.struct("score", -F.col("ord"))).alias("center"))


_ROWS = StructType([StructField("columns", StringType()), StructField("inserts", ArrayType(StringType()))])


def _on_center(seq_type: str):
    cost = _cost(seq_type)

    @F.pandas_udf(_ROWS)
    def align(center: pd.Series, seq: pd.Series, safe_center: pd.Series, safe_seq: pd.Series) -> pd.DataFrame:
        out = []
        for start in range(0, len(seq), TRACES_AT_ONCE):
            part = slice(start, start + TRACES_AT_ONCE)
            pairs = kernels.aligned_pairs(list(safe_center[part]), list(safe_seq[part]), False, **cost)[1]
            for c, s, (ts, qs) in zip(center[part], seq[part], pairs):
                columns, inserts, slot = ["-"] * len(c), [""] * (len(c) + 1), 0
                row_c, row_s = kernels.gapped(c, s, ts, qs)
                for x, y in zip(row_c, row_s):
                    if x == "-":
                        inserts[slot] += y
                    else:
                        columns[slot] = y
                        slot += 1
                out.append(("".join(columns), inserts))
        return pd.DataFrame(out, columns=["columns", "inserts"])

    return align


def align_set(members: DataFrame, seq_type: str = "nt") -> DataFrame:
    """Center-star alignment of sets (set_id, name, seq, ord): rows (set_id, name, ord, aligned).

    Every sequence is aligned to the centre; a centre position is one column, and the letters inserted
    before it share a block as wide as the widest insertion there, left-justified. Sets with fewer than two
    sequences give no rows (see ``set_warnings``).
    """
    big = members.groupBy("set_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").select("set_id")
    rows = members.join(big, "set_id", "left_semi")
    centers = choose_centers(rows, seq_type)
    safe = sequence.alignable if seq_type == "aa" else (lambda c: c)
    distinct = rows.select("set_id", "seq").distinct().join(centers, "set_id")
    parts = spread(distinct, "set_id", "seq").withColumn("p", _on_center(seq_type)(F.col("center"), F.col("seq"), safe(F.col("center")), safe(F.col("seq")))) \
        .select("set_id", "seq", F.length("center").alias("_len"), "p.*")
    wide = parts.select("set_id", F.posexplode("inserts").alias("slot", "ins")).filter(F.length("ins") > 0) \
        .groupBy("set_id", "slot").agg(F.max(F.length("ins")).alias("w"))
    widths = wide.groupBy("set_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "w"))).alias("widths"))
    merged = parts.join(widths, "set_id", "left")
    width = lambda i: F.coalesce(F.try_element_at(F.coalesce("widths", F.create_map().cast("map<int,int>")), i), F.lit(0))
    cells = F.transform(F.sequence(F.lit(0), F.col("_len")), lambda i: F.concat(
        F.rpad(F.col("inserts")[i], width(i), "-"), F.col("columns").substr(i + 1, F.lit(1))))
    return rows.join(merged.select("set_id", "seq", F.array_join(cells, "").alias("aligned")), ["set_id", "seq"]) \
        .select("set_id", "name", "ord", "aligned")


def set_warnings(members: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested sets that have fewer than two sequences."""
    n = members.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    return requests.select("set_id").join(n, "set_id", "left").filter(F.coalesce("n", F.lit(0)) < 2).select(
        F.col("set_id").alias("qid"), F.lit("too_few_sequences").alias("code"), F.lit("alignment").alias("block"),
        F.lit("at least two sequences are required to align").alias("message"))


def align_codon(members: DataFrame) -> DataFrame:
    """Codon-aware alignment of nucleotide sets: each row in its own best frame, aligned as protein, then threaded."""
    frame = sequence.best_frame(F.col("seq"), unknown_counts=True)
    coding = F.expr("substr(seq, _f + 1, cast(floor((length(seq) - _f) / 3) as int) * 3)")
    rows = members.withColumn("_f", frame).withColumn("coding", coding).withColumn("aa", sequence.translate(F.col("coding")))
    aligned = align_set(rows.select("set_id", "name", "ord", F.col("aa").alias("seq")), "aa")
    return aligned.join(rows.select("set_id", "ord", "coding"), ["set_id", "ord"]).select(
        "set_id", "name", "ord", F.col("aligned").alias("aligned_aa"),
        sequence.thread_codons(F.col("aligned"), F.col("coding")).alias("aligned_nt"))


# --- column statistics -------------------------------------------------------------------------------

def column_counts(aligned: DataFrame) -> DataFrame:
    """(set_id, pos, ch, n, first): how often a letter stands in a column and its first row."""
    cells = aligned.select("set_id", "ord", F.posexplode(F.split("aligned", "")).alias("pos", "ch")).filter("ch <> ''")
    return cells.groupBy("set_id", "pos", "ch").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))


def column_tops(aligned: DataFrame) -> DataFrame:
    """(set_id, pos, rows, ch, n): most common non-gap letter of every column, the earliest row on ties."""
    letter = F.when(F.col("ch") != "-", F.struct("ch", "n"))
    return column_counts(aligned).groupBy("set_id", "pos").agg(
        F.sum("n").alias("rows"), F.max_by(letter, F.when(F.col("ch") != "-", F.struct("n", -F.col("first")))).alias("t")) \
        .select("set_id", "pos", "rows", "t.ch", F.coalesce("t.n", F.lit(0)).alias("n"))


def consensus(aligned: DataFrame) -> DataFrame:
    """Per set: the majority letter (more than half of all rows), X without one, a gap for an all-gap column;
    and the share of the most common letter."""
    letter = F.when(F.col("ch").isNull(), "-").when(F.col("n") > F.col("rows") / 2, F.col("ch")).otherwise("X")
    cols = F.sort_array(F.collect_list(F.struct("pos", letter.alias("l"), F.round(F.col("n") / F.col("rows"), 3).alias("c"))))
    return column_tops(aligned).groupBy("set_id").agg(cols.alias("_c")).select(
        "set_id", F.array_join(F.transform("_c", lambda x: x["l"]), "").alias("consensus"),
        F.transform("_c", lambda x: x["c"]).alias("conservation"))


def mean_identity(aligned: DataFrame) -> DataFrame:
    """(set_id, mean_pct_identity): mean over row pairs of matches / columns that are not gaps in both.

    Rows with the same gap pattern share every denominator, so matches are summed from the letter
    counts of pattern pairs instead of row pairs.
    """
    rows = aligned.withColumn("pattern", F.regexp_replace("aligned", "[^-]", "x"))
    sizes = rows.groupBy("set_id").agg(F.count(F.lit(1)).alias("rows"))
    cells = rows.select("set_id", "pattern", F.posexplode(F.split("aligned", "")).alias("pos", "ch")).filter("ch <> '' and ch <> '-'")
    counts = cells.groupBy("set_id", "pattern", "pos", "ch").agg(F.count(F.lit(1)).alias("n"))
    shapes = rows.groupBy("set_id", "pattern").agg(F.count(F.lit(1)).alias("members")).join(
        counts.groupBy("set_id", "pattern").agg(F.collect_list(F.struct("pos", "ch", "n")).alias("cells")), ["set_id", "pattern"], "left")

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=["set_id", "total"])
        length = len(a["pattern"].iat[0])
        left, right = _letter_matrix(a, length), _letter_matrix(b, length)
        gap = lambda df: np.array([[ch == "-" for ch in p] for p in df["pattern"]], dtype=np.float64).reshape(len(df), length)
        columns = length - gap(a) @ gap(b).T
        same = np.zeros(columns.shape)
        for ch in left.keys() & right.keys():
            same += left[ch] @ right[ch].T
        first, second = a["pattern"].to_numpy()[:, None], b["pattern"].to_numpy()[None]
        inside = (same - a["members"].to_numpy()[:, None] * columns) / 2  # pairs inside one pattern
        matches = np.where(first == second, inside, same)
        use = (second >= first) & (columns > 0)  # each pair of patterns once
        total = 100.0 * float((matches[use] / columns[use]).sum())
        return pd.DataFrame({"set_id": [a["set_id"].iat[0]], "total": [total]})

    met = meet(shapes, shapes, ["set_id"], ["pattern"], ["pattern"], PATTERNS_PER_TASK, PATTERNS_PER_TASK, score, "set_id string, total double")
    sums = met.groupBy("set_id").agg(F.sum("total").alias("total"))
    pairs = F.col("rows") * (F.col("rows") - 1) / 2
    return sizes.join(sums, "set_id", "left").select("set_id", F.when(F.col("rows") < 2, 100.0).otherwise(
        F.round(F.col("total") / pairs, 2)).alias("mean_pct_identity"))


def _letter_matrix(df: pd.DataFrame, length: int) -> dict[str, np.ndarray]:
    out: dict[str, np.ndarray] = {}
    for row, cells in enumerate(df["cells"]):
        for c in (cells if cells is not None else ()):
            out.setdefault(c["ch"], np.zeros((len(df), length)))[row, c["pos"]] = c["n"]
    return out


def alignment_summary(aligned: DataFrame) -> DataFrame:
    size = aligned.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_sequences"), F.max(F.length("aligned")).alias("alignment_length"))
    return size.join(consensus(aligned), "set_id").join(mean_identity(aligned), "set_id").withColumn("engine", F.lit("center_star"))


# --- where the sequences of a set come from -------------------------------------------------------------

def resolve_sets(requests: DataFrame, genes: DataFrame, provided: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Members and warnings of alignment requests.

    requests: set_id, species, chain, segment, genes (array), translate. Provided sequences (set_id, name,
    seq, ord) win over a gene list, a gene list over a germline set. ``genes`` are representative genes.
    """
    r = requests
    members = []
    if provided is not None:
        members.append(provided.join(r.select("set_id"), "set_id", "left_semi").select("set_id", "name", "seq", "ord"))
        r = r.join(provided.select("set_id").distinct(), "set_id", "left_anti")
    r = r.withColumn("_sp", germline_species(F.col("species")))
    best = lambda seq: F.when(F.col("translate"), sequence.translate_best_frame(seq, unknown_counts=True)).otherwise(seq)
    g = genes.select(F.col("species").alias("_sp"), F.col("chain").alias("_gc"), F.col("segment").alias("_gs"), F.col("gene").alias("_g"), "nt")
    named = r.filter(F.size("genes") > 0).select("set_id", "_sp", "translate", F.posexplode("genes").alias("ord", "asked")) \
        .withColumn("base", text.gene_base(F.col("asked")))
    found = named.join(g.withColumnRenamed("_sp", "_gsp"), (F.col("_sp") == F.col("_gsp")) & (F.col("base") == F.col("_g"))
                       & (F.substring("base", 1, 3) == F.col("_gc")) & (F.substring("base", 4, 1) == F.col("_gs")), "left")
    members.append(found.filter("nt is not null").select("set_id", F.col("base").alias("name"), best(F.col("nt")).alias("seq"), F.col("ord").cast("long")))
    unknown = found.filter("nt is null").select(F.col("set_id").alias("qid"), F.lit("ambiguous_gene").alias("code"), F.lit("alignment").alias("block"),
                                                F.format_string("gene %s not resolvable from germline", F.col("asked")).alias("message"))
    sets = r.filter((F.coalesce(F.size("genes"), F.lit(0)) <= 0) & F.col("chain").isNotNull() & F.col("segment").isNotNull()) \
        .withColumns({"_c": F.upper("chain"), "_s": F.upper("segment")})
    full = sets.join(g.withColumnRenamed("_sp", "_gsp").filter(F.col("_gs").isin("V", "J", "C")),
                     (F.col("_sp") == F.col("_gsp")) & (F.col("_c") == F.col("_gc")) & (F.col("_s") == F.col("_gs")), "left")
    rank = F.dense_rank().over(Window.partitionBy("set_id").orderBy("_g"))
    members.append(full.filter("nt is not null").select("set_id", F.col("_g").alias("name"), best(F.col("nt")).alias("seq"), rank.cast("long").alias("ord")))
    absent = full.filter("nt is null").select(
        F.col("set_id").alias("qid"), F.lit("segment_unavailable").alias("code"), F.lit("alignment").alias("block"),
        F.format_string("segment %s not available in the germline source for %s/%s", F.col("segment"), F.col("chain"), F.col("species")).alias("message"))
    out = members[0].withColumn("ord", F.col("ord").cast("long"))
    for m in members[1:]:
        out = out.unionByName(m)
    return out, unknown.unionByName(absent)
