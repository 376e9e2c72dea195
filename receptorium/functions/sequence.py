"""Column functions over nucleotide and amino-acid strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from receptorium.constants import (
    AMINO_BY_CODON, BACK_CODON, BASE_ORDER, CDR1_SPAN, CDR2_SPAN, STANDARD_AA,
)


def _base(codon: Column, i: int) -> Column:
    return F.instr(F.lit(BASE_ORDER), codon.substr(F.lit(i), F.lit(1)))


def _amino(codon: Column) -> Column:
    a, b, c = _base(codon, 1), _base(codon, 2), _base(codon, 3)
    known = (a > 0) & (b > 0) & (c > 0)
    place = (a - 1) * 16 + (b - 1) * 4 + c
    return F.when(known, F.lit(AMINO_BY_CODON).substr(place, F.lit(1))).otherwise(F.lit("?"))


def translate(nt: Column, frame: int = 0) -> Column:
    """Amino acids of ``nt`` read from ``frame``; unknown codons are ``?``, a partial codon is dropped."""
    s = F.upper(nt)
    if frame:
        s = F.substring(s, frame + 1, 1 << 30)
    codons = F.regexp_extract_all(s, F.lit("(?s)(...)"), F.lit(1))
    return F.array_join(F.transform(codons, _amino), "")


def back_translate(aa: Column) -> Column:
    """One fixed codon per residue, ``NNN`` for anything else.

    Residues go to lower case first, so a written codon (upper case) is never read as residues.
    """
    s = F.lower(aa)
    for residue, codon in BACK_CODON.items():
        s = F.replace(s, F.lit(residue.lower()), F.lit(codon))
    return F.regexp_replace(s, "(?s)[^ACGT]", "NNN")


def count_of(s: Column, letter: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(letter), F.lit("")))


def best_frame(nt: Column, unknown_counts: bool = False) -> Column:
    """Reading frame with fewest stops (and unknowns, if asked); the lowest frame wins ties."""
    options = []
    for frame in range(3):
        aa = translate(nt, frame)
        penalty = count_of(aa, "*") + (count_of(aa, "?") if unknown_counts else F.lit(0))
        options.append(F.struct(penalty.alias("penalty"), F.lit(frame).alias("frame")))
    return F.array_min(F.array(*options))["frame"]


def translate_best_frame(nt: Column, unknown_counts: bool = False) -> Column:
    options = []
    for frame in range(3):
        aa = translate(nt, frame)
        penalty = count_of(aa, "*") + (count_of(aa, "?") if unknown_counts else F.lit(0))
        options.append(F.struct(penalty.alias("penalty"), F.lit(frame).alias("frame"), aa.alias("aa")))
    return F.array_min(F.array(*options))["aa"]


def drop_one_stop(aa: Column) -> Column:
    return F.when(aa.endswith("*"), F.left(aa, F.length(aa) - 1)).otherwise(aa)


def drop_stops(aa: Column) -> Column:
    return F.rtrim(aa, F.lit("*"))


def null_if_empty(s: Column) -> Column:
    return F.when(s != "", s)


def cys_cut(nt: Column) -> Column:
    """Offset of the conserved Cys104 codon: the last C among the final eight residues."""
    aa = translate(nt)
    from_end = F.instr(F.reverse(F.right(aa, F.lit(8))), F.lit("C"))
    whole = F.length(nt) - F.length(nt) % 3 - 3
    return F.when(from_end > 0, (F.length(aa) - from_end) * 3).otherwise(whole)


def frames(nt: Column) -> list[Column]:
    """Translations in the three frames, to be stored as columns ``aa0`` to ``aa2``."""
    return [translate(nt, f).alias(f"aa{f}") for f in range(3)]


def fewest_stops(aa: list[Column]) -> Column:
    counts = [count_of(x, "*") for x in aa]
    return F.when((counts[0] <= counts[1]) & (counts[0] <= counts[2]), 0).when(counts[1] <= counts[2], 1).otherwise(2)


def j_anchor(aa: list[Column]) -> Column:
    """struct(frame, fw): reading frame of a J segment and offset of its F/W118 codon (-1 if none), from its
    translations in the three frames.

    Per frame the tight motif ``[FW]G.G`` is preferred to the loose one; a stop before the motif
    rejects the frame; a stop-free frame beats the others, then the lowest frame.
    """
    options = []
    for frame, x in enumerate(aa):
        tight = F.regexp_instr(x, F.lit("[FW]G.G"))
        at = F.when(tight > 0, tight).otherwise(F.regexp_instr(x, F.lit("[FW].{0,2}?G.G")))
        usable = (at > 0) & ~F.left(x, at - 1).contains("*")
        options.append(F.when(usable, F.struct(
            F.when(x.contains("*"), 1).otherwise(0).alias("stops"), F.lit(frame).alias("frame"),
            ((at - 1) * 3 + frame).cast("int").alias("fw"))))
    best = F.array_min(F.array(*options))  # NULL options are skipped
    return F.struct(F.coalesce(best["frame"], fewest_stops(aa)).alias("frame"), F.coalesce(best["fw"], F.lit(-1)).alias("fw"))


def overlap_end(j_aa: Column, cdr3: Column) -> Column:
    """struct(k, end): longest CDR3 suffix of length k found in the first 15 residues of ``j_aa``
    with no stop up to its end; NULL when there is none."""
    head = F.left(j_aa, F.lit(15))
    longest = F.least(F.length(cdr3), F.length(head))
    sizes = F.when(longest > 0, F.sequence(longest, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))

    def probe(k: Column) -> Column:
        at = F.instr(head, F.right(cdr3, k))
        end = at - 1 + k
        ok = (at > 0) & (F.instr(F.left(j_aa, end), F.lit("*")) == 0)
        return F.when(ok, F.struct(k.alias("k"), end.alias("end")))

    return F.get(F.filter(F.transform(sizes, probe), lambda x: x.isNotNull()), F.lit(0))


def longest_overlap(hits: list[Column]) -> Column:
    """struct(rank, frame, end): best of the overlaps in the three frames, the lowest frame on ties."""
    return F.array_min(F.array(*[F.when(h.isNotNull(), F.struct(
        (-h["k"]).alias("rank"), F.lit(f).alias("frame"), h["end"].alias("end"))) for f, h in enumerate(hits)]))


def framework_start(best: Column, anchor: Column) -> Column:
    """struct(start, frame) of the part of a J segment that follows the CDR3: after the longest overlap, else after
    the F/W118 codon, else from the reading frame."""
    start = F.when(best.isNotNull(), best["frame"] + best["end"] * 3) \
        .when(anchor["fw"] >= 0, anchor["fw"] + 3).otherwise(anchor["frame"])
    return F.struct(start.alias("start"), F.coalesce(best["frame"], anchor["frame"]).alias("frame"))


def framework_after_cdr3(j_nt: Column, j_aa: list[Column], at: Column) -> Column:
    """struct(nt, aa) of that part."""
    aa = F.when(at["frame"] == 0, j_aa[0]).when(at["frame"] == 1, j_aa[1]).otherwise(j_aa[2])
    return F.struct(j_nt.substr(at["start"] + 1, F.length(j_nt)).alias("nt"),
                    aa.substr(F.floor((at["start"] - at["frame"]) / 3).cast("int") + 1, F.length(aa)).alias("aa"))


def loop_aa(aa: Column, span: tuple[int, int]) -> Column:
    return null_if_empty(drop_stops(F.substring(aa, span[0], span[1] - span[0] + 1)))


def loop_nt(nt: Column, span: tuple[int, int]) -> Column:
    return null_if_empty(F.substring(nt, (span[0] - 1) * 3 + 1, (span[1] - span[0] + 1) * 3))


def cdr_loops(nt: Column) -> Column:
    """CDR1 and CDR2 of a V segment, cut at fixed positions of the ungapped translation."""
    aa = translate(nt)
    return F.struct(
        loop_aa(aa, CDR1_SPAN).alias("cdr1_aa"), loop_aa(aa, CDR2_SPAN).alias("cdr2_aa"),
        loop_nt(nt, CDR1_SPAN).alias("cdr1_nt"), loop_nt(nt, CDR2_SPAN).alias("cdr2_nt"),
    )


def kmers(seq: Column, k: int) -> Column:
    """Distinct k-letter words of a sequence, an empty array when it is shorter than k."""
    s = F.upper(seq)
    starts = F.when(F.length(s) >= k, F.sequence(F.lit(1), F.length(s) - (k - 1)))
    words = F.transform(starts, lambda i: s.substr(i, F.lit(k)))
    return F.coalesce(F.array_distinct(words), F.array().cast("array<string>"))


def alignable(aa: Column) -> Column:
    """Letters foreign to the substitution matrix become X."""
    return F.regexp_replace(aa, f"(?s)[^{STANDARD_AA}BZX*]", "X")


def thread_codons(gapped_aa: Column, coding_nt: Column) -> Column:
    """Codons laid under a gapped amino-acid row; gap columns become ``---``."""
    runs = F.split(gapped_aa, "(?<=-)(?=[^-])|(?<=[^-])(?=-)")  # gaps and residues in turn
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def lay(acc: Column, run: Column) -> Column:
        gap, n = run.startswith("-"), F.length(run)
        piece = F.when(gap, F.repeat(F.lit("---"), n)).otherwise(coding_nt.substr(acc["pos"] * 3 + 1, n * 3))
        return F.struct((acc["pos"] + F.when(gap, 0).otherwise(n)).alias("pos"), F.concat(acc["out"], piece).alias("out"))

    return F.when(F.length(gapped_aa) > 0, F.aggregate(runs, start, lay, lambda acc: acc["out"])).otherwise(F.lit(""))
