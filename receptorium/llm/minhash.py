"""Near-duplicate classes by ProbMinHash signatures, banding and exact verification.

A text is the multiset of its five-word shingles, as a probability distribution; similarity is the probability Jaccard index
(plain Jaccard where no shingle repeats). Every shingle is a Poisson process of arrivals whose rate is its weight; each
arrival draws a register, and the first arrival at a register wins it. Only shingles whose next arrival comes before the
latest register is filled stay in play, so most stop after one arrival. Bands of registers bring candidates together, byte
signatures sort out the hopeless, and every link is verified on the shingles themselves.

Copies meet by a digest of the text before anything else. Buckets are compared in bounded blocks, and only links that span
what is alike leave a block: first every block by itself, then pairs of blocks across the components found so far, where the
largest component of a bucket does not meet itself. Likely links (by byte signatures) make families; inside a family the same
two rounds run on the shingles themselves and give the verified links, so no pair within a family goes untested unless it is
joined already, and no list of pairs grows with the square of a group.

Defined cases: null, empty and blank texts have no shingles and are classes of their own; texts of fewer than five words are
one shingle; copies share a class; a null doc_id is carried along and never names a class unless all ids of it are null;
repeated rows stay repeated; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from receptorium.llm.groups import MEETING, blocks, linked
from receptorium.llm.shared import prepared, row_slices, text_buffer, tidy, written
from receptorium.llm.words import between_spaces, mix, word_table

SHINGLE = 5
THRESHOLD = 0.8
REGISTERS = 128
ROWS = 4  # 32 bands of 4: a pair at 0.8 is missed once in 2 * 10**7
ESTIMATE = THRESHOLD - 4.5 * (THRESHOLD * (1 - THRESHOLD) / REGISTERS) ** 0.5  # 4.5 standard errors below the threshold
BLOCK = 1024  # texts of a block that meet by byte signatures
BAG_BLOCK = 512  # texts of a block that meet by their shingles
SLICE_BYTES = 3 << 20
_ONE = np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _salt(n: int) -> np.uint64:
    return np.uint64(n * int(_STEP) & 0xFFFFFFFFFFFFFFFF)


def shingles_of(data: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, count) of every row's distinct shingles, in order of row and hash."""
    _, _, code, row = word_table(data, at, between_spaces())
    rows = len(at) - 1
    many = np.bincount(row, minlength=rows)
    begin = np.cumsum(many) - many
    place = np.arange(len(code)) - begin[row]
    width = np.minimum(many, size)[row]
    value = np.zeros(len(code), np.uint64)
    for j in range(size):
        use = np.flatnonzero((j < width) & (place + width <= many[row]))
        value[use] = mix(value[use] * _STEP + code[use + j] + _ONE)
    full = place + width <= many[row]
    row, value = row[full], value[full]
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    return row[first], value[first], np.diff(np.append(first, len(row)))


def signatures(row: np.ndarray, value: np.ndarray, weight: np.ndarray, rows: int, registers: int = REGISTERS) -> np.ndarray:
    """Winning shingle hash per register (rows x registers); rows without shingles are zeros."""
    when = np.full(rows * registers, np.inf)
    winner = np.zeros(rows * registers, np.uint64)
    table, latest = when.reshape(rows, registers), np.full(rows, np.inf)
    clock, who = np.zeros(len(row)), np.arange(len(row))
    draw = 0
    while len(who):
        draw += 1
        noise = mix(value[who] ^ _salt(2 * draw))
        clock = clock - np.log((noise >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 + 2.0 ** -54) / weight[who]
        if draw > 1:  # arrivals after the latest register of their row change nothing, nor do later ones
            live = clock < latest[row[who]]
            who, clock = who[live], clock[live]
        slot = row[who] * registers + (mix(value[who] + _salt(2 * draw + 1)) % np.uint64(registers)).astype(np.int64)
        better = clock < when[slot]
        at, seen, by = slot[better], clock[better], who[better]
        order = np.argsort(-seen, kind="stable")  # the earliest arrival is written last
        when[at[order]], winner[at[order]] = seen[order], value[by[order]]
        busy = np.unique(row[who]) if draw > 1 else np.arange(rows)
        latest[busy] = table[busy].max(1)
        live = clock < latest[row[who]]
        who, clock = who[live], clock[live]
    return winner.reshape(rows, registers)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard index of two (sorted hashes, counts): the chance that one Poisson process over the shared
    shingles comes first in both."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    p, q = a[1] / a[1].sum(), b[1] / b[1].sum()
    only = [np.delete(p, i), np.delete(q, j)]
    ratio = p[i] / q[j]
    order = np.argsort(ratio)
    ratio, p, q = ratio[order], p[i][order], q[j][order]
    # sum over d of max(p_d / p_c, q_d / q_c), for c common: q wins where d's ratio is at most c's
    up = np.cumsum(q)
    down = p.sum() - np.cumsum(p)
    total = (down + only[0].sum()) / p + (up + only[1].sum()) / q
    return float((1 / total).sum())


def _signer(registers: int, rows_per_band: int):
    def sign(batches):
        for batch in batches:
            data, at = text_buffer(batch.column("text"))
            sig, band = np.zeros((batch.num_rows, registers), np.uint8), np.zeros((batch.num_rows, registers // rows_per_band), np.uint64)
            n = np.zeros(batch.num_rows, np.int64)
            for lo, hi in row_slices(at, SLICE_BYTES):
                row, value, weight = shingles_of(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
                whole = signatures(row, value, weight, hi - lo, registers)
                sig[lo:hi] = (whole & np.uint64(255)).astype(np.uint8)
                n[lo:hi] = np.bincount(row, minlength=hi - lo)
                code = np.zeros((hi - lo, band.shape[1]), np.uint64) + np.arange(band.shape[1], dtype=np.uint64)
                for j in range(rows_per_band):
                    code = mix(code * _STEP + whole[:, j::rows_per_band])
                band[lo:hi] = code
            keep = np.flatnonzero(n)
            size = band.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(keep)), batch.column("_text").take(pa.array(keep)),
                 pa.FixedSizeBinaryArray.from_buffers(pa.binary(registers), len(keep), [None, pa.py_buffer(sig[keep].tobytes())]).cast(pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, size * len(keep) + 1, size, dtype=np.int32)), pa.array(band[keep].view(np.int64).ravel()))],
                names=["doc_id", "_text", "_sig", "_bands"])
    return sign


def _estimates(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Estimated similarity of all pairs of byte signatures of two bounded blocks."""
    same = np.empty((len(left), len(right)), np.float32)
    for i in range(len(left)):
        same[i] = (right == left[i]).mean(1)
    return (same - 1 / 256) / (1 - 1 / 256)


def _sig_rows(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def _likely(frames):
    """Links that span the likely pairs (by estimate) of different components in each pair of blocks."""
    out = []
    for g in blocks(frames, ["_text", "_sig", "_comp", "_side"], MEETING):
        left, right = np.flatnonzero(g["_side"] <= 1), np.flatnonzero(g["_side"] != 1)  # side 0: the block meets itself
        comp = g["_comp"]
        if len(comp) < 2 or not len(left) or not len(right) or (comp == comp[0]).all():
            continue
        sig = _sig_rows(g["_sig"])
        near = _estimates(sig[left], sig[right]) >= ESTIMATE
        near &= comp[left][:, None] != comp[right][None]
        place = np.full(len(comp), -1)
        place[right] = np.arange(len(right))
        seen = np.zeros(len(comp), bool)
        for start in left[near.any(1)]:
            queue = [] if seen[start] else [start]
            while queue:
                node = queue.pop()
                seen[node] = True
                other = []
                if g["_side"][node] <= 1:
                    other.append(right[near[np.searchsorted(left, node)]])
                if place[node] >= 0:
                    other.append(left[near[:, place[node]]])
                fresh = np.unique(np.concatenate(other))
                fresh = fresh[~seen[fresh]]
                seen[fresh] = True
                out += [(g["_text"][node], g["_text"][x]) for x in fresh]
                queue += fresh.tolist()
        if len(out) > 20_000:
            yield pd.DataFrame(out, columns=["a", "b"])
            out = []
    yield pd.DataFrame(out, columns=["a", "b"])


def _similar_to(own: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Exact similarity of one text to several; plain counting where no shingle repeats."""
    out = np.zeros(len(others))
    size = np.array([len(o[0]) for o in others])
    flat = np.concatenate([o[0] for o in others])
    at = np.minimum(np.searchsorted(own[0], flat), len(own[0]) - 1)
    shared = np.add.reduceat((own[0][at] == flat).astype(np.int64), np.cumsum(size) - size)
    out = shared / (size + len(own[0]) - shared)
    plain = (own[1] == 1).all()
    for i, other in enumerate(others):
        if not (plain and (other[1] == 1).all()):
            out[i] = similarity(own, other)
    return out


def _verified(frames):
    """Links that span the pairs of different components at or above the threshold, each verified on its shingles. Likely
    pairs are tested unless the links found so far join them already."""
    out = []
    for g in blocks(frames, ["_text", "_sig", "_comp", "_side", "_hash", "_count"], MEETING):
        left, right = np.flatnonzero(g["_side"] <= 1), np.flatnonzero(g["_side"] != 1)
        if len(g["_comp"]) < 2 or not len(left) or not len(right):
            continue
        _, label = np.unique(g["_comp"], return_inverse=True)
        if label.max() == 0:
            continue
        sig = _sig_rows(g["_sig"])
        near = _estimates(sig[left], sig[right]) >= ESTIMATE
        bag = [(np.frombuffer(h, np.uint64), np.frombuffer(c, np.int32)) for h, c in zip(g["_hash"], g["_count"], strict=True)]
        for i, v in enumerate(left):
            try_ = right[near[i]]
            try_ = try_[label[try_] != label[v]]
            if not len(try_):
                continue
            score = _similar_to(bag[v], [bag[w] for w in try_])
            for w, value in zip(try_, score, strict=True):
                if value >= THRESHOLD and label[w] != label[v]:
                    out.append((g["_text"][v], g["_text"][w], float(value)))
                    label[label == label[w]] = label[v]
        if len(out) > 20_000:
            yield pd.DataFrame(out, columns=["a", "b", "similarity"])
            out = []
    yield pd.DataFrame(out, columns=["a", "b", "similarity"])


def _bags(batches):
    """Shingle hashes and counts of texts, in order of the hash."""
    for batch in batches:
        data, at = text_buffer(batch.column("text"))
        hashes, counts = [], []
        for lo, hi in row_slices(at, SLICE_BYTES):
            row, value, weight = shingles_of(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
            edge = np.searchsorted(row, np.arange(hi - lo + 1))
            hashes += [value[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
            counts += [weight[a:b].astype(np.int32).tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("_text"), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], names=["_text", "_hash", "_count"])


def _digest() -> Column:
    """Digest of a text with a word; null for null, empty and blank texts."""
    return F.when(F.col("text").rlike(r"[^\x00\x20\x09-\x0D]"), F.unhex(F.md5("text")))


def near_classes(docs: DataFrame, registers: int = REGISTERS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(members, links). members: one row per row of ``docs``, with doc_id, _text (digest, null for blank texts), _comp, class_id
    (least doc_id of the class), class_size (rows). links: verified pairs of texts at or above the threshold that join the
    classes."""
    prepared(docs.sparkSession)
    spark = docs.sparkSession
    bodies = docs.select("doc_id", "text", _digest().alias("_text")).filter(F.col("_text").isNotNull())
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = written(bodies.mapInArrow(tidy(_signer(registers, rows)), f"doc_id {kind}, _text binary, _sig binary, _bands array<bigint>"), "signed")
    counts = signed.groupBy("_text").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    counts = counts.withColumnRenamed("_text", "_own")
    one = signed.join(counts, (F.col("_text") == F.col("_own")) & F.col("doc_id").eqNullSafe(F.col("_first"))).dropDuplicates(["_text"])
    texts = written(one.select("_text", "_first", "_rows", "_sig", "_bands"), "texts")
    flat = texts.select("_text", F.explode("_bands").alias("_bucket"))
    shared = flat.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    bucket = written(flat.join(shared, "_bucket").select("_bucket", "_text", "_n"), "buckets")
    sig = texts.select("_text", "_sig")
    _, family = linked(bucket, sig, _likely, "a binary, b binary", BLOCK)
    many = family.groupBy("_comp").agg(F.count(F.lit(1)).alias("_n"))
    family = family.join(many, "_comp").select(F.col("_comp").alias("_bucket"), "_text", "_n")
    chosen = texts.join(family.select(F.col("_text").alias("_want")), F.col("_text") == F.col("_want"), "left_semi").select(F.col("_text").alias("_want"), "_first")
    body = (bodies.join(chosen, (F.col("_text") == F.col("_want")) & F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi")
            .mapInArrow(tidy(_bags), "_text binary, _hash binary, _count binary").dropDuplicates(["_text"]))
    payload = written(body.join(sig, "_text"), "bags")
    links, comp = linked(family, payload, _verified, "a binary, b binary, similarity double", BAG_BLOCK)
    comp = texts.select("_text", "_first", "_rows").join(comp, "_text", "left").withColumn("_comp", F.coalesce("_comp", "_text"))
    sizes = comp.groupBy("_comp").agg(F.min("_first").alias("class_id"), F.sum("_rows").alias("class_size"))
    named = written(comp.join(sizes, "_comp").select("_text", "_comp", "class_id", "class_size"), "classes")
    all_rows = docs.select("doc_id", _digest().alias("_text"))
    out = all_rows.join(named, "_text", "left").select(
        "doc_id", "_text", "_comp", F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))
    return out, links


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every class, that with the least doc_id; all columns as they are."""
    members, _ = near_classes(docs)
    name = "_row"
    while name in docs.columns:
        name += "_"
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_text")).alias("_kept")
    kept = written(members.filter(F.col("_text").isNotNull()).groupBy("_comp").agg(first).select("_kept.doc_id", "_kept._text"), "kept")
    whole = docs.select(F.struct("*").alias(name), F.col("doc_id").alias("_id"), _digest().alias("_digest"))
    found = whole.join(kept, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_digest") == F.col("_text")), "left_semi")
    blank = whole.filter(F.col("_digest").isNull())
    return found.dropDuplicates(["_id", "_digest"]).unionByName(blank).select(f"{name}.*")
