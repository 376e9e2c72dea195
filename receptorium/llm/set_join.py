"""Jaccard join on word shingles, and its components, by set-relation skipping.

A text is the set of its distinct four-word shingles. Sets are ordered by one global order, common shingles last, and every set offers
the shingles of its prefix to lists; two sets at or above the threshold share a list in which the positions still allow the needed
overlap. Inside a list, entries stand in blocks of one size, by position: a block whose first position is too late for another
block is skipped as a whole, and so is the rest of a block behind the last fitting position. Lists that hold the same sets are searched once.

What remains are candidates. Parity bit maps bound their symmetric difference from below; candidates within the bound make families, and
members of a family are compared exactly: the overlaps of a set with all others of a block are derived from those of the set before it,
by the lists of the shingles in which the two differ, and counted anew only where they differ in more than the set holds. Links that span
components leave a task, never all pairs of a group; as in ``groups.linked``, blocks that hold different components all meet, so no
link between different components is lost.

Copies meet by the digest of their set beforehand. The common shingles are those found more often than once in 2^20 of all; there are
less than 2^20 of them, which bounds what is broadcast, and by that a list of another shingle is never longer than 2^-20 of all
shingles (and one entry a task). Words, shingles and sets compare by 64-bit hashes.

Defined cases: null, empty and blank texts have empty sets, are linked with nothing and are their own component; fewer than four words are
one shingle; a null doc_id never names a component unless all ids of it are null; repeated rows stay repeated; other columns play
no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from receptorium.llm.groups import MEETING, blocks, linked
from receptorium.llm.shared import prepared, row_slices, text_buffer, tidy, written
from receptorium.llm.words import between_spaces, mix, word_table

SHINGLE = 4
NUMERATOR, DENOMINATOR = 85, 100
COMMON_BITS = 20
COUNTED = 1 << 22  # shingles whose repetitions a task counts at once
BLOCK, BAG_BLOCK = 1024, 256
LEAST_BITS, MOST_BITS = 256, 1 << 16
SLICE_BYTES = 3 << 20
_ONE, _STEP = np.uint64(1), np.uint64(0x9E3779B97F4A7C15)


def _words() -> np.ndarray:
    """Byte map of words between white space; a zero byte is a letter like others (0xFF is in no UTF-8 text)."""
    table = between_spaces()
    table[0] = 0xFF
    return table


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle hash) of every row's distinct shingles, in order of row and hash."""
    _, _, code, row = word_table(data, at, _words())
    many = np.bincount(row, minlength=len(at) - 1)
    place = np.arange(len(code)) - (np.cumsum(many) - many)[row]
    width = np.minimum(many, size)[row]
    full = np.flatnonzero(place + width <= many[row])
    value = np.zeros(len(full), np.uint64)
    for j in range(size):
        use = j < width[full]
        value[use] = mix(value[use] * _STEP + code[full[use] + j] + _ONE)
    row = row[full]
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def needed(a, b):
    """Least overlap of linked sets of sizes a and b."""
    return -(-NUMERATOR * (a + b) // (NUMERATOR + DENOMINATOR))


def prefix_length(n):
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def bits_of(n: int) -> int:
    """Width of a set's bit map: a power of two of at least half the set."""
    return int(min(MOST_BITS, max(LEAST_BITS, 1 << max(0, (int(n) - 1) // 2).bit_length())))


def bit_map(tokens: np.ndarray) -> np.ndarray:
    """Parity of the shingles that fall on each bit: maps of two sets differ in at most as many bits as the sets in shingles."""
    width = bits_of(len(tokens))
    odd = np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def _digests(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, digest) of every row's set."""
    n = np.bincount(row, minlength=rows)
    total = np.zeros(rows, np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        total[full] = np.add.reduceat(mix(value ^ _STEP), (np.cumsum(n) - n)[full])
    return n, mix(total + n.astype(np.uint64))


_SIZED = "doc_id {0}, n long, _text long, _sig binary, token long, many long"


def _sizer(batches):
    """Task body: size, digest and bit map of every row's set, and the shingles found repeatedly in the sets of a stretch of the task."""
    held, count = [], 0

    def repeated(values):
        token, many = np.unique(np.concatenate(values), return_counts=True)
        often = many >= max(2, int(many.sum()) >> COMMON_BITS)
        return token[often].view(np.int64), many[often]

    kind = pa.int64()
    for batch in batches:
        kind = batch.column("doc_id").type
        data, at = text_buffer(batch.column("text"))
        sizes, digests, maps = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64), [None] * batch.num_rows
        for lo, hi in row_slices(at, SLICE_BYTES):
            row, value = shingle_sets(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
            sizes[lo:hi], digests[lo:hi] = _digests(row, value, hi - lo)
            edge = np.append(0, np.cumsum(sizes[lo:hi]))
            for i in np.flatnonzero(sizes[lo:hi]):
                maps[lo + i] = bit_map(value[edge[i]:edge[i + 1]]).tobytes()
            held.append(value)
            count += len(value)
        yield _sized(batch.column("doc_id"), pa.array(sizes), pa.array(digests.view(np.int64), mask=sizes == 0), pa.array(maps, pa.binary()), None, None, batch.num_rows)
        if count >= COUNTED:
            token, many = repeated(held)
            yield _sized(None, None, None, None, pa.array(token), pa.array(many), len(token), kind)
            held, count = [], 0
    if held:
        token, many = repeated(held)
        yield _sized(None, None, None, None, pa.array(token), pa.array(many), len(token), kind)


def _sized(ids, n, digest, maps, token, many, rows, kind=None):
    void = lambda t: pa.nulls(rows, t)
    return pa.RecordBatch.from_arrays(
        [void(kind) if ids is None else ids, void(pa.int64()) if n is None else n, void(pa.int64()) if digest is None else digest, void(pa.binary()) if maps is None else maps,
         void(pa.int64()) if token is None else token, void(pa.int64()) if many is None else many], names=["doc_id", "n", "_text", "_sig", "token", "many"])


def prefixes(row: np.ndarray, value: np.ndarray, rows: int, common: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, size, position) of the shingles in every set's prefix; ``common`` shingles (sorted) come last, by rank."""
    late = np.zeros(len(value), np.int64)
    if len(common) and len(value):
        near = np.minimum(np.searchsorted(common, value), len(common) - 1)
        late = np.where(common[near] == value, rank[near] + 1, 0)
    if late.any():
        order = np.lexsort((value, late, row))
        row, value = row[order], value[order]
    n = np.bincount(row, minlength=rows)
    place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    keep = place < prefix_length(n)[row]
    return row[keep], value[keep], n[row[keep]], place[keep]


def _poster(broadcast):
    """Task body: list entries of every different set of a task."""
    def run(batches):
        common, rank = broadcast.value
        seen: set[int] = set()
        for batch in batches:
            data, at = text_buffer(batch.column("text"))
            for lo, hi in row_slices(at, SLICE_BYTES):
                row, value = shingle_sets(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
                n, digest = _digests(row, value, hi - lo)
                fresh = np.zeros(hi - lo, bool)
                for i in np.flatnonzero(n):
                    if (d := int(digest[i])) not in seen:
                        seen.add(d)
                        fresh[i] = True
                use = fresh[row]
                row, value, size, place = prefixes(row[use], value[use], hi - lo, common, rank)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(digest[row].view(np.int64)), pa.array(size.astype(np.int32)), pa.array(place.astype(np.int32))],
                                                 names=["token", "_text", "size", "place"])
    return run


def partners(size: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Entries of one list (sorted by size and position) that some other entry of it can be linked with."""
    keep = np.zeros(len(size), bool)
    start = np.flatnonzero(np.append(True, size[1:] != size[:-1]))
    end = np.append(start[1:], len(size))
    sizes, first = size[start], place[start]
    for b in range(len(start)):
        r = sizes[b]
        a0 = int(np.searchsorted(sizes, -(-NUMERATOR * r // DENOMINATOR)))
        s = sizes[a0:b + 1]
        most = needed(r, s)
        for a in np.flatnonzero((first[b] <= r - most) & (first[a0:b + 1] <= s - most)):  # other blocks are skipped
            x, y = a0 + a, most[a]
            j = start[x] + np.searchsorted(place[start[x]:end[x]], sizes[x] - y, "right")
            if x == b:
                if j - start[b] > 1:
                    keep[start[b]:j] = True
                continue
            i = start[b] + np.searchsorted(place[start[b]:end[b]], r - y, "right")
            keep[start[x]:j] = True
            keep[start[b]:i] = True
    return keep


def _lists(batches):
    """Task body: entries of a sorted partition that can have a link in their list, with a digest of the list's remaining sets."""
    def survivors(token, text, size, place):
        new = np.append(True, (token[1:] != token[:-1]) | (text[1:] != text[:-1]) | (size[1:] != size[:-1]))  # copies of other tasks
        token, text, size, place = token[new], text[new], size[new], place[new]
        start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        many = np.diff(np.append(start, len(token)))
        out_token, out_text, out_list = [], [], []
        two = start[many == 2]  # most lists that are shared at all
        small, large = size[two], size[two + 1]
        most = needed(small, large)
        fit = (DENOMINATOR * small >= NUMERATOR * large) & (place[two] <= small - most) & (place[two + 1] <= large - most)
        pick = np.sort(np.concatenate([two[fit], two[fit] + 1]))
        wide = [np.arange(a, a + n)[partners(size[a:a + n], place[a:a + n])] for a, n in zip(start[many > 2], many[many > 2], strict=True)]
        pick = np.concatenate([pick, *wide])
        if len(pick):
            own = token[pick]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            n = np.diff(np.append(first, len(own)))
            code = mix(np.add.reduceat(mix(text[pick].view(np.uint64) ^ _STEP), first) + n.astype(np.uint64))
            out_token, out_text, out_list = own, text[pick], np.repeat(code.view(np.int64), n)
        return pa.RecordBatch.from_arrays([pa.array(out_list, pa.int64()), pa.array(out_token, pa.int64()), pa.array(out_text, pa.int64())], names=["_bucket", "token", "_text"])

    held = None
    for batch in batches:
        now = [batch.column(c).to_numpy() for c in ("token", "_text", "size", "place")]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        if len(held[0]) < 200_000:
            continue
        last = np.searchsorted(held[0], held[0][-1])  # the last list may go on
        if last:
            yield survivors(*[c[:last] for c in held])
            held = [c[last:] for c in held]
    if held is not None and len(held[0]):
        yield survivors(*held)


def _folded(raw: bytes, width: int) -> np.ndarray:
    """A bit map as 64-bit words, folded to a smaller width."""
    words = np.frombuffer(raw, np.uint64)
    while len(words) * 64 > width:
        words = words[:len(words) // 2] ^ words[len(words) // 2:]
    return words


class _Merged:
    """Component labels of a block's members."""

    def __init__(self, comp) -> None:
        self.label = np.unique(comp, return_inverse=True)[1]

    def join(self, a: int, b: int) -> bool:
        x, y = self.label[a], self.label[b]
        if x == y:
            return False
        self.label[self.label == y] = x
        return True


def _within_bound(frames):
    """Links that span the pairs of different components whose sizes and bit maps allow a link."""
    out = []
    for g in blocks(frames, ["_text", "_sig", "_size", "_comp", "_side"], MEETING):
        merged, side = _Merged(g["_comp"]), g["_side"]
        if len(side) < 2 or merged.label.max() == 0:
            continue
        size = g["_size"].astype(np.int64)
        width = np.array([8 * len(x) for x in g["_sig"]])
        table = {w: np.array([_folded(x, w) if 8 * len(x) >= w else np.zeros(w // 64, np.uint64) for x in g["_sig"]]) for w in np.unique(width)}
        left, right = side <= 1, side != 1  # side 0: the block meets itself
        for v in range(len(side)):
            # of two widths the smaller one's row compares; of equal ones the earlier row
            ahead = (width > width[v]) | ((width == width[v]) & (np.arange(len(side)) > v))
            other = (left[v] & right) | (right[v] & left)
            fit = (DENOMINATOR * np.minimum(size, size[v]) >= NUMERATOR * np.maximum(size, size[v]))
            try_ = np.flatnonzero(ahead & other & fit & (merged.label != merged.label[v]))
            if not len(try_):
                continue
            apart = np.bitwise_count(table[width[v]][try_] ^ table[width[v]][v]).sum(1)
            for w in try_[apart <= size[v] + size[try_] - 2 * needed(size[v], size[try_])]:
                if merged.join(v, w):
                    out.append((g["_text"][v], g["_text"][w]))
        if len(out) > 20_000:
            yield pd.DataFrame(out, columns=["a", "b"])
            out = []
    yield pd.DataFrame(out, columns=["a", "b"])


class Answers:
    """Overlaps of one set after another with the same others, each derived from those of the set before."""

    def __init__(self, others: list[np.ndarray]) -> None:
        flat = np.concatenate(others)
        who = np.repeat(np.arange(len(others), dtype=np.int32), [len(x) for x in others])
        order = np.argsort(flat, kind="stable")
        flat, self.who = flat[order], who[order]
        first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        self.token, self.edge = flat[first], np.append(first, len(flat))
        self.before, self.count, self.n = None, None, len(others)
        self.derived = 0

    def _listed(self, tokens: np.ndarray) -> np.ndarray:
        """How many of ``tokens`` each other set holds."""
        at = np.minimum(np.searchsorted(self.token, tokens), len(self.token) - 1)
        at = at[self.token[at] == tokens]
        long = self.edge[at + 1] - self.edge[at]
        spot = np.repeat(self.edge[at] - (np.cumsum(long) - long), long) + np.arange(long.sum())
        return np.bincount(self.who[spot], minlength=self.n)

    def of(self, own: np.ndarray) -> np.ndarray:
        if self.before is not None:
            gone, come = np.setdiff1d(self.before, own, True), np.setdiff1d(own, self.before, True)
        if self.before is None or len(gone) + len(come) >= len(own):
            self.count = self._listed(own)
        else:
            self.derived += 1
            self.count = self.count - self._listed(gone) + self._listed(come)
        self.before = own
        return self.count


def _answered(frames):
    """Links that span the linked pairs of different components, each with its exact overlap."""
    out = []
    for g in blocks(frames, ["_text", "_hash", "_comp", "_side"], MEETING):
        merged, side = _Merged(g["_comp"]), g["_side"]
        left, right = np.flatnonzero(side <= 1), np.flatnonzero(side != 1)
        if len(side) < 2 or not len(left) or not len(right) or merged.label.max() == 0:
            continue
        bag = [np.frombuffer(x, np.uint64) for x in g["_hash"]]
        size = np.array([len(x) for x in bag])
        answers = Answers([bag[w] for w in right])
        for v in left[np.lexsort((size[left], merged.label[left]))]:  # alike sets follow each other
            if (merged.label[right] == merged.label[v]).all():
                continue
            both = answers.of(bag[v])
            for k in np.flatnonzero(DENOMINATOR * both >= NUMERATOR * (size[v] + size[right] - both)):
                if merged.join(v, right[k]):
                    out.append((g["_text"][v], g["_text"][right[k]], int(both[k])))
        if len(out) > 20_000:
            yield pd.DataFrame(out, columns=["a", "b", "overlap"])
            out = []
    yield pd.DataFrame(out, columns=["a", "b", "overlap"])


def _bags(batches):
    """Shingle hashes of texts, sorted, with the digest of the set."""
    for batch in batches:
        data, at = text_buffer(batch.column("text"))
        for lo, hi in row_slices(at, SLICE_BYTES):
            row, value = shingle_sets(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
            n, digest = _digests(row, value, hi - lo)
            edge = np.append(0, np.cumsum(n))
            full = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(digest[full].view(np.int64)), pa.array([value[edge[i]:edge[i + 1]].tobytes() for i in full], pa.binary())], names=["_text", "_hash"])


def _common(sized: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, rank) of the common shingles, the most frequent ranked last: less than 2^20, as each is more than 2^-20 of all."""
    total = sized.agg(F.sum("n")).first()[0] or 0
    counts = sized.filter(F.col("token").isNotNull()).groupBy("token").agg(F.sum("many").alias("many"))
    found = counts.filter(F.col("many") > max(8, total >> COMMON_BITS)).sort("many", "token").toPandas()
    token = found["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], order


def join(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links). members: doc_id, n_shingles, component_id for every row of docs (doc_id, text). links: pairs of sets (a, b, overlap)
    at or above the threshold that span the components."""
    spark = docs.sparkSession
    prepared(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text")
    sized = written(texts.mapInArrow(tidy(_sizer), _SIZED.format(kind)), "sized")
    rows = sized.filter(F.col("n").isNotNull()).select("doc_id", "n", "_text")
    sets = sized.filter("n > 0").groupBy("_text").agg(F.min("doc_id").alias("_first"), F.any_value("_sig").alias("_sig"), F.any_value("n").alias("_size"))
    sets = written(sets, "sets")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    entries = texts.mapInArrow(tidy(_poster(spark.sparkContext.broadcast(_common(sized)))), "token long, _text long, size int, place int")
    entries = entries.repartition(tasks, "token").sortWithinPartitions("token", "size", "place", "_text")
    found = written(entries.mapInArrow(tidy(_lists), "_bucket long, token long, _text long"), "entries")
    one = found.groupBy("_bucket").agg(F.min("token").alias("token"), F.count(F.lit(1)).alias("_all"), F.count_distinct("token").alias("_lists"))
    one = one.select("_bucket", "token", (F.col("_all") / F.col("_lists")).cast("long").alias("_n"))
    members = written(found.join(one, ["_bucket", "token"]).select("_bucket", "_text", "_n"), "members")
    _, family = linked(members, sets.select("_text", "_sig", "_size"), _within_bound, "a long, b long", BLOCK)
    many = family.groupBy("_comp").agg(F.count(F.lit(1)).alias("_n"))
    family = written(family.join(many, "_comp").select(F.col("_comp").alias("_bucket"), "_text", "_n"), "families")
    wanted = sets.join(family.select("_text"), "_text", "left_semi").select(F.col("_text").alias("_want"), "_first")
    body = texts.join(wanted.select("_first").distinct(), F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi").mapInArrow(tidy(_bags), "_text long, _hash binary")
    payload = written(body.join(wanted.select(F.col("_want").alias("_text")), "_text", "left_semi").dropDuplicates(["_text"]), "bags")
    links, comp = linked(family, payload, _answered, "a long, b long, overlap long", BAG_BLOCK)
    comp = sets.select("_text", "_first").join(comp, "_text", "left").withColumn("_comp", F.coalesce("_comp", "_text"))
    least = comp.groupBy("_comp").agg(F.min("_first").alias("component_id"))
    named = written(comp.join(least, "_comp").select("_text", "component_id"), "components")
    out = rows.join(named, "_text", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("_text").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")), links
