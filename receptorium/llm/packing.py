"""Best-fit packing of token sequences with large-item matching.

Only piece lengths decide a packing, and there are at most ``capacity`` of them, so the plan is made on counts per length:
pieces above a third of the capacity are matched greedily, the largest with the largest that still fits (at most two such
pieces share a sequence); smaller ones go, by falling length, to the sequence with the least room that holds them. The plan is
a short list of slots, each a run of equal sequences, whatever the number of documents. Pieces find their slot by their rank
among the pieces of their length, so nothing but counts meets on the driver.

Defined cases: a null or empty text is one piece of the end token; repeated rows and equal ids are packed as separate
documents; an empty table gives no rows; other columns of the documents play no part.
"""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from receptorium.llm.shared import prepared, row_slices, text_buffer, tidy, written

CAPACITY = 1024
END_TOKEN = 2
VOCABULARY = "byte_bpe_50k.tiktoken"
BUCKET_ROWS = 20_000


def added_tokens(path: str) -> dict[str, int]:
    """Added tokens of the JSON form that lies beside a rank file, with their ids."""
    with open(f"{path.removesuffix('.tiktoken')}.json", encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    odd = [t["content"] for t in tokens if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    if odd:
        raise ValueError(f"added tokens that take more than their own string: {odd}")
    return {t["content"]: t["id"] for t in tokens}


@lru_cache(maxsize=2)
def _encoder(path: str, added: bool):
    """Byte-level BPE with the merges of a public vocabulary, in about a quarter of the time that its JSON form takes. With
    ``added`` a text is first split at the JSON's added tokens, which get their own ids, as the JSON form does by default;
    without, these strings are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(path) if added else {})


def token_ids(text: str, path: str, end_token: int = END_TOKEN, added: bool = False) -> np.ndarray:
    ids = _encoder(path, added).encode_to_numpy(text, allowed_special="all", disallowed_special=()) if text else np.zeros(0, np.uint32)
    return np.append(ids, end_token).astype("<u4")


def piece_bounds(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: whole ones at the end, the rest first."""
    rest = length % capacity if length > capacity else length
    bounds = [(0, rest)] if rest else []
    return bounds + [(start, capacity) for start in range(rest, length, capacity)]


def _cutter(path: str, capacity: int, end_token: int, with_ids: bool, added: bool):
    def cut(batches):
        for batch in batches:
            text = batch.column("text")
            _, at = text_buffer(text)
            for lo, hi in row_slices(at, 1 << 20):
                doc, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, t in enumerate(text.slice(lo, hi - lo).to_pylist(), lo):
                    own = token_ids(t or "", path, end_token, added)
                    for j, (a, n) in enumerate(piece_bounds(len(own), capacity)):
                        doc.append(i)
                        piece.append(j)
                        start.append(a)
                        length.append(n)
                        crc.append(zlib.crc32(own[a:a + n].tobytes()))
                        if with_ids:
                            ids.append(own[a:a + n].astype(np.int32))
                columns = [batch.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                           pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
    return cut


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_token: int = END_TOKEN,
           with_ids: bool = False, added: bool = False) -> DataFrame:
    """Token pieces of all documents: doc_id, piece, start, length, ids_crc32, and ids if asked for. ``added``: the
    vocabulary's added tokens in a text are single tokens."""
    import public_tokenizers

    prepared(docs.sparkSession)
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    schema = (f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
              + ", ids array<int>" * with_ids)
    return docs.select("doc_id", "text").mapInArrow(tidy(_cutter(path, capacity, end_token, with_ids, added)), schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, number, first sequence, offset) that place ``counts[length]`` pieces of every length: the
    piece with rank first + i is in sequence first_sequence + i, for i below number."""
    classes: list[tuple[list[int], int]] = []  # (lengths of one sequence, number of such sequences)
    left = {n: c for n, c in counts.items() if c > 0}
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        size = large[-1]
        fit = bisect_left(large, capacity - size + 1) - 1
        if fit < 0:
            classes.append(([size], left[size]))
            large.pop()
            continue
        mate = large[fit]
        many = min(left[size], left[mate]) if mate != size else left[size] // 2
        if many:
            classes.append(([size, mate], many))
        for n in {size, mate}:
            left[n] -= many * (2 if size == mate else 1)
        if mate == size and left[size]:  # one is over: it looks for the next smaller mate
            large.pop()
            left[size] = 0
            lower = bisect_left(large, capacity - size + 1) - 1
            if lower >= 0:
                classes.append(([size, large[lower]], 1))
                left[large[lower]] -= 1
            else:
                classes.append(([size], 1))
        large = [n for n in large if left[n]]
    room: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    for lengths, many in classes:
        room[capacity - sum(lengths)].append((lengths, many))
    gaps = sorted(room)

    def put(gap: int, lengths: list[int], many: int) -> None:
        if many:
            if gap not in room or not room[gap]:
                insort(gaps, gap)
            room[gap].append((lengths, many))

    for size in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        rest = left[size]
        while rest:
            at = bisect_left(gaps, size)
            if at == len(gaps):
                each = capacity // size
                put(capacity - each * size, [size] * each, rest // each)
                put(capacity - rest % each * size, [size] * (rest % each), int(rest % each > 0))
                break
            gap = gaps[at]
            lengths, many = room[gap].pop()
            if not room[gap]:
                gaps.pop(at)
            each = gap // size
            full = min(many, rest // each)
            rest -= full * each
            put(gap - each * size, lengths + [size] * each, full)
            many -= full
            if many and rest:
                put(gap - rest * size, lengths + [size] * rest, 1)
                many, rest = many - 1, 0
            put(gap, lengths, many)
    slots, used, sequence = [], defaultdict(int), 0
    for gap in sorted(room):
        for lengths, many in room[gap]:
            offset = 0
            for n in lengths:
                slots.append((n, used[n], many, sequence, offset))
                used[n] += many
                offset += n
            sequence += many
    return slots


def pack(cut: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``cut`` (a stored table of pieces) plus sequence_id and offset. Ranks among equal lengths are counted inside hash
    buckets, so a length that most pieces share is dealt over groups of about ``bucket_rows``."""
    spark = cut.sparkSession
    buckets = -(-cut.count() // bucket_rows) or 1
    bucketed = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = bucketed.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    counts = written(counts.withColumn("_before", F.sum("_n").over(
        Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["_before"]), "lengths")
    totals = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}  # at most ``capacity`` rows
    slots = plan(totals, capacity)
    table = spark.createDataFrame(slots or [(0, 0, 0, 0, 0)], "length long, _first long, _many long, _sequence long, offset long")
    inside = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = (bucketed.withColumn("_inside", inside - 1).join(counts.drop("_n"), ["length", "_bucket"])
              .withColumn("_rank", F.col("_before") + F.col("_inside")))
    by_length = (table.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("_first", "_many", "_sequence", "offset"))).alias("_slots")))
    found = F.expr("filter(_slots, s -> s._first <= _rank and _rank < s._first + s._many)[0]")
    return (ranked.join(F.broadcast(by_length), "length").withColumn("_slot", found)
            .withColumn("sequence_id", F.col("_slot._sequence") + F.col("_rank") - F.col("_slot._first"))
            .withColumn("offset", F.col("_slot.offset"))
            .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if "ids" in cut.columns else [])))


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_token: int = END_TOKEN,
                   with_ids: bool = False, added: bool = False) -> DataFrame:
    """Tokenise, cut and pack all documents: one row per piece."""
    return pack(written(pieces(docs, vocabulary, capacity, end_token, with_ids, added), "pieces"), capacity)
