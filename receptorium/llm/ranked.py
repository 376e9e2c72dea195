"""Ranked lexical search by pipelined term partitioning.

Documents are cut into blocks of bounded size; each block is inverted once into posting lists. Terms belong to owner stages by how
common they are, rare ones first. The items travel in bundles: one bundle per block and group of items, with its terms, weights and
sparse accumulators. At every stage a cogroup brings a bundle together with the lists of that stage's terms in its block; the stage
adds its integer contributions and hands the bundle on without the terms it has served. A document is dropped on the way only
when fifty (``k``) others of its block already score more than it could reach with all later terms, so the ranking is exact. After the last
stage each bundle gives the k best of its block, and a window over these makes the final selection.

No task holds more than a block's lists of one stage and a group of items; posting lists of a term that every document has are cut by block.
Terms compare by 64-bit hashes.

Defined cases: null, empty and termless texts are no documents and give an item no terms, such items have no rows; every row is a document or an
item of its own, repeated rows too; equal scores rank by doc_id, null ids last; ids are integers; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from receptorium.llm.shared import prepared, row_slices, text_buffer, tidy, written
from receptorium.llm.words import letters_and_digits, word_table

TOP = 50
BLOCK_ROWS, BLOCK_POSTINGS = 16_384, 4_000_000
ITEMS_AT_ONCE = 256
BLOCKS_A_COPY = 64  # blocks that read one copy of the items
#: a term belongs to the first stage whose share of the documents its df does not exceed, else to the last
STAGES = (0.001, 0.01, 0.1)
SLICE_BYTES = 3 << 20
DOCS = 0  # stands for a term in the row that holds a block's documents
_LISTS = pa.schema([("_block", pa.int64()), ("term", pa.int64()), ("at", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32())), ("n", pa.list_(pa.int64())),
                    ("ids", pa.list_(pa.int64())), ("absent", pa.list_(pa.int32()))])
LISTS_SCHEMA = "_block long, term long, at array<int>, tf array<int>, n array<long>, ids array<long>, absent array<int>"
_BUNDLE = "_block long, _group int, _item long, terms array<long>, weights array<long>, stages array<int>, bounds array<long>, at array<int>, score array<long>"


def term_counts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of every row's distinct terms in order of row, and the number of terms of every row."""
    _, _, code, row = word_table(data, at, letters_and_digits())
    order = np.lexsort((code, row))
    code, row = code[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    first = np.flatnonzero(new)
    return row[first], code[first], np.diff(np.append(first, len(row))), np.bincount(row, minlength=len(at) - 1)


def _list_column(values: np.ndarray, edges: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values, kind))


def _inverted(block: int, parts: list, ids: list, lengths: list):
    """Record batches of one block: its documents, then its posting lists in order of term."""
    doc, code, count = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.argsort(code, kind="stable")
    doc, code, count = doc[order].astype(np.int32), code[order], count[order].astype(np.int32)
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    edges = np.append(first, len(code))
    absent = [i for i, x in enumerate(ids) if x is None]
    head = [[block], [DOCS], [[]], [[]], [lengths], [[0 if x is None else x for x in ids]], [absent]]
    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(head, _LISTS, strict=True)], schema=_LISTS)
    term = code[first].view(np.int64)
    for lo in range(0, len(first), 20_000):
        hi = min(lo + 20_000, len(first))
        a, b = edges[lo], edges[hi]
        own, none = edges[lo:hi + 1] - a, np.zeros(hi - lo + 1, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(hi - lo, block)), pa.array(term[lo:hi]), _list_column(doc[a:b], own, pa.int32()), _list_column(count[a:b], own, pa.int32()),
             _list_column(np.zeros(0, np.int64), none, pa.int64()), _list_column(np.zeros(0, np.int64), none, pa.int64()), _list_column(np.zeros(0, np.int32), none, pa.int32())],
            schema=_LISTS)


def _inverter(block_rows: int, block_postings: int):
    """Task body: the blocks of a partition of documents."""
    def run(batches):
        context = TaskContext.get()
        block = (context.partitionId() if context else 0) << 32
        parts, ids, lengths, held = [], [], [], 0
        for batch in batches:
            data, at = text_buffer(batch.column("text"))
            names = batch.column("doc_id").to_pylist()
            for lo, hi in row_slices(at, SLICE_BYTES):
                row, code, count, many = term_counts(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
                full = np.flatnonzero(many)
                place = np.full(hi - lo, -1)
                place[full] = np.arange(len(full)) + len(ids)
                parts.append((place[row], code, count))
                ids += [names[lo + i] for i in full]
                lengths += many[full].tolist()
                held += len(row)
                if len(ids) >= block_rows or held >= block_postings:
                    yield from _inverted(block, parts, ids, lengths)
                    block, parts, ids, lengths, held = block + 1, [], [], [], 0
        if ids:
            yield from _inverted(block, parts, ids, lengths)
    return run


def _item_terms(batches):
    for batch in batches:
        data, at = text_buffer(batch.column("text"))
        row, code, _, many = term_counts(data, at)
        edges = np.searchsorted(row, np.arange(len(at)))
        yield pa.RecordBatch.from_arrays([batch.column("_item"), batch.column("item_id"), _list_column(code.view(np.int64), edges, pa.int64())], names=["_item", "item_id", "terms"])


def _lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column without nulls."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks)
    offsets = whole.offsets.to_numpy()
    return whole.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def _measure(n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """Length measure of documents of n terms."""
    if len(n) and int(n.max()) * 50 * docs >= 1 << 62:
        return np.array([50 + 50 * int(x) * docs // words for x in n], np.int64)
    return 50 + (50 * n * docs) // words


def _stage(stage: int, last: bool, k: int, docs: int, words: int):
    """Cogroup body: a block's bundles of one group of items meet the lists of the stage's terms in that block."""
    def run(bundles: pa.Table, lists: pa.Table) -> pa.Table:
        if not bundles.num_rows or not lists.num_rows:
            return schema.empty_table()
        term = lists.column("term").to_numpy()
        head = lists.filter(pa.array(term == DOCS)).slice(0, 1)
        measure = _measure(_lists(head.column("n"))[0], docs, words)
        place = {int(t): i for i, t in enumerate(term) if t != DOCS}
        spots, edges = _lists(lists.column("at"))
        counts = _lists(lists.column("tf"))[0].astype(np.int64)
        impact = (1_000_000_000 * counts) // (1000 * counts + 20 * measure[spots])
        terms, term_at = _lists(bundles.column("terms"))
        weights, stages, bounds = (_lists(bundles.column(c))[0] for c in ("weights", "stages", "bounds"))
        spot, spot_at = _lists(bundles.column("at"))
        score = _lists(bundles.column("score"))[0]
        if last:
            ids = _lists(head.column("ids"))[0]
            absent = np.zeros(len(ids), bool)
            absent[_lists(head.column("absent"))[0]] = True
        dense = np.zeros(len(measure), np.int64)
        kept_at, kept_score = [], []
        for i in range(bundles.num_rows):
            dense[spot[spot_at[i]:spot_at[i + 1]]] = score[spot_at[i]:spot_at[i + 1]]
            rest = 0
            for j in range(term_at[i], term_at[i + 1]):
                if stages[j] > stage:
                    rest += int(bounds[j])
                elif stages[j] == stage and int(terms[j]) in place:
                    x = place[int(terms[j])]
                    dense[spots[edges[x]:edges[x + 1]]] += weights[j] * impact[edges[x]:edges[x + 1]]
            found = np.flatnonzero(dense)
            value = dense[found]
            dense[found] = 0
            if len(found) > k:
                fine = value + rest >= np.partition(value, len(value) - k)[len(value) - k]
                found, value = found[fine], value[fine]
            if last:
                best = np.lexsort((ids[found], absent[found], -value))[:k]
                found, value = found[best], value[best]
            kept_at.append(found)
            kept_score.append(value)
        sizes = np.cumsum([0, *map(len, kept_at)])
        flat_at, flat_score = np.concatenate(kept_at), np.concatenate(kept_score)
        if last:
            item = np.repeat(bundles.column("_item").to_numpy(), np.diff(sizes))
            return pa.table([pa.array(item), pa.array(ids[flat_at], mask=absent[flat_at]), pa.array(flat_score)], schema=schema)
        todo = stages > stage
        left = np.append(0, np.cumsum(todo))[term_at]
        columns = [bundles.column("_block"), bundles.column("_group"), bundles.column("_item"),
                   *[_list_column(v[todo], left, t) for v, t in ((terms, pa.int64()), (weights, pa.int64()), (stages, pa.int32()), (bounds, pa.int64()))],
                   _list_column(flat_at, sizes, pa.int32()), _list_column(flat_score, sizes, pa.int64())]
        return pa.table(columns, schema=schema)

    lists_of = {"terms": pa.int64(), "weights": pa.int64(), "stages": pa.int32(), "bounds": pa.int64(), "at": pa.int32(), "score": pa.int64()}
    schema = (pa.schema([("_item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]) if last else
              pa.schema([("_block", pa.int64()), ("_group", pa.int32()), ("_item", pa.int64()), *[(c, pa.list_(t)) for c, t in lists_of.items()]]))
    return run


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_rows: int = BLOCK_ROWS, block_postings: int = BLOCK_POSTINGS,
           items_at_once: int = ITEMS_AT_ONCE, shares: tuple[float, ...] = STAGES) -> DataFrame:
    """The k best documents (doc_id, text) of every item (item_id, text): item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    prepared(spark)
    kind = items.schema["item_id"].dataType.simpleString()
    asked = items.select(F.monotonically_increasing_id().alias("_item"), "item_id", "text").mapInArrow(tidy(_item_terms), f"_item long, item_id {kind}, terms array<long>")
    asked = written(asked, "items")
    vocabulary = written(asked.select(F.explode("terms").alias("term")).union(spark.range(1).select(F.lit(DOCS).cast("long"))).distinct(), "vocabulary")
    lists = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_inverter(block_rows, block_postings)), LISTS_SCHEMA)
    lists = written(lists.join(vocabulary, "term", "left_semi"), "lists")
    blocks = lists.filter(F.col("term") == DOCS).select("_block", F.size("n").alias("_docs"), F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("_words"))
    blocks = written(blocks, "blocks")
    total = blocks.agg(F.sum("_docs"), F.sum("_words"), F.count(F.lit(1))).first()
    found = asked.agg(F.count(F.lit(1))).first()[0]
    if not total[2] or not found:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    n_docs, n_words, n_blocks = (int(x) for x in total)
    groups, copies = -(-found // items_at_once), -(-n_blocks // BLOCKS_A_COPY)

    known = lists.filter(F.col("term") != DOCS).groupBy("term").agg(F.sum(F.size("at")).alias("df"), F.max(F.array_max("tf")).cast("long").alias("top"))
    weight = F.floor(F.log((F.lit(2.0 * n_docs) + 2) / (2 * F.col("df") + 1).cast("double")) * 1000).cast("long")
    stage = F.lit(len(shares))
    for i, share in reversed(list(enumerate(shares))):
        stage = F.when(F.col("df") <= share * n_docs, i).otherwise(stage)
    # no length measure is below 50
    known = known.select("term", weight.alias("weight"), stage.cast("int").alias("stage"), F.expr("(1000000000 * top) div (1000 * top + 1000)").alias("most"))
    known = written(known.filter("weight > 0").select("term", "weight", "stage", (F.col("weight") * F.col("most")).alias("bound")), "terms")
    facts = F.collect_list(F.struct("term", "weight", "stage", "bound"))
    bundle = asked.select("_item", F.explode("terms").alias("term")).join(known, "term").groupBy("_item").agg(facts.alias("_t"))
    bundle = bundle.select("_item", F.pmod(F.xxhash64("_item"), F.lit(groups)).cast("int").alias("_group"), F.col("_t.term").alias("terms"), F.col("_t.weight").alias("weights"),
                           F.col("_t.stage").alias("stages"), F.col("_t.bound").alias("bounds"), F.array().cast("array<int>").alias("at"), F.array().cast("array<long>").alias("score"),
                           F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_copy"))
    to = blocks.select("_block", F.pmod(F.xxhash64("_block"), F.lit(copies)).cast("int").alias("_copy"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"))
    bundle = to.join(bundle, ["_copy", "_group"]).drop("_copy").select(*[c.split()[0] for c in _BUNDLE.split(", ")])
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    keys = ["_block", "_group"]
    for i in range(len(shares) + 1):
        last = i == len(shares)
        own = lists.join(known.filter(F.col("stage") == i).select("term").union(spark.range(1).select(F.lit(DOCS).cast("long"))), "term", "left_semi")
        own = own.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        bundle = (bundle.repartition(tasks, *keys).groupBy(*keys).cogroup(own.repartition(tasks, *keys).groupBy(*keys))
                  .applyInArrow(_stage(i, last, k, n_docs, n_words), "_item long, doc_id long, score long" if last else _BUNDLE))
    order = Window.partitionBy("_item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = bundle.filter("score > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(asked.select("_item", "item_id"), "_item").select("item_id", "rank", "doc_id", "score")
