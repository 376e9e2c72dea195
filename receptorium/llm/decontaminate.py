"""Benchmark decontamination with an FM-index per training shard.

Each task cuts its texts into shards of bounded size and indexes their words (fm_index). Every window of the benchmark is a
test phrase: backward search through the wavelet tree gives its occurrences, sampled suffix positions give their places,
and overlapping places merge into spans. Tasks cut the benchmark into phrase blocks of bounded size, files in the shared
folder; a task reads one block at a time and searches its own texts for all of them, so the documents are read once and never
shuffled, and no result depends on which items share a block.

Defined cases: a null or empty text has no words and is never hit; an item without words has no window; an item with a null
id still hits and is listed as an empty string; repeated rows are judged one by one; an empty benchmark hits nothing. Other
columns of the documents are passed through, whatever their names.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, functions as F, types as T

from receptorium.llm.fm_index import FMIndex
from receptorium.llm.shared import fresh_path, prepared, row_slices, text_buffer, tidy
from receptorium.llm.words import letters_and_digits, word_table

SHARD_BYTES = 4 << 20
BLOCK_BYTES = 4 << 20
WINDOW = 10


@dataclass
class Phrases:
    """The windows of one benchmark block. ``vocabulary``: sorted word hashes; symbols are their places plus one."""

    vocabulary: np.ndarray
    words: np.ndarray
    lengths: np.ndarray
    of_phrase: np.ndarray
    of_item: np.ndarray
    items: list[str]


def phrases_of(items: list[tuple[str, str]], window: int = WINDOW) -> Phrases:
    """All windows of ``window`` words; an item with fewer words is one window. Items are (id, text)."""
    data, at = text_buffer(pa.array([text for _, text in items], pa.string()))
    _, _, code, row = word_table(data, at, letters_and_digits())
    vocabulary = np.unique(code)
    symbol = np.searchsorted(vocabulary, code) + 1
    words, lengths, of_item = [], [], []
    begin = np.searchsorted(row, np.arange(len(items) + 1))
    for i in range(len(items)):
        own = symbol[begin[i]:begin[i + 1]]
        size = min(window, len(own))
        if size:
            cut = np.lib.stride_tricks.sliding_window_view(own, size)
            padded = np.zeros((len(cut), window), np.int32)
            padded[:, window - size:] = cut
            words.append(padded)
            lengths += [size] * len(cut)
            of_item += [i] * len(cut)
    table = np.concatenate(words) if words else np.zeros((0, window), np.int32)
    unique, of_phrase = np.unique(table, axis=0, return_inverse=True)
    return Phrases(vocabulary, unique, (unique > 0).sum(1), of_phrase.ravel(), np.asarray(of_item, np.int64),
                   [name for name, _ in items])


def _file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def _block_writer(folder: str, window: int, most: int):
    def write(batches):
        fs, path = _file_system(folder)
        block, size = [], 0

        def stored() -> pa.RecordBatch:
            name = f"{path}/{uuid.uuid4().hex}.phrases"
            with fs.open_output_stream(name, compression=None) as out:
                out.write(pickle.dumps(phrases_of(block, window), protocol=5))
            return pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                more = len((text or "").encode())
                if block and size + more > most:
                    yield stored()
                    block, size = [], 0
                block.append((item or "", text or ""))
                size += more
        if block:
            yield stored()
    return write


def stored_blocks(benchmark: DataFrame, window: int, most: int) -> tuple[str, list[str]]:
    """The shared folder and the file names of the benchmark's phrase blocks, each of about ``most`` bytes of text. Only names
    reach the driver; files of failed attempts are not among them."""
    spark = benchmark.sparkSession
    prepared(spark)
    folder = fresh_path(spark, "phrases")
    fs, path = _file_system(folder)
    fs.create_dir(path, recursive=True)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    names = items.coalesce(max(1, -(-size // most))).mapInArrow(tidy(_block_writer(folder, window, most)), "name string").collect()
    return folder, sorted(r[0] for r in names)


_LAST: dict[str, Phrases] = {}


def _reader(folder: str, names: list[str]) -> Callable[[], Iterator[Phrases]]:
    """Reads all blocks in turn; a worker holds the last one only."""
    def read() -> Iterator[Phrases]:
        fs, _ = _file_system(folder)
        for name in names:
            if name not in _LAST:
                _LAST.clear()
                with fs.open_input_file(name) as file:
                    _LAST[name] = pickle.loads(file.read())
            yield _LAST[name]
    return read


@dataclass
class Hits:
    """Words of some texts, which of them are covered by occurrences, and ids of the items found in a row."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    covered: np.ndarray
    items: dict[int, set[str]]


def hits_in(data: np.ndarray, at: np.ndarray, blocks: Iterable[Phrases]) -> Hits:
    """Find every occurrence of every phrase of all blocks in one shard."""
    start, end, code, row = word_table(data, at, letters_and_digits())
    covered, items = np.zeros(len(code), bool), {}
    for phrases in blocks if len(code) else ():
        own, pairs = _found(code, row, phrases)
        covered |= own
        for r, i in pairs.tolist():
            items.setdefault(r, set()).add(phrases.items[i])
    return Hits(start, end, row, covered, items)


def _found(code: np.ndarray, row: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Index the words of a shard for one block: which are covered by occurrences, and (row, item) pairs."""
    covered, pairs = np.zeros(len(code), bool), np.zeros((0, 2), np.int64)
    place = np.searchsorted(phrases.vocabulary, code)
    place[place == len(phrases.vocabulary)] = 0
    known = np.flatnonzero(phrases.vocabulary[place] == code) if len(phrases.vocabulary) else np.zeros(0, np.int64)
    if len(known):
        gap = np.zeros(len(known), np.int64)
        gap[1:] = (np.diff(known) > 1) | (row[known[1:]] != row[known[:-1]])
        slot = np.arange(len(known)) + np.cumsum(gap)
        symbols, word = np.zeros(slot[-1] + 2, np.int32), np.zeros(slot[-1] + 2, np.int64)
        symbols[slot], word[slot] = place[known] + 1, known
        index = FMIndex(symbols, len(phrases.vocabulary))
        low, high = index.search(phrases.words, phrases.lengths)
        many = high - low
        phrase = np.repeat(np.arange(len(many)), many)
        slots = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        first = word[index.locate(slots)]
        edge = np.bincount(first, minlength=len(code) + 1)
        edge = edge - np.bincount(first + phrases.lengths[phrase], minlength=len(code) + 1)
        covered = np.cumsum(edge)[:-1] > 0
        found = np.unique(np.stack([phrase, row[first]], 1), axis=0)
        by_phrase = np.argsort(phrases.of_phrase, kind="stable")
        begin = np.searchsorted(phrases.of_phrase[by_phrase], found[:, 0])
        count = np.searchsorted(phrases.of_phrase[by_phrase], found[:, 0], "right") - begin
        item = phrases.of_item[by_phrase[np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]]
        pairs = np.unique(np.stack([np.repeat(found[:, 1], count), item], 1), axis=0)
    return covered, pairs


def _runs(covered: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of every run of covered words of one row."""
    on = np.flatnonzero(covered)
    if not len(on):
        return on, on
    new = np.ones(len(on), bool)
    new[1:] = (np.diff(on) > 1) | (row[on[1:]] != row[on[:-1]])
    return on[new], on[np.append(np.flatnonzero(new)[1:] - 1, len(on) - 1)]


def _finder(blocks: Callable[[], Iterator[Phrases]], names: tuple[str, str, str], shard: int):
    def find(batches):
        for batch in batches:
            data, at = text_buffer(batch.column("text"))
            n_words, spans, items = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            for lo, hi in row_slices(at, shard):
                got = hits_in(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo], blocks())
                n_words[lo:hi] = np.bincount(got.row, minlength=hi - lo)
                begin = np.searchsorted(got.row, np.arange(hi - lo))
                for a, b in zip(*_runs(got.covered, got.row), strict=True):
                    r = int(got.row[a])
                    spans[lo + r].append([int(a - begin[r]), int(b - begin[r]) + 1])
                for r, own in got.items.items():
                    items[lo + r] = sorted(own)
            columns = [*batch.columns, pa.array(n_words), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names])
    return find


def _own(columns: list[str], *names: str) -> tuple[str, ...]:
    """``names``, lengthened where the table already has them."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return tuple(out)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (with ``text``) plus ``n_words``, ``spans`` (merged [first, last + 1) word ranges inside occurrences of
    benchmark windows) and ``items`` (ids of the items with such windows, sorted as strings). If ``docs`` has one of
    these names already, the new column's name gets underscores."""
    spark = docs.sparkSession
    prepared(spark)
    names = _own(docs.columns, "n_words", "spans", "items")
    added = [T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(T.ArrayType(T.LongType()))),
             T.StructField(names[2], T.ArrayType(T.StringType()))]
    schema = T.StructType([*docs.schema.fields, *added])
    return docs.mapInArrow(tidy(_finder(_reader(*stored_blocks(benchmark, window, block_bytes)), names, shard_bytes)), schema)


def cut_texts(texts: list[bytes], blocks: Callable[[], Iterable[Phrases]]) -> list[bytes]:
    """``texts`` without the words inside occurrences of any block, searched again until the joined rest has none either."""
    out, left = list(texts), [i for i, text in enumerate(texts) if text]
    while left:
        at = np.cumsum([0, *(len(out[i]) for i in left)])
        got = hits_in(np.frombuffer(b"".join(out[i] for i in left), np.uint8), at, blocks())
        first, last = _runs(got.covered, got.row)
        edges = np.stack([got.start[first], got.end[last]], 1)
        rows = got.row[first]
        hit = np.unique(rows)
        for r in hit.tolist():
            text, own = out[left[r]], (edges[rows == r] - at[r]).ravel().tolist()
            out[left[r]] = b"".join(text[a:b] for a, b in zip([0, *own[1::2]], [*own[0::2], len(text)], strict=True))
        left = [left[r] for r in hit.tolist()]
    return out


def cut_text(text: bytes, *phrases: Phrases) -> bytes:
    return cut_texts([text], lambda: phrases)[0]


def _remover(blocks: Callable[[], Iterator[Phrases]], shard: int):
    def remove(batches):
        for batch in batches:
            data, at = text_buffer(batch.column("text"))
            keep, changed = np.ones(batch.num_rows, bool), {}
            for lo, hi in row_slices(at, shard):
                old = [data[at[i]:at[i + 1]].tobytes() for i in range(lo, hi)]
                changed |= {i: new for i, (text, new) in enumerate(zip(old, cut_texts(old, blocks), strict=True), lo) if len(new) < len(text)}
            if changed:
                table = letters_and_digits()
                text = batch.column("text").to_pylist()
                for i, new in changed.items():
                    text[i] = new.decode()
                    keep[i] = bool(table[np.frombuffer(new, np.uint8)].any())
                columns = dict(zip(batch.schema.names, batch.columns, strict=True))
                columns["text"] = pa.array(text, batch.schema.field("text").type)
                if "n_chars" in columns:
                    size = batch.column("n_chars").to_pylist()
                    for i in changed:
                        size[i] = len(text[i])
                    columns["n_chars"] = pa.array(size, batch.schema.field("n_chars").type)
                batch = pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema).filter(pa.array(keep))
            yield batch
    return remove


def remove_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with every occurrence of a benchmark window cut out of ``text`` (``n_chars`` follows where it exists); a
    document of which no word is left goes, others and all other columns stay. All occurrences in a text are cut together,
    and the joined rest is searched again until none is left."""
    prepared(docs.sparkSession)
    return docs.mapInArrow(tidy(_remover(_reader(*stored_blocks(benchmark, window, block_bytes)), shard_bytes)), docs.schema)


def verdicts(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    found = find_overlaps(docs.select("doc_id", "text"), benchmark, window)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "spans")
