"""Language identification by a bidirectional gated recurrent network over bytes (gru), trained here.

Every byte of every word gets a probability per language; a document's probability is the mean over its letter positions.
A word that repeats inside a slice of texts is run once and counted as often as it occurs, which changes no result, because
the network starts anew at every word (and after LONGEST bytes of a word).

Defined cases: null, empty and letterless texts are ``und`` with score 0; without any labelled row everything is ``und``; a
null lang or doc_id is never learned from (a null doc_id counts as the empty string in the split); repeated rows are judged
one by one; other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from receptorium.llm.gru import LONGEST, Network, train
from receptorium.llm.shared import prepared, row_slices, text_buffer, tidy
from receptorium.llm.words import between_spaces, word_table

SLICE_BYTES = 2 << 20


@dataclass
class Settings:
    """``docs_per_lang`` and ``words_per_doc`` bound the labelled sample that the fit gathers."""

    docs_per_lang: int = 400
    words_per_doc: int = 150
    hidden: int = 8
    steps: int = 400


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def pieces_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte pieces (rows x LONGEST), their lengths and their word, in order of descending length."""
    many = (end - start + LONGEST - 1) // LONGEST
    word = np.repeat(np.arange(len(start)), many)
    begin = start[word] + (np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many)) * LONGEST
    size = np.minimum(end[word] - begin, LONGEST)
    order = np.argsort(-size, kind="stable")
    word, begin, size = word[order], begin[order], size[order]
    at = np.minimum(begin[:, None] + np.arange(LONGEST), max(len(data) - 1, 0))
    lower = between_spaces()
    return np.where(np.arange(LONGEST) < size[:, None], lower[data[at]], 0), size, word


_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def position_sums(network: Network, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: the sum of position probabilities over letter positions (rows x classes), and the number of those."""
    rows, k = len(at) - 1, len(network.classes)
    start, end, code, row = word_table(data, at, between_spaces())
    if not len(code):
        return np.zeros((rows, k)), np.zeros(rows)
    _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
    pieces, size, word = pieces_of(data, start[first], end[first])
    letter = _LETTER[pieces]
    sums = np.empty((len(pieces), k))
    for a in range(0, len(pieces), 1 << 14):
        b = a + (1 << 14)
        sums[a:b] = np.einsum("pwk,pw->pk", network.probabilities(pieces[a:b], size[a:b]), letter[a:b].astype(np.float32))
    count = np.bincount(word, letter.sum(1), len(first))
    own = np.stack([np.bincount(word, sums[:, j], len(first)) for j in range(k)], 1)
    return (np.stack([np.bincount(row, own[inverse, j], rows) for j in range(k)], 1), np.bincount(row, count[inverse], rows))


def _words_of_rows(most: int):
    def words(batches):
        for batch in batches:
            data, at = text_buffer(batch.column("text"))
            start, end, _, row = word_table(data, at, between_spaces())
            begin = np.searchsorted(row, np.arange(batch.num_rows + 1))
            out = []
            for i in range(batch.num_rows):
                n = int(begin[i + 1] - begin[i])
                pick = begin[i] + np.unique(np.linspace(0, n - 1, min(most, n)).astype(np.int64)) if n else np.zeros(0, np.int64)
                out.append([data[start[w]:min(end[w], start[w] + LONGEST)].tobytes() for w in pick])
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("_rank"), pa.array(out, pa.list_(pa.binary()))],
                                             names=["lang", "_rank", "words"])
    return words


def fit(docs: DataFrame, settings: Settings = Settings()) -> Network | None:
    """Learn from text and lang of documents outside the held-out quarter: the first ``docs_per_lang`` of each language in
    hash order, ``words_per_doc`` words spread over each whole text."""
    spark = docs.sparkSession
    prepared(spark)
    labelled = docs.select("doc_id", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 2))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    picked = labelled.withColumn("_rank", rank).filter(F.col("_rank") <= settings.docs_per_lang)
    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(picked), ["doc_id", "lang"])
    rows = (texts.select("lang", F.col("_rank").cast("int"), "text")
            .mapInArrow(tidy(_words_of_rows(settings.words_per_doc)), "lang string, _rank int, words array<binary>").collect())
    rows = sorted(({(r["lang"], r["_rank"]): [bytes(w) for w in r["words"]] for r in rows}).items())
    classes = sorted({lang for (lang, _), words in rows if words})
    words = [(classes.index(lang), w) for (lang, _), own in rows for w in own]
    if not words:
        return None
    data = np.frombuffer(b"".join(w for _, w in words), np.uint8)
    end = np.cumsum([len(w) for _, w in words])
    pieces, size, word = pieces_of(data, end - [len(w) for _, w in words], end)
    labels = np.array([c for c, _ in words])[word]
    return train(Network(classes, settings.hidden), pieces, size, labels, settings.steps)


def _has_letter(data: np.ndarray) -> bool:
    """Whether some character is a letter; ASCII is looked up, the rest is decoded in slices."""
    return bool(_LETTER[data & 0xDF | 0x20][data < 0x80].any()) or any(c.isalpha() for c in data.tobytes().decode())


def _labeller(network, slice_bytes: int):
    def label(batches):
        net: Network | None = network.value
        for batch in batches:
            data, at = text_buffer(batch.column("text"))
            lang, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            for lo, hi in row_slices(at, slice_bytes) if net else ():
                sums, count = position_sums(net, data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
                best = sums.argmax(1)
                for i in np.flatnonzero(count > 0):
                    if _has_letter(data[at[lo + i]:at[lo + i + 1]]):
                        lang[lo + i] = net.classes[best[i]]
                        score[lo + i] = min(1.0, sums[i, best[i]] / count[i])
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(lang, pa.string()), pa.array(score)],
                                             names=[*names, "lang_pred", "score"])
    return label


def identify(docs: DataFrame, network: Network | None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score. Only the text decides."""
    prepared(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(network)
    return docs.select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), "text").mapInArrow(tidy(_labeller(shared, slice_bytes)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def _keeper(network, slice_bytes: int, least: float):
    label = _labeller(network, slice_bytes)

    def keep(batches):
        for batch in batches:
            if network.value is None:  # nothing was learned: what has a letter has some language
                data, at = text_buffer(batch.column("text"))
                yield batch.filter(pa.array([_has_letter(data[at[i]:at[i + 1]]) for i in range(batch.num_rows)], pa.bool_()))
                continue
            judged = next(label(iter([batch.select(["text"])])))
            known = np.array([x != "und" for x in judged.column("lang_pred").to_pylist()], bool)
            yield batch.filter(pa.array(known & (judged.column("score").to_numpy() >= least)))
    return keep


def keep_known(docs: DataFrame, network: Network | None, least_score: float = 0.0, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of ``docs`` whose text has a language (not ``und``) with at least ``least_score``, all columns as they are. Without a
    network (no labelled row to learn from) texts with a letter stay. With the default score the network rejects nothing: only texts
    without a letter go, so that clean documents of languages that were not learned stay as well."""
    prepared(docs.sparkSession)
    return docs.mapInArrow(tidy(_keeper(docs.sparkSession.sparkContext.broadcast(network), slice_bytes, least_score)), docs.schema)
