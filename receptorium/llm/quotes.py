"""Quotation linking for conversations: nested quote levels, hashed passages, originals, and reply order without quotes.

A line's quote level is the number of leading ``>``. Runs of lines of one level are quoted passages; words of a passage, in
lower case and without punctuation, are hashed, as are its single lines. The same hashes of every message's own paragraphs,
lines and whole body meet them within the conversation: a passage's original is the earliest message that says it unquoted,
before the quoting turn. A message answers the original of its shallowest (then longest) linked passage; without one it opens
a thread of its own. Reply order is the order of paths from thread to message, found by pointer doubling, so neither a long
thread nor a conversation of any size meets in one task.

Defined cases: null and empty texts have an empty body; a null conversation or turn links to nothing; of repeated (conversation,
turn) rows all are kept, and they share the least of their parents; quotes without original are dropped from the body all the
same and counted; other columns play no part.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from receptorium.llm.shared import prepared, tidy, written

_LEVEL = re.compile(r"[ \t]*((?:>[ \t]?)*)")
_WORD = re.compile(r"[^\W_]+")
_INTRODUCTION = re.compile(r"(?:wrote|writes|schrieb|escribió|a écrit)\s*:\s*$", re.I)


def passage_hash(text: str) -> tuple[int, int] | None:
    """(hash, words) of a normalised passage; None without words."""
    words = _WORD.findall(text.lower())
    if not words:
        return None
    return int.from_bytes(hashlib.blake2b(" ".join(words).encode(), digest_size=8).digest(), "little", signed=True), len(words)


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """(body without quotes, quoted passages as (level, text))."""
    body: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    before = 0
    for line in text.split("\n"):
        mark = _LEVEL.match(line)
        level, rest = mark[1].count(">"), line[mark.end():]
        if not level:
            body.append(line)
        elif level == before and rest.strip():
            passages[-1][1].append(rest)
        else:
            if not before and body and _INTRODUCTION.search(body[-1]):
                body.pop()
            passages.append((level, [rest] if rest.strip() else []))
        before = level
    return "\n".join(body).strip("\n"), [(level, "\n".join(lines)) for level, lines in passages if lines]


def _units(parts: list[str]) -> list[tuple[int, int]]:
    """Hashes of each part and of each of its lines."""
    found = {h for part in parts for piece in (part, *part.split("\n")) if (h := passage_hash(piece))}
    return sorted(found)


_UNIT = pa.struct([("hash", pa.int64()), ("words", pa.int32()), ("level", pa.int32())])


def _parser(batches):
    for batch in batches:
        body, own, quoted, count = [], [], [], []
        for text in batch.column("text").to_pylist():
            rest, passages = parse(text or "")
            body.append(rest)
            count.append(len(passages))
            own.append([h for h, _ in _units([rest, *re.split(r"\n[ \t]*\n", rest)])])
            quoted.append([{"hash": h, "words": n, "level": level} for level, p in passages for h, n in _units([p])])
        names = ["conv_id", "turn", "role"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(body, pa.string()), pa.array(count, pa.int64()),
                                          pa.array(own, pa.list_(pa.int64())), pa.array(quoted, pa.list_(_UNIT))], names=[*names, "body", "n_quotes", "_own", "_quoted"])


def _paths(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, path): turns from the thread's first message to each. ``parents``: one row per turn that has one."""
    state = written(parents.select("conv_id", "turn", F.col("parent").alias("_up"), F.array("parent", "turn").alias("path")), "paths")
    while not state.filter(F.col("_up").isNotNull()).isEmpty():
        above = state.select("conv_id", F.col("turn").alias("_up"), F.col("_up").alias("_higher"), F.col("path").alias("_front"))
        state = written(state.join(above, ["conv_id", "_up"], "left").select(
            "conv_id", "turn", F.col("_higher").alias("_up"),
            F.when(F.col("_front").isNull(), F.col("path")).otherwise(F.concat("_front", F.expr("slice(path, 2, size(path))"))).alias("path")), "paths")
    return state.select("conv_id", "turn", "path")


def link(conversations: DataFrame) -> DataFrame:
    """Per message: conv_id, turn, role, body, n_quotes, n_linked (quoted units with an original), parent_turn (null: opens a
    thread), reply_path and position (from 0, in reply order inside the conversation)."""
    prepared(conversations.sparkSession)
    kinds = {n: conversations.schema[n].dataType.simpleString() for n in ("conv_id", "turn", "role")}
    schema = (f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role {kinds['role']}, body string, n_quotes long, _own array<long>, "
              "_quoted array<struct<hash: long, words: int, level: int>>")
    parsed = written(conversations.select("conv_id", "turn", "role", "text").mapInArrow(tidy(_parser), schema), "messages")
    origin = parsed.select("conv_id", "turn", F.explode("_own").alias("hash")).groupBy("conv_id", "hash").agg(F.min("turn").alias("_origin"))
    asked = parsed.select("conv_id", "turn", F.inline("_quoted"))
    met = asked.join(origin, ["conv_id", "hash"]).filter(F.col("_origin") < F.col("turn"))
    best = F.min(F.struct("level", (-F.col("words")).alias("_long"), "_origin")).alias("_best")
    parents = written(met.groupBy("conv_id", "turn").agg(best, F.count_distinct("hash").alias("n_linked"))
                      .select("conv_id", "turn", F.col("_best._origin").alias("parent"), "n_linked"), "parents")
    placed = (parsed.join(parents, ["conv_id", "turn"], "left").join(_paths(parents), ["conv_id", "turn"], "left")
              .withColumn("path", F.coalesce("path", F.array("turn"))).withColumn("_tie", F.xxhash64("role", "body")))
    # Positions without a task per conversation: ranks inside key ranges, plus what earlier ranges hold of the conversation.
    tasks = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(placed.drop("_own", "_quoted").repartitionByRange(tasks, "conv_id", "path", "_tie").withColumn("_range", F.spark_partition_id()), "ranged")
    inside = F.row_number().over(Window.partitionBy("_range", "conv_id").orderBy("path", "_tie"))
    counts = ranged.groupBy("conv_id", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("conv_id").alias("_conv"), F.col("_range").alias("_of"), before.alias("_before"))
    joined = ranged.withColumn("_inside", inside).join(offsets, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_range") == F.col("_of")))
    return joined.select("conv_id", "turn", "role", "body", "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.col("parent").alias("parent_turn"),
                         F.col("path").alias("reply_path"), (F.col("_before") + F.col("_inside") - 1).alias("position"))
