"""Conversation structure repair by iterative-deepening A*.

A conversation is well formed when the initials of its roles read ``(s?(ua)+)?``. Edits walk over its rows in order: Keep a row
(free, 1 where it is truncated), Rerole it to the one role that fits (2, and 1 where truncated), Delete it (3; the only edit of
blank and duplicate rows), or Insert an empty message of the role that fits (2). Depth-first search tries the edits in ASCII
order (D, I, K, R) under a cost bound that rises by one; a table of failed states keeps the largest rest of the bound under which
a state (row, role state) led nowhere, and serves all later bounds. The bound starts at a floor that never exceeds the cost: 3 a forced
deletion, 1 a truncated row, 2 for each of the disjoint ill-formed neighbours. So the first accepting path is the cheapest
one, and of equal ones the least in ASCII.

Ordinary conversations meet in one task each, in a sorted stream. Those of more than ``SEGMENT`` rows or ``LONG_BYTES`` bytes are
cut into segments: every segment is searched by itself, in any task, from each role state to each; a backward pass over the
segments' costs joins the answers. Only the chain of a long conversation's digest runs through one task, row by row.

Defined cases: a null role or text is one space; rows are ordered by turn (nulls first), role and text; a null conv_id is a conversation of
its own; repeated rows are duplicates; a role without a legal initial (the empty one as well) can't be kept; gaps beyond a long count
as the largest long; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from receptorium.llm.shared import prepared, written

SEGMENT = 512
LONG_BYTES = 8 << 20
SPACES = " \t\n\x0b\f\r"
#: role states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
PUT = (2, 2, 3, 2)  # the state after the only role that can be put there
ROLE = {2: "user", 3: "assistant"}
ENDS = frozenset((0, 3))
LEGAL = frozenset(("su", "ua", "au"))
_LARGEST = (1 << 63) - 1


# --- search ----------------------------------------------------------------------------------------------

def floors(rows: list[tuple[str, bool, bool]]) -> list[int]:
    """For every suffix of rows (initial, must go, truncated) a cost that no repair undercuts."""
    out = [0] * (len(rows) + 1)
    pairs = []  # disjoint ill-formed neighbours of the suffix from each remaining row on, latest row last
    initial, fixed = None, 0
    for i in range(len(rows) - 1, -1, -1):
        own, gone, cut = rows[i]
        if gone:
            fixed += 3
        else:
            fixed += cut
            least = pairs[-1] if pairs else 0
            if own not in ("s", "u", "a"):
                pairs.append(1 + least)
                initial = None  # its edit counts once
            else:
                bad = initial is not None and own + initial not in LEGAL
                pairs.append(max(least, 1 + (pairs[-2] if len(pairs) > 1 else 0)) if bad else least)
                initial = own
        out[i] = fixed + 2 * (pairs[-1] if pairs else 0)
    return out


def search(rows: list[tuple[str, bool, bool]], entry: int = 0, ends: frozenset = ENDS) -> tuple[int, str] | None:
    """(cost, edits) of the cheapest way from a role state over all rows to one of ``ends``; None where there is none."""
    n, least = len(rows), floors(rows)
    bare = max(ends) < 2  # ends that only deletions (and one kept system row) reach
    if bare and entry not in ends and (entry > min(ends) or not any(r[0] == "s" and not r[1] for r in rows)):
        return None

    def floor(i: int, state: int) -> int:
        if not bare:
            return least[i]
        return max(0, 3 * (n - i) - (3 if state == 0 and 1 in ends else 0))

    failed: dict[int, int] = {}
    for bound in range(floor(0, entry), 3 * n + 7):
        stack, path = [[0, entry, bound, 0]], []
        while stack:
            frame = stack[-1]
            i, state, rest, step = frame
            if step == 0:
                if i == n and state in ends:
                    return bound - rest, "".join(path)
                if floor(i, state) > rest or failed.get(4 * i + state, -1) >= rest:
                    stack.pop()
                    if path:
                        path.pop()
                    continue
            frame[3] = step + 1
            if step == 1:
                after = (i, PUT[state], rest - 2, "I")
            elif step == 4:
                failed[4 * i + state] = rest
                stack.pop()
                if path:
                    path.pop()
                continue
            elif i == n:
                continue
            elif step == 0:
                after = (i + 1, state, rest - 3, "D")
            else:
                initial, gone, cut = rows[i]
                if gone:
                    continue
                if step == 3:
                    after = (i + 1, PUT[state], rest - 2 - cut, "R")
                elif initial in KEEP[state]:
                    after = (i + 1, KEEP[state][initial], rest - cut, "K")
                else:
                    continue
            if after[2] >= 0:
                stack.append([after[0], after[1], after[2], 0])
                path.append(after[3])
    return None


class _Replay:
    """Messages of a repaired conversation, edit by edit."""

    def __init__(self) -> None:
        self.state = 0

    def put(self) -> str:
        self.state = PUT[self.state]
        return ROLE[self.state]

    def row(self, edit: str, role: str, text: str) -> tuple[str, str] | None:
        if edit == "D":
            return None
        if edit == "R":
            return self.put(), text
        self.state = KEEP[self.state][role[:1]]
        return role, text


def _messages(audit: str, rows: list[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of every message that stays or is put in; rows are (role, text)."""
    replay, at = _Replay(), iter(rows)
    for edit in audit:
        found = (replay.put(), "") if edit == "I" else replay.row(edit, *next(at))
        if found:
            yield edit, *found


# --- rows ------------------------------------------------------------------------------------------------

def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with rows dropped, emptied, cut, repeated or given to the user by crc32 of ``conv_id:turn``. Dropped rows stay
    as rows that are not live, so that every conversation keeps its place."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = conversations.select("conv_id", "turn", kind.alias("_kind"), text("role").alias("role"), text("text").alias("text"))
    k = F.col("_kind")
    changed = F.when(k < 2, F.lit("")).when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(k == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), changed.alias("text"),
                       (k != 0).alias("live"), F.explode(F.sequence(F.lit(1), F.when(k == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


def _noted(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, live and the faults that a row shows by itself."""
    live = F.coalesce(F.col("live"), F.lit(True)) if "live" in rows.columns else F.lit(True)
    full = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), full("role"), full("text"), live.alias("live"))
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    return out.select("*", (last == "").alias("blank"), ((last != "") & ~last.isin(".", "!", "?")).alias("cut"))


def _in_order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _tasks(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def _gaps(turns: list) -> int:
    known = [t for t in turns if t is not None]
    return min(max(known) - min(known) + 1 - len(set(known)), _LARGEST) if known else 0


_REPORT = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()),
           ("audit", pa.string()), ("repaired_sha256", pa.string())]
REPORT_SCHEMA = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_LINES = [("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
LINES_SCHEMA = "place long, edit string, role string, text string"


def _as_rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _emitted(found: Iterator[tuple], key: pa.DataType, fields: list, most_bytes: int = 4 << 20):
    """Record batches of tuples (conv_id, *fields), of a bounded number of bytes."""
    names, kinds = ["conv_id", *[f[0] for f in fields]], [key, *[f[1] for f in fields]]
    held, size = [], 0
    for row in found:
        held.append(row)
        size += 100 + sum(len(v) for v in row if isinstance(v, str))
        if size > most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


def _ordinary(as_lines: bool, key: pa.DataType):
    """Task body: whole conversations of a sorted partition."""
    def solved(rows: Iterator[tuple]):
        for conv, group in itertools.groupby(rows, key=lambda r: r[0]):
            turns, said, states, seen = [], [], [], set()
            blank = duplicate = truncated = illegal = 0
            for _, turn, role, text, live, empty, cut in group:
                if not live:
                    continue
                again = (role, text) in seen
                seen.add((role, text))
                blank += empty
                duplicate += again and not empty
                cut = cut and not again
                truncated += cut
                illegal += bool(said) and said[-1][0][:1] + role[:1] not in LEGAL
                turns.append(turn)
                said.append((role, text))
                states.append((role[:1], empty or again, cut))
            cost, audit = search(states)
            messages = _messages(audit, said)
            if as_lines:
                yield from ((conv, i, *m) for i, m in enumerate(messages))
            else:
                digest = hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in messages).encode()).hexdigest()
                yield conv, _gaps(turns), blank, duplicate, truncated, illegal, cost, audit, digest

    def run(batches):
        yield from _emitted(solved(_as_rows(batches)), key, _LINES if as_lines else _REPORT)
    return run


# --- long conversations ----------------------------------------------------------------------------------

def _segment_answers(table: pa.Table) -> pa.Table:
    """Cheapest edits of one segment from every role state to every other."""
    table = table.sort_by("place")
    rows = list(zip(*[table.column(c).to_pylist() for c in ("initial", "gone", "cut")], strict=True))
    found = [(a, b, *got) for a in range(4) for b in range(4) if (got := search(rows, a, frozenset((b,))))]
    entry, exit_, cost, audit = zip(*found, strict=True)
    key = table.slice(0, 1).select(["conv_id", "seg"]).take(pa.array([0] * len(found)))
    for name, values, kind in (("entry", entry, pa.int32()), ("exit", exit_, pa.int32()), ("cost", cost, pa.int64()), ("audit", audit, pa.string())):
        key = key.append_column(name, pa.array(values, kind))
    return key


def _before(a: tuple, b: tuple) -> bool:
    """Whether the edits of chain a come before those of b; a chain is (edits, rest) or None."""
    left, right, i, j = a, b, 0, 0
    while left is not right or i != j:
        while left is not None and i == len(left[0]):
            left, i = left[1], 0
        while right is not None and j == len(right[0]):
            right, j = right[1], 0
        if left is None or right is None:
            return right is not None
        n = min(len(left[0]) - i, len(right[0]) - j)
        x, y = left[0][i:i + n], right[0][j:j + n]
        if x != y:
            return x < y
        i, j = i + n, j + n
    return False


def _joined(key: pa.DataType):
    """Task body: the chosen edits of every segment, by a backward pass over segments that come last first."""
    def solved(rows: Iterator[tuple]):
        for conv, group in itertools.groupby(rows, key=lambda r: r[0]):
            tail = {0: "", 3: "", 1: "II", 2: "I"}
            best = {q: (2 * len(t), (t, None) if t else None) for q, t in tail.items()}
            chosen = []
            for seg, ways in itertools.groupby(group, key=lambda r: r[1]):
                now, pick = {}, {}
                for _, _, entry, exit_, cost, audit in ways:
                    if exit_ not in best:
                        continue
                    total, chain = cost + best[exit_][0], (audit, best[exit_][1])
                    if entry not in now or total < now[entry][0] or (total == now[entry][0] and _before(chain, now[entry][1])):
                        now[entry], pick[entry] = (total, chain), (exit_, audit)
                best = now
                chosen.append((seg, pick))
            state = 0
            for k in range(len(chosen) - 1, -1, -1):
                seg, pick = chosen[k]
                state, audit = pick[state]
                yield conv, seg, audit + (tail[state] if k == 0 else "")

    def run(batches):
        yield from _emitted(solved(_as_rows(batches)), key, [("seg", pa.int64()), ("audit", pa.string())])
    return run


def _replayed(as_lines: bool, key: pa.DataType):
    """Task body: rows of long conversations in order, each segment led by its edits; only the digest and the edits are held."""
    def solved(rows: Iterator[tuple]):
        for conv, group in itertools.groupby(rows, key=lambda r: r[0]):
            replay, digest, whole, cost, count = _Replay(), hashlib.sha256(), [], 0, 0
            audit, at = "", 0

            def put_in():
                nonlocal at
                while audit[at:at + 1] == "I":
                    at += 1
                    yield "I", replay.put(), ""

            def messages():
                nonlocal audit, at, cost
                for _, _, edits, role, text, cut in group:
                    if edits is not None:
                        yield from put_in()
                        audit, at = edits, 0
                        whole.append(edits)
                        continue
                    yield from put_in()
                    edit = audit[at]
                    at += 1
                    cost += bool(cut) and edit != "D"
                    found = replay.row(edit, role, text)
                    if found:
                        yield edit, *found
                yield from put_in()

            for edit, role, text in messages():
                if as_lines:
                    yield conv, count, edit, role, text
                else:
                    digest.update((("\n" if count else "") + f"{role}:{text}").encode())
                count += 1
            if not as_lines:
                edits = "".join(whole)
                yield conv, cost + 3 * edits.count("D") + 2 * (edits.count("I") + edits.count("R")), edits, digest.hexdigest()

    def run(batches):
        yield from _emitted(solved(_as_rows(batches)), key, _LINES if as_lines else [("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    return run


def _long(rows: DataFrame, as_lines: bool, kind: str, key: pa.DataType) -> DataFrame:
    conv = Window.partitionBy("conv_id").orderBy(*_in_order())
    same, placed = Window.partitionBy("conv_id", "role", "text").orderBy("place"), Window.partitionBy("conv_id").orderBy("place")
    numbered = rows.filter("live").withColumn("place", (F.row_number().over(conv) - 1).cast("long")).withColumn("again", F.row_number().over(same) > 1)
    initial = F.left("role", F.lit(1))
    numbered = numbered.select(
        "conv_id", "turn", "place", F.floor(F.col("place") / SEGMENT).alias("seg"), "role", "text", initial.alias("initial"), "blank", (F.col("again") & ~F.col("blank")).alias("again"),
        (F.col("blank") | F.col("again")).alias("gone"), (F.col("cut") & ~F.col("again")).alias("cut"), F.lag(initial).over(placed).alias("_last"))
    numbered = written(numbered, "numbered")
    narrow = numbered.select("conv_id", "seg", "place", "initial", "gone", "cut")
    answers = narrow.groupBy("conv_id", "seg").applyInArrow(_segment_answers, f"conv_id {kind}, seg long, entry int, exit int, cost long, audit string")
    answers = written(answers, "segments").repartition(_tasks(rows), "conv_id").sortWithinPartitions("conv_id", F.desc("seg"))
    edits = answers.mapInArrow(_joined(key), f"conv_id {kind}, seg long, audit string")
    void = lambda t: F.lit(None).cast(t)
    leads = edits.select("conv_id", (F.col("seg") * SEGMENT).alias("place"), "audit", void("string").alias("role"), void("string").alias("text"), F.lit(False).alias("cut"))
    both = leads.unionByName(numbered.select("conv_id", "place", void("string").alias("audit"), "role", "text", "cut"))
    # a segment's edits come before its first row
    both = both.repartition(_tasks(rows), "conv_id").sortWithinPartitions("conv_id", "place", F.col("audit").isNull())
    if as_lines:
        return both.mapInArrow(_replayed(True, key), f"conv_id {kind}, {LINES_SCHEMA}")
    solved = both.mapInArrow(_replayed(False, key), f"conv_id {kind}, cost long, audit string, repaired_sha256 string")
    many = lambda c: F.count_if(c)
    span = F.max("turn").cast("decimal(38,0)") - F.min("turn").cast("decimal(38,0)") + 1 - F.count_distinct("turn")
    counts = numbered.groupBy("conv_id").agg(
        F.least(F.coalesce(span, F.lit(0)), F.lit(_LARGEST)).cast("long").alias("gaps"), many(F.col("blank")).alias("blank"), many(F.col("again")).alias("duplicate"),
        many(F.col("cut")).alias("truncated"), many(~F.concat("_last", "initial").isin(*sorted(LEGAL))).alias("illegal"))
    counts = counts.withColumnRenamed("conv_id", "_conv")
    joined = solved.join(counts, F.col("conv_id").eqNullSafe(F.col("_conv")))
    return joined.select("conv_id", *[f[0] for f in _REPORT])


def _solved(conversations: DataFrame, as_lines: bool, segment: int, long_bytes: int) -> DataFrame:
    prepared(conversations.sparkSession)
    rows = _noted(conversations)
    kind = rows.schema["conv_id"].dataType.simpleString()
    key = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    if kind not in ("bigint", "int", "string"):
        rows, kind = rows.withColumn("conv_id", F.col("conv_id").cast("string")), "string"
    sizes = rows.groupBy("conv_id").agg(F.count_if("live").alias("_n"), F.sum(F.octet_length("text")).alias("_bytes"))
    long_ones = written(sizes.filter((F.col("_n") > segment) | ((F.col("_bytes") > long_bytes) & (F.col("_n") > 0))).select(F.col("conv_id").alias("_long")), "long")
    some = not long_ones.isEmpty()
    same = F.col("conv_id").eqNullSafe(F.col("_long"))
    few = rows.join(long_ones, same, "left_anti") if some else rows
    few = few.repartition(_tasks(rows), "conv_id").sortWithinPartitions("conv_id", *_in_order())
    out = few.mapInArrow(_ordinary(as_lines, key), f"conv_id {kind}, {LINES_SCHEMA if as_lines else REPORT_SCHEMA}")
    return out.unionByName(_long(rows.join(long_ones, same, "left_semi"), as_lines, kind, key)) if some else out


def report(conversations: DataFrame, segment: int = SEGMENT, long_bytes: int = LONG_BYTES) -> DataFrame:
    """Faults, cost, edits and digest of the repaired ``role:text`` lines of every conversation.

    conversations: conv_id, turn, role, text (and live: rows that are not are only there to name their conversation)."""
    return _solved(conversations, False, segment, long_bytes)


def lines(conversations: DataFrame, segment: int = SEGMENT, long_bytes: int = LONG_BYTES) -> DataFrame:
    """The repaired conversations: conv_id, place, edit (I, K or R), role, text."""
    return _solved(conversations, True, segment, long_bytes)
