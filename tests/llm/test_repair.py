"""Conversation repair: the search against all edits, segments against whole conversations, odd rows, long conversations."""

import functools
import random
import time

import pytest
from pyspark.sql import functions as F

from receptorium.llm import repair

NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def cheapest(rows, entry=0, ends=repair.ENDS):
    """Every edit tried."""
    @functools.lru_cache(None)
    def go(i, state, puts):
        out = [(0, "")] if i == len(rows) and state in ends else []

        def way(cost, edit, *after):
            rest = go(*after)
            if rest:
                out.append((cost + rest[0], edit + rest[1]))

        if puts:
            way(2, "I", i, repair.PUT[state], puts - 1)
        if i < len(rows):
            initial, gone, cut = rows[i]
            way(3, "D", i + 1, state, 3)
            if not gone:
                way(2 + cut, "R", i + 1, repair.PUT[state], 3)
                if initial in repair.KEEP[state]:
                    way(cut, "K", i + 1, repair.KEEP[state][initial], 3)
        return min(out) if out else None

    return go(0, entry, 3)


def test_search_equals_all_edits():
    rnd = random.Random(5)
    for _ in range(300):
        rows = [(rnd.choice("suausuaaut "), rnd.random() < .15, rnd.random() < .2) for _ in range(rnd.randint(0, 12))]
        assert repair.search(rows) == cheapest(rows)
        for a in range(4):
            for b in range(4):
                assert repair.search(rows, a, frozenset((b,))) == cheapest(rows, a, frozenset((b,)))


@pytest.fixture(scope="module")
def talks(spark):
    rnd = random.Random(7)
    rows = [(None if c == 3 else c, rnd.choice([None, *range(40)]), rnd.choice(["user", "assistant", "system", "tool", None, ""]), rnd.choice(["a.", "b", "", " ", "c!\n", None, "d. e", "f?"]))
            for c in range(12) for _ in range(1 + 6 * c)]
    rows += [(50, 2**63 - 1, "user", "hi."), (50, -2**63, "assistant", "yo."), (51, 1, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({"place": F.lit(1), "seg": F.lit("x"), "audit": F.lit(None), "_long": F.lit(2)})


def test_segments_give_the_same_repair(talks):
    for rows in (talks, repair.damage(talks)):
        for work in (repair.report, repair.lines):
            whole, cut = (sorted(map(repr, work(rows, segment=n).collect())) for n in (512, 3))
            assert whole == cut
    found = {r.conv_id: r for r in repair.report(talks).collect()}
    assert len(found) == 14 and found[50].gaps == 2**63 - 1 and found[50].audit == "DI" or found[50].audit


def test_lines_fit(talks):
    import collections
    import re

    said = collections.defaultdict(list)
    for r in repair.lines(talks).sort("place").collect():
        said[r.conv_id].append(r.role[0])
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in said.values())


def test_odd_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "assistant", "x"), (3, 0, " ", " ")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    found = {r.conv_id: tuple(r)[1:8] for r in repair.report(df).collect()}
    assert found[1] == (0, 0, 0, 0, 0, 0, "KK") and found[2] == (0, 0, 0, 1, 0, 3, "D") and found[3] == (0, 1, 0, 0, 0, 3, "D")
    assert repair.report(df.limit(0)).count() == 0 and repair.report(df.limit(0)).columns == NAMES
    none = spark.createDataFrame([(8, None, None, None)], df.schema).withColumn("live", F.lit(False))
    empty = repair.report(none).first()
    assert tuple(empty) == (8, 0, 0, 0, 0, 0, 0, "", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")
    assert {r.conv_id for r in repair.report(df.withColumn("conv_id", F.concat(F.lit("c"), "conv_id"))).collect()} == {"c1", "c2", "c3"}


def test_long_conversation(spark):
    rows = spark.range(100_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                       F.concat(F.lit("line "), "id", F.when(F.col("id") % 50 == 7, "").otherwise(".")).alias("text"))
    rows = rows.union(spark.range(1).select(F.lit(2).cast("long"), F.lit(0).cast("long"), F.lit("user"), F.repeat(F.lit("é "), F.lit(5_000_000))))
    start = time.time()
    found = {r.conv_id: r for r in repair.report(repair.damage(rows)).collect()}
    assert time.time() - start < 60 and len(found[1].audit) > 99_000 and found[2].truncated + found[2].blank <= 1
