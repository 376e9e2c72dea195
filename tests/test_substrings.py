"""Substring lookup against every pair."""

import random

from receptorium.operators.substrings import containing


def test_equals_every_pair(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("acgt") for _ in range(rng.randrange(60))) for _ in range(200)] + [None, "", "héllo wörld"]
    needles = [t[3:3 + n] for t in texts[:60] if t for n in (1, 3, 5, 8, 20)] + ["", "acgtacgtacgtacgt", "lo w", "zzzzz", None]
    got = containing(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(t,) for t in texts], "text string"))
    want = {(n, t) for n in set(needles) if n for t in set(texts) if t is not None and n in t}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert containing(spark.createDataFrame([("",)], "needle string"), spark.createDataFrame([("a",)], "text string")).count() == 0
