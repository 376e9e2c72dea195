"""Ranked search against scores counted text by text."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from receptorium.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]


def best(docs, items, k):
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 50 + 50 * sum(b.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in set(terms(text)) if t in b)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(map(repr, out))


def found(df):
    return sorted(map(repr, (tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())))


@pytest.mark.parametrize("cut", [{}, {"block_rows": 7, "block_postings": 300, "items_at_once": 2, "shares": (0.1, 0.3)}])
def test_equals_counting(spark, cut):
    rnd = random.Random(3)
    common, rare = ["The", "of", "and", "été", "x1"], [f"w{i}" for i in range(60)]
    text = lambda n: rnd.choice([" ", ", ", "-", "\n"]).join(rnd.choice(common if rnd.random() < .6 else rare) for _ in range(n))
    docs = [(i % 110, text(rnd.randint(0, 40))) for i in range(120)] + [(None, "the w1 w2"), (None, "the w1 w2"), (500, None), (501, "!!"), (502, "the " * 50_000 + "w3")]
    items = [(i, text(12)) for i in range(8)] + [(8, None), (9, ""), (None, "w1 w2"), (None, "w1 w2"), (10, "nowhere")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert found(ranked.search(d, i, k=10, **cut)) == best(docs, items, 10)


def test_dropped_documents_never_belong(spark):
    """Many near-equal scores, few places: documents leave on the way, and the ranking stays exact."""
    rnd = random.Random(9)
    docs = [(i, " ".join(rnd.choice(["a", "b", "c", "d"] + [f"r{j}" for j in range(8)]) for _ in range(rnd.randint(3, 9)))) for i in range(400)]
    items = [(i, " ".join(rnd.sample(["a", "b", "c", "d"] + [f"r{j}" for j in range(8)], 6))) for i in range(12)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert found(ranked.search(d, i, k=3, shares=(0.2, 0.3, 0.4), block_rows=90)) == best(docs, items, 3)


def test_odd_rows(spark, odd, none):
    items = odd.withColumnsRenamed({"doc_id": "item_id"}).withColumn("terms", F.lit(1)).withColumn("term", F.lit(2))
    docs = odd.withColumn("term", F.lit(1)).withColumn("_block", F.lit("x"))
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(ranked.search(docs, items)) == best(rows, rows, 50)
    for a, b in ((none, items), (docs, items.limit(0)), (none, items.limit(0))):
        empty = ranked.search(a, b)
        assert empty.count() == 0 and empty.columns == ["item_id", "rank", "doc_id", "score"]


def test_long_counts_stay_exact():
    import numpy as np

    assert ranked._measure(np.array([10**9]), 10**11, 10**14).tolist() == [50 + 50 * 10**9 * 10**11 // 10**14]
