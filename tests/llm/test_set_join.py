"""Set join against all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from receptorium.llm import set_join


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    n = min(4, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()


def classes(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                root[top(i)] = top(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[top(i)] = min(name, least.get(top(i), name))
    return sorted(map(repr, ((name, len(s), least.get(top(i))) for i, ((name, _), s) in enumerate(zip(rows, sets)))))


def family(rnd, first, members, words):
    base = [f"w{rnd.randrange(900)}" for _ in range(words)]
    for i in range(members):
        own = list(base)
        for _ in range(rnd.randrange(3)):
            own[rnd.randrange(len(own))] = f"x{rnd.randrange(10**6)}"
        if rnd.random() < .3:
            base = own
        yield first + i, " ".join(own)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    rows = [r for k in range(12) for r in family(rnd, 1000 * k, rnd.choice([2, 5, 25]), rnd.choice([12, 40, 150, 400]))]
    passage = " ".join(f"common{i}" for i in range(60))
    rows += [(20_000 + i, passage + " " + " ".join(f"y{rnd.randrange(50)}" for _ in range(rnd.randrange(30)))) for i in range(60)]
    rows += [(30_000 + i, " ".join(f"z{rnd.randrange(30)}" for _ in range(rnd.randrange(9)))) for i in range(80)]
    rows += [(40_000, "The CAT sat on\x00 the mat"), (40_001, "the cat\nsat on\x00 the  MAT"), (40_002, "the cat sat on the mat"), (None, "the cat sat on the mat"), (None, "alone at last")]
    rows += [(40_010, "long " * 50_000), (40_011, " ".join(f"v{i}" for i in range(30_000))), (40_012, " ".join(f"v{i}" for i in range(29_000)))]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [(1024, 256), (8, 4)])
def test_equals_all_pairs(spark, texts, sizes, monkeypatch):
    monkeypatch.setattr(set_join, "BLOCK", sizes[0])
    monkeypatch.setattr(set_join, "BAG_BLOCK", sizes[1])
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("token", F.lit(1)).withColumn("_text", F.lit("x")).withColumn("n", F.lit(2.0))
    members, links = set_join.join(df)
    assert sorted(repr(tuple(r)) for r in members.collect()) == classes(texts)
    assert members.columns == ["doc_id", "n_shingles", "component_id"] and links.filter("overlap < 1").count() == 0


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(repr(tuple(r)) for r in set_join.join(odd)[0].collect()) == classes(rows)
    assert set_join.join(none)[0].count() == 0


def test_lists_skip_blocks_but_lose_no_partner():
    rnd = np.random.default_rng(2)
    for _ in range(200):
        m = rnd.integers(2, 30)
        size = np.sort(rnd.integers(3, 60, m))
        place = rnd.integers(0, 9, m)
        order = np.lexsort((place, size))
        size, place = size[order], place[order]
        fits = lambda i, j: (100 * min(size[i], size[j]) >= 85 * max(size[i], size[j]) and place[i] <= size[i] - set_join.needed(size[i], size[j])
                             and place[j] <= size[j] - set_join.needed(size[i], size[j]))
        want = [any(fits(i, j) for j in range(m) if j != i) for i in range(m)]
        assert set_join.partners(size, place).tolist() == want


def test_answers_are_derived():
    rnd = np.random.default_rng(4)
    base = rnd.choice(1000, 200, replace=False)
    sets = []
    for _ in range(30):
        base = base.copy()
        base[rnd.integers(200)] = rnd.integers(1000, 2000)
        sets.append(np.unique(base).astype(np.uint64))
    answers = set_join.Answers(sets)
    for own in sets + [np.array([5, 7], np.uint64)]:
        assert answers.of(own).tolist() == [len(np.intersect1d(own, x)) for x in sets]
    assert answers.derived == 29


def test_bit_maps_never_exceed_the_difference():
    rnd = np.random.default_rng(6)
    for n in (3, 200, 3000):
        a = np.unique(rnd.integers(0, 1 << 60, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[:n - n // 10], rnd.integers(0, 1 << 60, n // 5, dtype=np.uint64)]))
        width = 8 * min(len(set_join.bit_map(a)), len(set_join.bit_map(b)))
        apart = np.bitwise_count(set_join._folded(set_join.bit_map(a).tobytes(), width) ^ set_join._folded(set_join.bit_map(b).tobytes(), width)).sum()
        assert apart <= len(np.setxor1d(a, b))
