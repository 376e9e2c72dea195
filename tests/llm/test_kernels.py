"""Numpy kernels against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from receptorium.llm import fm_index, gru, minhash, packing, words
from receptorium.llm.shared import row_slices, text_buffer


@pytest.mark.parametrize("table, pattern", [(words.letters_and_digits(), r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (words.between_spaces(), r"[^\x00\x20\x09-\x0D]+")])
def test_words_and_hashes(monkeypatch, table, pattern):
    monkeypatch.setattr(words, "SLICE", 64)
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab AB,.\n\té9ñ ") for _ in range(rng.randint(0, 400))) for _ in range(100)] + ["", None, "x" * 300, "a", "b"]
    data, at = text_buffer(pa.array(texts))
    start, end, code, row = words.word_table(data, at, table)
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    want = [(i, w) for i, t in enumerate(texts) for w in re.findall(pattern, low(t or ""))]
    assert [(int(r), low(bytes(data)[a:b].decode())) for r, a, b in zip(row, start, end, strict=True)] == want
    assert len(set(code.tolist())) == len({w for _, w in want})


def test_row_slices_cover_all_rows_once():
    at = np.cumsum([0, 5, 0, 100, 3, 0])
    ranges = list(row_slices(at, 10))
    assert [r for a, b in ranges for r in range(a, b)] == list(range(5))


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(0)
    for trial in range(20):
        k, n = int(rng.integers(1, 9)), int(rng.integers(1, 300))
        text = np.append(np.concatenate([np.tile(rng.integers(1, k + 1, 20), 1 + 5 * (trial % 2)), rng.integers(0, k + 1, n)]), 0)
        index = fm_index.FMIndex(text, k)
        phrases = [p for _ in range(40) if len(p := text[(i := int(rng.integers(0, len(text)))):i + int(rng.integers(1, 10))]) and (p > 0).all()]
        if phrases:
            padded = np.array([np.append(np.zeros(10 - len(p), int), p) for p in phrases])
            for p, low, high in zip(phrases, *index.search(padded, np.array([len(p) for p in phrases])), strict=True):
                want = [i for i in range(len(text) - len(p) + 1) if (text[i:i + len(p)] == p).all()]
                assert sorted(index.locate(np.arange(low, high)).tolist()) == want


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    net = gru.Network(["a", "b", "c"], hidden=5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    size, labels = np.array([7, 6, 4, 3, 1, 1]), rng.integers(0, 3, 6)
    pieces = np.where(np.arange(7) < size[:, None], rng.integers(1, 256, (6, 7)), 0)
    _, grad = net.gradients(pieces, size, labels)
    for name, value in net.p.items():
        at = (pieces[0, 2], 1) if name[0] == "t" else tuple(rng.integers(0, s) for s in value.shape)
        kept, sides = value[at], []
        for step in (1e-3, -1e-3):
            value[at] = kept + step
            sides.append(net.gradients(pieces, size, labels)[0])
        value[at] = kept
        assert abs((sides[0] - sides[1]) / 2e-3 - grad[name][at]) < 2e-4


def _shingles(text):
    w = text.lower().split()
    k = min(5, len(w))
    return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def probability_jaccard(x, y):
    p, q = ({k: c / sum(s.values()) for k, c in s.items()} for s in (x, y))
    return sum(1 / sum(max(p.get(d, 0) / p[c], q.get(d, 0) / q[c]) for d in {*p, *q}) for c in p if c in q)


def test_similarity_and_its_estimate():
    rng = np.random.default_rng(1)
    one = [f"w{i}" for i in rng.integers(0, 1000, 300)]
    two = ["zz" if i % 60 == 0 else w for i, w in enumerate(one)] + one[:40]
    texts = [" ".join(one), " ".join(two), "one two", "", "a " * 50]
    row, value, weight = minhash.shingles_of(*text_buffer(pa.array(texts)))
    assert [sorted(weight[row == i].tolist()) for i in range(5)] == [sorted(_shingles(t).values()) for t in texts]
    a, b = ((value[row == i], weight[row == i]) for i in (0, 1))
    exact = probability_jaccard(_shingles(texts[0]), _shingles(texts[1]))
    assert abs(minhash.similarity(a, b) - exact) < 1e-12
    sig = minhash.signatures(row, value, weight, 5, registers=4096)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.04 and not sig[3].any()


def test_packing_plan_places_every_piece_without_gaps():
    rng = random.Random(3)
    for _ in range(40):
        capacity, n = rng.choice([10, 16, 50, 1024]), rng.choice([0, 1, 5, 50, 2000])
        items = Counter(min(capacity, int(rng.expovariate(3 / capacity)) + 1) if rng.random() < 0.5 else rng.randint(1, capacity) for _ in range(n))
        total, fill = Counter(), {}
        for length, first, many, sequence, offset in packing.plan(items, capacity):
            assert first == total[length]
            total[length] += many
            for i in range(many):
                fill.setdefault(sequence + i, []).append((offset, length))
        assert total == items
        for own in fill.values():
            own.sort()
            assert [o for o, _ in own] == [sum(x for _, x in own[:i]) for i in range(len(own))] and sum(x for _, x in own) <= capacity
            assert sum(3 * x > capacity for _, x in own) <= 2
        if n >= 50:
            assert len(fill) <= 1.05 * -(-sum(k * c for k, c in items.items()) // capacity) + sum(c for k, c in items.items() if 2 * k > capacity)
    assert packing.piece_bounds(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)] and packing.piece_bounds(2048, 1024) == [(0, 1024), (1024, 1024)]
