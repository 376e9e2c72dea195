import random

import numpy as np
import pytest

from receptorium.constants import BLOSUM62, BLOSUM_LETTERS
from receptorium.functions import kernels as K

ROWS = [[int(v) for v in line.split()] for line in BLOSUM62.strip().splitlines()]


def sub(a, b):
    i, j = BLOSUM_LETTERS.find(a), BLOSUM_LETTERS.find(b)
    return -4 if i < 0 or j < 0 else ROWS[max(i, j)][min(i, j)]


def matrix_distance(a, b):
    a, b = a[3:len(a) - 2] or a, b[3:len(b) - 2] or b
    s, l = (a, b) if len(a) <= len(b) else (b, a)
    return min(sum(sub(x, x) - sub(x, y) for x, y in zip(s, l[o:])) for o in range(len(l) - len(s) + 1)) + 8 * (len(l) - len(s))


def words(n, low, high, letters="ACDEFGHIKLMNPQRSTVWYXU"):
    rng = random.Random(7)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n)]


def test_matrix_distance_against_definition():
    seqs = words(50, 1, 16)
    got = K.blosum_block(seqs, seqs)
    assert all(got[i, j] == matrix_distance(a, b) for i, a in enumerate(seqs) for j, b in enumerate(seqs))
    assert not got.diagonal().any()


def test_tcrdist_golden():
    assert K.cdr3_block(["CASSIRSSYEQYF"], ["CASSIRSAYEQYF"])[0, 0] == 9
    assert K.cdr3_block(["CASSIRSSYEQYF"], ["CASSIRSSYEQYF"])[0, 0] == 0
    assert K.loop_block(["E.KKES"], ["E.KKES"])[0, 0] == 0 and K.loop_block(["E.K"], ["EAK"])[0, 0] == 4


def gotoh(a, b, local, opening, extend, score):
    n, m, low = len(a), len(b), -1e9
    h, e, f = (np.full((n + 1, m + 1), x) for x in (low, low, low))
    h[0, 0] = 0
    best = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if i:
                f[i, j] = max(h[i - 1, j] + opening, f[i - 1, j] + extend)
            if j:
                e[i, j] = max(h[i, j - 1] + opening, e[i, j - 1] + extend)
            if i or j:
                d = h[i - 1, j - 1] + score(a[i - 1], b[j - 1]) if i and j else low
                h[i, j] = max(d, e[i, j], f[i, j], 0 if local else low)
            best = max(best, h[i, j])
    return best if local else h[n, m]


@pytest.mark.parametrize("local", [True, False])
def test_alignment_scores_and_traceback(local):
    a, b = words(80, 1, 14, "ACGT"), words(160, 1, 14, "ACGT")[80:]
    opening, extend = (-6, -1) if local else (-5, -0.5)
    plain = lambda x, y: 2 if x == y else -1
    expected = [gotoh(x, y, local, opening, extend, plain) for x, y in zip(a, b)]
    got = K.local_scores(a, b).diagonal() if local else K.global_scores(a, b)
    assert np.allclose(got, expected)
    for x, y, (ts, qs), want in zip(a, b, K.aligned_pairs(a, b, local, opening=opening, extend=extend)[1], expected):
        if local and not want:
            continue
        ends = [] if local else [(-1, -1)]
        path = ends + list(zip(ts.tolist(), qs.tolist())) + ([] if local else [(len(x), len(y))])
        total = sum(plain(x[i], y[j]) for i, j in zip(ts, qs))
        total += sum(opening + extend * (g - 1) for (i, j), (k, l) in zip(path, path[1:]) for g in (k - i - 1, l - j - 1) if g)
        assert total == want
        if not local:
            rows = K.gapped(x, y, ts, qs)
            assert [r.replace("-", "") for r in rows] == [x, y] and len(rows[0]) == len(rows[1])


def test_smallest_prefers_early_columns():
    rows, cols = K.smallest(np.array([[3, 1, 1, np.nan, 1], [0, 0, 9, 9, 9.0]]), 2)
    assert rows.tolist() == [0, 0, 1, 1] and cols.tolist() == [1, 2, 0, 1]


def test_traceback_is_the_same_block_by_block(monkeypatch):
    targets, queries = words(24, 0, 30, "ACGT"), words(48, 0, 30, "ACGT")[24:]
    for local in (True, False):
        for scores in (None, K.blosum()):
            monkeypatch.setattr(K, "CELLS_AT_ONCE", 4_000_000)
            whole = K.aligned_pairs(targets, queries, local, scores)
            monkeypatch.setattr(K, "CELLS_AT_ONCE", 200)
            parts = K.aligned_pairs(targets, queries, local, scores)
            assert (whole[0] == parts[0]).all()
            assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(whole[1], parts[1]))


def test_long_pairs_need_little_memory():
    import tracemalloc

    rng = random.Random(1)
    long_ = "".join(rng.choice("ACGT") for _ in range(6000))
    other = long_[:2000] + long_[2050:]
    tracemalloc.start()
    _, [(ts, qs)] = K.aligned_pairs([long_], [other], False)
    assert len(ts) == len(other) and tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
