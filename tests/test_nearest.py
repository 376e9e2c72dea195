"""The search by parts gives the rows of the full distance matrix."""

import random
import time

import numpy as np
import pytest

from receptorium.functions import kernels as K, nearest as N

BLOCK = {"blosum": K.blosum_block, "tcrdist": K.cdr3_block, "loop": K.loop_block}


def words(n, low, high, letters, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n)]


@pytest.mark.parametrize("engine", ["blosum", "tcrdist"])
@pytest.mark.parametrize("letters", ["ACDEFGHIKLMNPQRSTVWYXU", "AST"])
def test_nearest_and_farthest_of_a_piece(engine, letters):
    found = list(dict.fromkeys(words(3000, 0, 16, letters, 1)))
    asked = words(70, 0, 16, letters, 2) + found[:30]
    added = np.random.default_rng(1).integers(0, 30, (3, len(asked))).astype(np.float32)
    kinds = np.arange(len(found)) % 3
    same = np.array([found.index(x) if x in found else -1 for x in asked])
    whole = BLOCK[engine](asked, found)
    assert (N.Piece(found, engine).distances(asked) == whole.T).all()
    for kind, shift, d in ((None, None, whole), (kinds, lambda rows: added[:, rows], whole + added[kinds].T)):
        for left_out in (None, same):
            e = d.copy()
            if left_out is not None:
                e[np.flatnonzero(same >= 0), same[same >= 0]] = np.nan
            for k in (1, 7, 5000):
                rows, columns, value, top = N.Piece(found, engine, kind).nearest(asked, k, left_out, shift)
                order = np.lexsort((columns, value, rows))
                want = K.smallest(e, k)
                assert (rows[order] == want[0]).all() and (columns[order] == want[1]).all() and (value[order] == e[want]).all()
                assert (top == np.maximum(0, np.nan_to_num(e).max(axis=1))).all()


def test_long_names_leave_the_two_byte_range():
    found, asked = words(40, 300, 420, "ACDEFGHW", 3), words(5, 300, 420, "ACDEFGHW", 4)
    rows, columns, value, top = N.Piece(found, "blosum").nearest(asked, 40)
    d = K.blosum_block(asked, found)
    assert len(rows) == d.size and (d[rows, columns] == value).all() and (top == d.max(axis=1)).all()


def test_pairs_of_names():
    a, b = words(500, 3, 14, "ACDEF", 5), words(500, 3, 14, "ACDEF", 6)
    asked = [words(40, 3, 14, "ACDEF", 7), words(40, 3, 14, "ACDEF", 8)]
    d = K.cdr3_block(asked[0], a) + K.cdr3_block(asked[1], b)
    rows, columns, value, top = N.nearest_pairs([a, b], asked, 9, np.zeros(500, int), lambda rows: np.zeros((1, len(rows))))
    order, want = np.lexsort((columns, value, rows)), K.smallest(d, 9)
    assert (rows[order] == want[0]).all() and (columns[order] == want[1]).all() and (value[order] == d[want]).all()
    assert (top == d.max(axis=1)).all()


def test_a_candidate_costs_less_than_a_matrix_product():
    found = sorted(set(words(40_000, 12, 14, "SGTLQAPNRY", 9)))
    asked = words(256, 12, 14, "SGTLQAPNRY", 10)
    began = time.process_time()
    N.Piece(found, "blosum").nearest(asked, 10)
    by_parts, began = time.process_time() - began, time.process_time()
    K.smallest(K.blosum_block(asked, found), 10)
    assert by_parts < time.process_time() - began


@pytest.mark.parametrize("engine", list(BLOCK))
def test_distances_side_by_side(engine):
    a, b = words(300, 0, 20, "ACDEFGHIKLMNPQRSTVWYXU", 11), words(300, 0, 20, "ACDEFGHIKLMNPQRSTVWYXU", 12)
    assert (N.pair_distances(a, b, engine) == BLOCK[engine](a, b).diagonal()).all()


def test_side_by_side_in_one_step_per_length():
    a, b = words(20_000, 8, 12, "ACDEFGHIKLMNPQRSTVWY", 13), words(20_000, 8, 12, "ACDEFGHIKLMNPQRSTVWY", 14)
    began = time.process_time()
    N.pair_distances(a, b, "blosum")
    assert time.process_time() - began < 2  # one call of the matrix kernel per distinct name takes longer
