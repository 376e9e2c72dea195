"""The search by prefixes, piece after piece, gives the rows of the full distance matrix; only nearest rows leave a task."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from receptorium.functions import kernels as K, nearest as N, tree as T
from receptorium.operators import nearest_pieces, similar

BLOCK = {"blosum": K.blosum_block, "tcrdist": K.cdr3_block}


def words(n, low, high, letters, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n)]


def searched(found, asked, engine, k, kinds, shift, pieces):
    """(rows, columns, distances, largest), by a search of ``pieces`` pieces."""
    search = T.Search(asked, engine, k)
    for p in range(pieces):
        columns = np.arange(p, len(found[0]), pieces)
        piece = T.Piece([[part[i] for i in columns] for part in found], engine, None if kinds is None else kinds[columns])
        search.through(piece, columns, p, shift)
    rows, piece, columns, d, top = search.result()
    columns = columns * pieces + piece
    order = np.lexsort((columns, d, rows))
    return rows[order], columns[order], d[order], top


@pytest.mark.parametrize("engine", list(BLOCK))
@pytest.mark.parametrize("letters", ["ACDEFGHIKLMNPQRSTVWYXU", "AST"])
@pytest.mark.parametrize("at_once, share", [(1 << 20, 16), (5_000, 1 << 40), (5_000, 2)])
def test_nearest_and_farthest(monkeypatch, engine, letters, at_once, share):
    monkeypatch.setattr(T, "PAIRS_AT_ONCE", at_once)
    monkeypatch.setattr(T, "DENSE_SHARE", share)
    found = words(500, 0, 16, letters, 1)
    asked = words(30, 0, 16, letters, 2) + found[:10]
    added, kinds = np.random.default_rng(1).integers(0, 30, (3, len(asked))), np.arange(len(found)) % 3
    whole = BLOCK[engine](asked, found)
    for some, shift, d in ((None, None, whole), (kinds, lambda rows: added[:, rows], whole + added[kinds].T)):
        for k, pieces in ((1, 1), (7, 1), (7, 3), (600, 2)):
            rows, columns, value, top = searched([found], [asked], engine, k, some, shift, pieces)
            want = K.smallest(d, k)
            assert (rows == want[0]).all() and (columns == want[1]).all() and (value == d[want]).all()
            assert (top == d.max(axis=1)).all()


def test_pairs_of_names():
    found, asked = [words(600, 0, 14, "ACDEF", s) for s in (5, 6)], [words(40, 0, 14, "ACDEF", s) for s in (7, 8)]
    added, kinds = np.random.default_rng(1).integers(0, 30, (3, 40)), np.arange(600) % 3
    d = K.cdr3_block(asked[0], found[0]) + K.cdr3_block(asked[1], found[1]) + added[kinds].T
    for pieces in (1, 4):
        rows, columns, value, top = searched(found, asked, "tcrdist", 9, kinds, lambda rows: added[:, rows], pieces)
        want = K.smallest(d, 9)
        assert (rows == want[0]).all() and (columns == want[1]).all() and (value == d[want]).all() and (top == d.max(axis=1)).all()


def test_a_piece_costs_less_than_scoring_it():
    found, asked = sorted(set(words(300_000, 10, 11, "SGTLQAPNRY", 9))), words(256, 10, 11, "SGTLQAPNRY", 10)
    search, old = T.Search([asked], "blosum", 10), N.Piece(found, "blosum")
    piece, columns = T.Piece([found], "blosum"), np.arange(len(found))
    search.through(piece, columns)
    began = time.process_time()
    search.through(piece, columns + len(found), 1)
    again, began = time.process_time() - began, time.process_time()
    old.nearest(asked, 10)
    assert again < time.process_time() - began


def test_pieces_of_a_block_are_searched_by_one_task(spark, monkeypatch):
    monkeypatch.setattr(nearest_pieces, "CANDIDATES_PER_PIECE", 40)
    names = list(dict.fromkeys("CAS" + x + "EQYF" for x in words(400, 4, 6, "ACDEF", 11)))
    rows = [("b", x, i if i % 7 else None, 1) for i, x in enumerate(names)] + [("other", names[0], 0, 1)]
    pool = spark.createDataFrame(rows, "block string, cdr3 string, first_row long, n long")
    asked = [("b", x, x) for x in [*words(20, 8, 12, "ACDEF", 12), *names[:20]]]
    probes = spark.createDataFrame([*asked, ("none", "CASS", "CASS")], "block string, probe string, cdr3 string")
    got = nearest_pieces.nearest_candidates(probes, pool, 5, "blosum", "block", ["cdr3"], [], skip_identical=True).collect()
    assert len(got) == 5 * len({x[1] for x in asked})
    order = np.array([i if i % 7 else 10**6 for i in range(len(names))])
    d = K.blosum_block([x[1] for x in asked], names)
    for i, (_, probe, _) in enumerate(asked):
        want = sorted((d[i, j], order[j]) for j in range(len(names)) if names[j] != probe)[:5]
        mine = sorted((r.distance, 10**6 if r.first_row is None else r.first_row) for r in got if r.probe == probe)
        assert mine == want and {r.max_distance for r in got if r.probe == probe} == {d[i].max()}


def test_a_candidate_behind_k_rows_is_not_fetched(spark, make_index):
    index = make_index([{"species": "human", "chain": "beta", "v_gene": "TRBV1", "cdr3_aa": c} for c in ["CASSAEQYF"] * 9 + ["CASSWEQYF"] * 3 + ["CASWWEQYF"]])
    probes = spark.createDataFrame([("q", "human", "beta", "*", "CASSAEQYF"), ("p", "human", "*", "*", "CASSWEQYF")], "qid string, scope string, chain string, family string, cdr3 string")
    got = similar.nearest_records(probes, index, 5).orderBy("qid", "rank").collect()
    assert [(r.qid, r.src_row) for r in got] == [("p", 9), ("p", 10), ("p", 11), ("p", 12), ("p", 0)] or [r.src_row for r in got][5:] == [0, 1, 2, 3, 4]
    assert [r.src_row for r in got if r.qid == "q"] == [0, 1, 2, 3, 4] and {r.qid for r in got} == {"p", "q"}
    most = {r.qid: r.max_distance for r in got}
    assert most["q"] == K.blosum_block(["CASSAEQYF"], ["CASWWEQYF"])[0, 0]


def test_rows_alike_are_kept_once(spark, make_index):
    index = make_index([{"species": "human", "chain": "beta", "v_gene": "TRBV1", "cdr3_aa": "CASSF"}] * 5 + [{"species": "human", "cdr3_aa": None}])
    got = {r.i_cdr3: (r.n, r.first_row) for r in similar._alike(similar._search_frame(index), []).collect()}
    assert got == {"CASSF": (5, 0), "": (1, 5)}
