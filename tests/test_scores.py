"""Scores cell by cell equal those row by row, tracebacks of many pairs at once are those of one, and Python work keeps its tasks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from receptorium.functions import kernels as K
from receptorium.operators import assign
from receptorium.session import spread


def words(n, low, high, letters, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n)]


@pytest.mark.parametrize("letters", ["ACGT", "AC", "ACDEFGHIKLMNPQRSTVWYX"])
@pytest.mark.parametrize("cost", [(2, -1, -6, -1), (2, -1, -2, -1), (5, -4, -3, -2)])
def test_cell_by_cell(letters, cost):
    queries, targets = words(200, 0, 40, letters, 1) + ["", "\u00e9A"], words(8, 0, 50, letters, 2) + ["", (letters * 60)[:90]]
    queries.append((letters * 60)[:90])  # a score beyond one byte
    want = K._scores_by_row(targets, queries, *cost)
    assert (K._scores_by_cell(targets, queries, *cost) == want).all() and want.max() > 127


def test_many_queries_go_cell_by_cell(monkeypatch):
    queries, targets = words(300, 5, 40, "ACGT", 3), words(5, 20, 30, "ACGT", 4)
    want = K.local_scores(targets, queries)
    monkeypatch.setattr(K, "FEW_LANES", 100)
    monkeypatch.setattr(K, "LANES", 70)
    monkeypatch.setattr(K, "_scores_by_row", None)
    assert (K.local_scores(targets, queries) == want).all()


@pytest.mark.parametrize("local", [True, False])
def test_tracebacks_of_many_pairs(monkeypatch, local):
    a, b = words(150, 0, 30, "ACG", 5), words(150, 0, 30, "ACG", 6)
    for cells in (K.CELLS_AT_ONCE, 500):
        monkeypatch.setattr(K, "CELLS_AT_ONCE", cells)
        score, pairs = K.aligned_pairs(a, b, local)
        for i in range(len(a)):
            (s,), ((t, q),) = K.aligned_pairs(a[i:i + 1], b[i:i + 1], local)
            assert s == score[i] and t.tolist() == pairs[i][0].tolist() and q.tolist() == pairs[i][1].tolist()
            if local and len(t):
                gaps = [(x, y) for x, y in zip(np.diff(t) - 1, np.diff(q) - 1)]
                paid = sum(2 if a[i][x] == b[i][y] else -1 for x, y in zip(t, q)) - sum((x > 0) * (5 + x) + (y > 0) * (5 + y) for x, y in gaps)
                assert paid == s


def test_alignments_keep_their_tasks_beside_a_join_by_the_same_key(spark):
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(4 * spark.sparkContext.defaultParallelism))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([(str(i), "ACGTACGT", "ACGT", "a", "n", "p") for i in range(64)], "key string, ref string, seq string, allele string, nt string, aa string")
        keys = spark.createDataFrame([(str(i),) for i in range(64)], "key string")
        joined = rows.join(keys, "key")
        assert spread(joined, "key").withColumn("task", F.spark_partition_id()).agg(F.count_distinct("task")).first()[0] > 16
        plan = assign._calls(joined, F.col("seq"), "v")._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
