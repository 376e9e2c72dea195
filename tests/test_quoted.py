"""The parallel reader of quoted text equals a multi-line scan."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from receptorium.sources import quoted, records
from receptorium.sources.files import read_delimited, with_row_number


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rnd = random.Random(8)
    root = tmp_path_factory.mktemp("quoted")
    cell = lambda: rnd.choice(["", "plain", "with, comma", 'says "so"', "two\nlines", "three\n\nbroken\nlines", "é ü", "NA", "x" * rnd.randrange(40)])
    for name, n in (("a.csv", 4000), ("b.csv", 300), ("c.csv", 0)):
        with open(root / name, "w", newline="") as f:
            w = csv.writer(f, lineterminator="\n" if name != "b.csv" else "\r\n")
            w.writerow(["id", "first cell", "b.c", "d"])
            for i in range(n):
                w.writerow([f"{name}{i}", cell(), cell(), cell()])
                if i % 97 == 0:
                    f.write("\n")
    return str(root)


def test_equals_a_multi_line_scan(spark, folder):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        for header in (True, False):
            got = quoted.read_quoted(spark, folder + "/*.csv", header=header)
            assert spark.read.text(folder + "/a.csv").select(F.spark_partition_id()).distinct().count() >= 8  # one file, many tasks
            want = with_row_number(read_delimited(spark, folder + "/*.csv", header=header))
            assert got.columns == want.columns
            fold = lambda df: sorted(repr(tuple(None if v is None else str(v).replace("\r\n", "\n") for v in r)) for r in df.collect())
            assert fold(got.drop("row")) == fold(want.drop("row"))
            if header:
                assert got.select(F.count_distinct("row"), F.min("row"), F.max("row")).first() == (4300, 0, 4299)
                order = [r.id for r in got.sort("row").collect()]
                assert order == [f"a.csv{i}" for i in range(4000)] + [f"b.csv{i}" for i in range(300)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_empty_and_missing(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    assert quoted.read_quoted(spark, str(tmp_path / "e.csv")).count() == 0
    (tmp_path / "h.csv").write_text('a,"b\nc",a\n')
    assert quoted.read_quoted(spark, str(tmp_path / "h.csv")).columns[1:] == ["b\nc", "a2", "row"]
