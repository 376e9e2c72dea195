"""Delimited text with quoted line breaks, read in parallel.

A line break belongs to a quoted cell where the number of quotes before it is odd. Every byte range of a file counts its quotes and, for
both answers to "does the range begin inside a quote?", its records; running sums over the ranges then decide the answers and number
the records. Most lines are records by themselves and stay where they were read; only lines of broken records are brought together.
"""

from __future__ import annotations

import csv
import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

_LINES = ("value string, _file string, _start long, _id long, _quotes long, _open boolean, _after boolean, _blank boolean, _even long, _odd long")


def _counted(batches):
    """Lines with what their range has seen before them: quotes (odd or even), and records if it begins outside or inside a quote."""
    at, quotes, even, odd = None, 0, 0, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        value = batch.column("value")
        own = pc.fill_null(pc.count_substring(value, '"'), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        blank = pc.equal(pc.utf8_rtrim(pc.fill_null(value, ""), "\r"), "").to_numpy(zero_copy_only=False)
        keys = list(zip(batch.column("_file").to_pylist(), batch.column("_start").to_pylist()))
        edges = [0] + [i for i in range(1, n) if keys[i] != keys[i - 1]] + [n]
        opened, after, evens, odds = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if keys[a] != at:
                at, quotes, even, odd = keys[a], 0, 0, 0
            total = quotes + np.cumsum(own[a:b])
            opened[a:b], after[a:b] = (total - own[a:b]) & 1, total & 1
            evens[a:b] = even + np.cumsum(~opened[a:b] & ~blank[a:b])
            odds[a:b] = odd + np.cumsum(opened[a:b] & ~blank[a:b])
            quotes, even, odd = int(total[-1]), int(evens[b - 1]), int(odds[b - 1])
        yield pa.RecordBatch.from_arrays(
            [value, batch.column("_file"), batch.column("_start"), batch.column("_id"), pa.array(own), pa.array(opened), pa.array(after), pa.array(blank), pa.array(evens), pa.array(odds)],
            names=["value", "_file", "_start", "_id", "_quotes", "_open", "_after", "_blank", "_even", "_odd"])


def numbered_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text): every record of the files under ``path``, numbered from 1 in the order of files and places; and ``first``, the
    number of its file's first record, and ``files``, how many files have begun by then. Blank lines between records are no records."""
    lines = spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    lines = lines.mapInArrow(_counted, _LINES)
    ranges = lines.groupBy("_file", "_start").agg(F.sum("_quotes").alias("_quotes"), F.max("_even").alias("_even"), F.max("_odd").alias("_odd"))
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_inside", F.coalesce(F.sum("_quotes").over(before), F.lit(0)) % 2 == 1)
    ranges = ranges.withColumn("_n", F.when(F.col("_inside"), F.col("_odd")).otherwise(F.col("_even")))
    # one row per range: few even for large data
    in_order = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(in_order), F.lit(0)))
    files = ranges.groupBy("_file").agg(F.min("_before").alias("_first"), F.sum("_n").alias("_all")).filter("_all > 0") \
        .select("_file", (F.col("_first") + 1).alias("first"), F.row_number().over(Window.orderBy("_file")).alias("files"))
    ranges = ranges.select("_file", "_start", "_inside", "_before").join(files, "_file")
    told = lines.join(ranges, ["_file", "_start"])
    told = told.select(
        F.col("_file").alias("file"), "first", "files", "value", "_start", "_id", (F.col("_open") != F.col("_inside")).alias("_open"), (F.col("_after") != F.col("_inside")).alias("_after"), "_blank",
        (F.col("_before") + F.when(F.col("_inside"), F.col("_odd")).otherwise(F.col("_even"))).alias("record"))
    whole = told.filter("not _open and not _after and not _blank").select("file", "record", F.rtrim("value", F.lit("\r")).alias("text"), "first", "files")
    broken = told.filter("_open or _after").groupBy("file", "record", "first", "files").agg(F.array_sort(F.collect_list(F.struct("_start", "_id", "value"))).alias("_parts"))
    joined = broken.select("file", "record", F.rtrim(F.array_join(F.transform("_parts", lambda p: p["value"]), "\n"), F.lit("\r")).alias("text"), "first", "files")
    return whole.unionByName(joined)


def first_records(spark: SparkSession, path: str, n: int, sep: str = ",") -> list[list[str]]:
    """Cells of the first records under ``path``, in the order of files; reads no more of the files than that takes."""
    rows: list[list[str]] = []
    for file in sorted(spark.read.text(path).inputFiles()):
        many = 20 * n
        while True:
            lines = [r.value for r in spark.read.text(file, lineSep="\n").head(many)]
            found = [r for r in csv.reader(io.StringIO("\n".join(lines)), delimiter=sep) if r]
            if len(found) > n or len(lines) < many:  # the last one may go on
                break
            many *= 10
        rows += found
        if len(rows) >= n:
            break
    return rows[:n]


def _names(cells: list[str]) -> list[str]:
    cells = [c.lstrip("\ufeff") for c in cells]
    lower = [c.lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if lower.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def read_quoted(spark: SparkSession, path: str, sep: str = ",", header: bool = True) -> DataFrame:
    """All-string rows of quoted delimited files, as a multi-line scan gives them, with their number ``row`` from 0 in the order of files and
    places. A quote inside a cell is doubled; a cell that holds one is quoted."""
    records = numbered_records(spark, path)
    first = first_records(spark, path, 1, sep)
    if not first:
        return spark.createDataFrame([], "row long")
    cells = _names(first[0])
    if not header:
        cells = [f"_c{i}" for i in range(len(cells))]
    ddl = ", ".join(f"`{c.replace('`', '``')}` string" for c in cells)
    rows = records.filter(F.col("record") != F.col("first")) if header else records
    number = F.col("record") - 1 - (F.col("files") if header else F.lit(0))
    parsed = F.from_csv("text", F.lit(ddl), {"sep": sep, "escape": '"', "maxCharsPerColumn": "-1"})
    return rows.select(parsed.alias("_r"), number.cast("long").alias("row")).select("_r.*", "row")
