"""Reading text formats with stable row numbers; unpacking archives; the record index on disk."""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from receptorium.constants import INDEX_COLUMNS


def with_row_number(df: DataFrame, name: str = "row") -> DataFrame:
    """Number the rows of a file scan in file order, from 0.

    Row ids grow inside a file block; the block offsets come from one count per block, so no row
    is shuffled. ``df`` must be the scan itself: a filter before this would change the numbers.
    """
    tagged = df.select("*", F.col("_metadata.file_path").alias("_file"),
                       F.col("_metadata.file_block_start").alias("_start"),
                       F.monotonically_increasing_id().alias("_id"))
    blocks = tagged.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return tagged.join(blocks, ["_file", "_start"]) \
        .withColumn(name, F.col("_offset") + F.col("_id") - F.col("_first")) \
        .drop("_file", "_start", "_id", "_n", "_first", "_offset")


def read_delimited(spark: SparkSession, path: str, sep: str = ",", header: bool = True, multi_line: bool = True) -> DataFrame:
    """All-string scan. Quoted line breaks need ``multi_line``; files without them split better without it."""
    return spark.read.csv(path, sep=sep, header=header, multiLine=multi_line, escape='"', inferSchema=False)


def stage_archive_member(spark: SparkSession, archives: str, member_suffix: str, staging: str) -> str:
    """Unpack the first member with the given suffix of each archive to text files under ``staging``."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    names = [n for n in archive.namelist() if n.endswith(member_suffix)]
                    if not names:
                        continue
                    with archive.open(names[0]) as raw:
                        lines = []
                        for line in io.TextIOWrapper(raw, encoding="utf-8", errors="ignore", newline="\n"):
                            lines.append(line.rstrip("\n"))
                            if len(lines) == 20_000:
                                yield pd.DataFrame({"value": lines})
                                lines = []
                        if lines:
                            yield pd.DataFrame({"value": lines})

    files = spark.read.format("binaryFile").load(archives).select("content")
    files.mapInPandas(unpack, "value string").write.mode("overwrite").text(staging)
    return staging


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target))


# --- the record index on disk ----------------------------------------------------------------------

def index_meta(index: DataFrame, build_id: str, status: str = "complete", snapshots: dict | None = None,
               built_at: Column | None = None) -> DataFrame:
    """One row describing a build: rows per source, total, date, columns, snapshot names, status."""
    counts = index.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_total"),
        F.array_sort(F.collect_list(F.struct("source", "n"))).alias("per_source"),
    ).select("*", F.date_format(built_at if built_at is not None else F.current_date(), "yyyy-MM-dd").alias("built_at"),
             F.lit(build_id).alias("build_id"), F.lit(status).alias("status"),
             F.array(*[F.lit(c) for c in INDEX_COLUMNS]).alias("built_columns"),
             F.lit(None if not snapshots else ";".join(f"{k}={v}" for k, v in sorted(snapshots.items()))).alias("snapshots"))


def write_index(index: DataFrame, root: str, build_id: str, status: str = "complete", snapshots: dict | None = None) -> None:
    """Write a build next to the earlier ones, then announce it: readers never see a half-written index."""
    spark = index.sparkSession
    folder = f"{root}/build={build_id}"
    index.write.mode("overwrite").partitionBy("source").parquet(folder)
    meta = index_meta(spark.read.parquet(folder), build_id, status, snapshots)
    meta.withColumn("announced", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).write.mode("append").json(f"{root}/meta")


def latest_build(meta: DataFrame) -> DataFrame:
    """The newest announced build: by time of announcement, then by date and id (numbers as numbers)."""
    announced = F.col("announced") if "announced" in meta.columns else F.lit(None).cast("string")
    order = F.struct(F.coalesce(announced, F.lit("")), F.coalesce("built_at", F.lit("")), F.coalesce(F.col("build_id").try_cast("double"), F.lit(-1.0)), F.col("build_id"))
    return meta.agg(F.max_by(F.struct("*"), order).alias("_m")).filter(F.col("_m").isNotNull()).select("_m.*")


def read_meta(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.json(f"{root}/meta")


def read_index(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Latest announced build and its warnings; a missing or empty index is a warning, not an error."""
    schema = ", ".join(f"{c} string" for c in INDEX_COLUMNS) + ", src_row long"
    none = spark.createDataFrame([], schema)
    try:
        latest = latest_build(read_meta(spark, root)).select("build_id", "rows_total").first()
    except AnalysisException:
        latest = None
    if latest is None:
        return none, _unavailable(spark, "records data is not built yet")
    if not latest.rows_total:
        return none, _unavailable(spark, "records index is empty (a refresh may have failed)")
    index = spark.read.parquet(f"{root}/build={latest.build_id}")
    rest = [c for c in index.columns if c not in INDEX_COLUMNS and c != "src_ord"]
    return index.select(*INDEX_COLUMNS, *rest), _unavailable(spark, "").limit(0)


def _unavailable(spark: SparkSession, message: str) -> DataFrame:
    return spark.range(1).select(F.lit("records_index_unavailable").alias("code"), F.lit("records").alias("block"),
                                 F.lit(message).alias("message"))


def refresh_decision(status: DataFrame, had_index: bool) -> DataFrame:
    """status(source, ok): build only when something arrived, and never replace an index by a partial one."""
    sums = status.agg(F.count_if("ok").alias("n_ok"), F.count(F.lit(1)).alias("n"))
    partial = (F.col("n_ok") < F.col("n")) & F.lit(had_index)
    return sums.select(
        ((F.col("n_ok") > 0) & ~partial).alias("build"),
        F.when(F.col("n_ok") == 0, F.lit("all downloads failed"))
        .when(partial, F.lit("partial download; kept the existing index")).alias("reason"),
        (F.col("n_ok") == F.col("n")).alias("complete"))


def refresh_index(spark: SparkSession, root: str, sources: dict[str, DataFrame | None], build_id: str, snapshots: dict | None = None) -> DataFrame:
    """Apply ``refresh_decision`` to harmonized sources (None: it could not be fetched): write a new build or keep the old one.
    One status row per source is appended under ``root`` and returned."""
    from receptorium.operators.dedup import dedup_index, union_sources

    had = not read_index(spark, root)[0].isEmpty()
    status = spark.createDataFrame([(name, part is not None) for name, part in sources.items()], "source string, ok boolean")
    decision = refresh_decision(status, had).first()
    if decision.build:
        write_index(dedup_index(union_sources([s for s in sources.values() if s is not None])), root, build_id,
                    "complete" if decision.complete else "partial", snapshots)
    rows = status.select("source", "ok", F.lit(build_id).alias("build_id"), F.lit(bool(decision.build)).alias("built"), F.lit(decision.reason).alias("reason"))
    rows.write.mode("append").json(f"{root}/status")
    return rows


def write_fasta(rows: DataFrame, path: str) -> None:
    """rows(name, aligned, ord) as FASTA text, in order."""
    rows.repartitionByRange("ord").sortWithinPartitions("ord").select(fasta_record(F.col("name"), F.col("aligned"))).write.mode("overwrite").text(path)


def fasta_record(name: Column, sequence: Column) -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), sequence).alias("value")
