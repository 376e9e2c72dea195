"""Incremental index ingest and continuous lookup."""

from __future__ import annotations

from typing import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from receptorium.constants import DEDUP_KEY
from receptorium.operators.dedup import as_index, keep_first
from receptorium.operators.lookup import retrieve_records
from receptorium.plans.answer import lookup_stored


def append_new(batch: DataFrame, index: DataFrame | None) -> DataFrame:
    """Rows of a batch that are new to the index, first of each key; NULL keys compare equal."""
    fresh = keep_first(batch, DEDUP_KEY, ["src_row"])
    if index is None:
        return fresh
    same = None
    for k in DEDUP_KEY:
        c = F.col(f"n.{k}").eqNullSafe(F.col(f"i.{k}"))
        same = c if same is None else same & c
    return fresh.alias("n").join(index.select(*DEDUP_KEY).alias("i"), same, "left_anti")


def ingest(stream: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Stream of harmonized rows (with src_row) into a Parquet index; every batch adds only unseen keys.

    A batch is written to its own folder, so a batch that is run again replaces itself.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            index = spark.read.parquet(target).filter(F.col("batch") != batch_id)
        except AnalysisException:
            index = None
        rows = append_new(as_index(batch), index)
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def drop_late_duplicates(stream: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Duplicates inside a watermark, with bounded state."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(DEDUP_KEY)


def continuous_lookup(queries: DataFrame, index: DataFrame | str, sink: Callable[[dict[str, DataFrame], int], None], checkpoint: str,
                      top_k: int = 50, include_neighbours: bool = True) -> StreamingQuery:
    """Answer a stream of lookup requests against the index, batch by batch. ``sink`` gets the whole answer: requests, exact,
    pairs, neighbours, totals and warnings. ``index`` is a table, or the folder of its builds: then every batch is answered by the
    build that was announced last when the batch began, and a missing index is a warning."""
    def run(batch: DataFrame, batch_id: int) -> None:
        ask = lookup_stored if isinstance(index, str) else retrieve_records
        first = (batch.sparkSession, index, batch) if isinstance(index, str) else (batch, index)
        sink(ask(*first, top_k=top_k, include_neighbours=include_neighbours), batch_id)

    return queries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
