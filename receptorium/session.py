"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(app: str = "receptorium", cores: str = "8", memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder. Where none is named, a local session (tests) gets a temporary one; any other
    master is refused, because executors could not read each other's files."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="receptorium-checkpoint-"))


def spread(df: DataFrame, *keys: str, rows: int = 0, per_task: int = 250_000) -> DataFrame:
    """``df`` over a fixed number of tasks by key. Python work is heavy for its bytes, so its tasks must not be merged
    because their data is small. With ``rows``, there are at least as many tasks as leave ``per_task`` rows to each, so that
    the memory of a task doesn't grow with the input."""
    spark = df.sparkSession
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(usual, 4 * spark.sparkContext.defaultParallelism, -(-rows // per_task))
    if tasks == usual and spark.conf.get("spark.sql.adaptive.enabled") == "true":
        tasks += 1  # as many tasks as a join by the same keys has would be taken for that join's own shuffle, which is merged
    return df.repartition(tasks, *keys)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcastable(df: DataFrame, rows: int = 100_000) -> bool:
    """Whether a table already cut from its lineage is small enough to be sent to every task, so that the other side needs no shuffle."""
    return df.limit(rows + 1).count() <= rows


def sent_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` cut from its lineage; up to ``rows`` rows go to every task, so that the side it meets needs no shuffle by its few keys."""
    kept = cut_lineage(df)
    return F.broadcast(kept) if broadcastable(kept, rows) else kept


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable inside tasks where it is not installed on the workers."""
    import pathlib
    import shutil

    context = spark.sparkContext
    if any("receptorium" in str(f) for f in context.listFiles):
        return
    root = pathlib.Path(__file__).resolve().parent
    archive = shutil.make_archive(str(pathlib.Path(tempfile.mkdtemp(prefix="receptorium-")) / "receptorium"),
                                  "zip", root.parent, root.name)
    context.addPyFile(archive)
