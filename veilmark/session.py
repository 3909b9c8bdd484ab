"""Session helpers: work folder, checkpoints, and spreading small inputs."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPLIT_BYTES = 128 * 1024 * 1024
_BATCH_BYTES = 8 * 1024 * 1024
_PACKED = {"parquet.block.size": 2 * 1024 * 1024, "parquet.page.size.row.check.min": 1, "compression": "uncompressed"}
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def work_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session (tests, a laptop) may fall back to a temporary folder
    of its own; on a cluster the setting is required, because executors cannot
    see the driver's disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="veilmark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path below the work folder that no earlier run has used."""
    return f"{work_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through reliable storage; survives the loss of executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, packed: bool = False) -> DataFrame:
    """Write ``df`` as a parquet table in the work folder and read it back.

    ``packed``: of rows that are packed arrays. Reader and writer hold a row group of them at once, which then has about 2 MB
    and not a whole file; they are compressed already.
    """
    path = fresh_folder(df.sparkSession, name)
    df.write.options(**(_PACKED if packed else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of frames that nothing refers to any more, which it does only when memory is collected."""
    gc.collect()
    spark._jvm.System.gc()


def forget(*frames: DataFrame) -> None:
    """Delete written tables that nothing reads any more, and let go of the shuffles before them."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    if frames:
        let_go(frames[0].sparkSession)


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """Hint a broadcast only for a table counted and found small; meant for stored,
    local or cached tables, where counting costs nothing."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def small_batches(spark: SparkSession, most: int = _BATCH_BYTES) -> None:
    """Let Arrow batches of this session hold ``most`` bytes (8 MB) at most, so that a Python worker's memory does not follow its partition's size.

    A smaller limit that the session already has stays.
    """
    held = re.fullmatch(r"(\d+)([bkmg]?)b?", spark.conf.get(_BATCH).lower())
    if held is None or int(held[1]) * 1024 ** "bkmg".index(held[2] or "b") > most:
        spark.conf.set(_BATCH, str(most))


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df`` (file sizes for a plain scan)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread(df: DataFrame, key: str, sized_by: DataFrame | None = None) -> DataFrame:
    """Give a small input enough partitions to keep every core busy.

    A table that already fills the cluster with full-size splits is returned
    unchanged, so large runs pay for no shuffle. A small file with one row group
    would otherwise be read and tokenised by a single task. A stream has no size of
    its own; ``sized_by`` names the stored table to go by.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if estimated_bytes(df if sized_by is None else sized_by) >= cores * _SPLIT_BYTES:
        return df
    return df.repartition(cores, F.col(key))
