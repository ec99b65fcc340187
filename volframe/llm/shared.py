"""Tables and folders that the driver and all executors can see."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def qualified(spark: SparkSession, root: str) -> str:
    """A folder as a URI with a scheme, which means the same to Spark and to pyarrow on every machine."""
    if ":" not in root.split("/")[0]:  # without a scheme it lies on Hadoop's default file system
        where = spark._jvm.org.apache.hadoop.fs.Path(root)
        root = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(where).toString()
    if root.startswith("file:/") and not root.startswith("file://"):
        root = "file://" + root.removeprefix("file:")
    return root.rstrip("/")


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only in local mode, where one machine does all, may it be unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return qualified(spark, root)


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def save(df: DataFrame, label: str) -> DataFrame:
    """df as written to the shared folder: what reads it again depends on no earlier task or executor."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    saved = df.sparkSession.read.schema(df.schema).parquet(path)
    saved._saved_at = path
    return saved


def discard(df: DataFrame) -> None:
    """Remove what save() wrote, once nothing reads it any more."""
    if path := getattr(df, "_saved_at", None):
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


#: Rows of ids that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def sized(ids: DataFrame) -> DataFrame:
    """ids, a narrow table, marked for broadcast if a count shows that it is small enough."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(ids) if few else ids


def giving_back(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work on batches that, when a task ends, gives what it has freed back to the machine: Python workers live on."""

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            import ctypes

            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
                trim(0)

    return done


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def numbered(df: DataFrame, keys: list[str], label: str, name: str = "slot") -> DataFrame:
    """df with column `name`: 0, 1, 2, ... within each combination of keys, without gaps; nulls are one key.

    No key's rows meet in one task. Each row first gets the number of the task that wrote it; rows are counted
    within (task, keys), and the counts of earlier tasks of the same key are added.
    """
    kept = save(df.withColumn("_at", F.monotonically_increasing_id()), label).withColumn("_task", F.shiftright("_at", 33))
    from pyspark.sql import Window

    by_task = Window.partitionBy("_task", *keys).orderBy("_at")
    before = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept.groupBy("_task", *keys).agg(F.count("*").alias("_n")).select(
        F.col("_task").alias("_task_"), *(F.col(k).alias(f"_{k}_") for k in keys), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    here = kept.withColumn("_rank", F.row_number().over(by_task) - 1)
    same = F.col("_task") == F.col("_task_")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}_"))
    return here.join(offsets, same).select(*df.columns, (F.col("_rank") + F.col("_before")).cast("long").alias(name))
