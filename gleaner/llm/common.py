"""Helpers shared by the operators of this subpackage.

Nothing here keeps state on one machine: intermediate results go to Parquet
tables below the folder that the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch handed to Python; one longer row makes a batch alone.
BATCH_BYTES = 2 << 20
_KEY = "spark.checkpoint.dir"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Where none is set, a fresh one if all run in one process, else an error."""
    found = spark.conf.get(_KEY, None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='gleaner-')}"
        spark.conf.set(_KEY, found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freed(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bound the bytes of an Arrow batch, since documents differ a thousandfold in length.

    The bound must hold when a plan runs, so it stays in the session; one that the user has set stands.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(size))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any spelling."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs``, written with a column that numbers its rows, and that column's name."""
    row = free_name(docs, "row")
    return staged(docs.withColumn(row, F.monotonically_increasing_id()), name), row


def prefix_ranks(df: DataFrame, group: list[str], order: list[Column], buckets: list[str], rank: str = "rank") -> DataFrame:
    """Gapless ranks from 0 within each group, in the order of the bucket columns and then ``order``,
    without one task for a group.

    Rows are numbered within (group, buckets) and each bucket starts where those before it
    end.  The buckets should be so many that neither the rows of one nor their number in a
    group become much for one task.
    """
    from pyspark.sql import Window as W

    counts = df.groupBy(*group, *buckets).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy(*buckets).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*group, *buckets, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.row_number().over(W.partitionBy(*group, *buckets).orderBy(*order)) - 1
    return df.withColumn("_local", local).join(starts, [*group, *buckets]).withColumn(rank, F.col("_start") + F.col("_local")).drop("_local", "_start")
