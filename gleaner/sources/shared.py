"""What driver and executors share: folders, and a bound on what goes to Python at once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


#: Bytes of an Arrow batch handed to Python; one longer row makes a batch alone.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, which by themselves are bounded by rows only.

    The bound must hold when a plan runs, so it stays in the session; one that the user has set stands.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def work_dir(spark: SparkSession) -> str:
    """A fresh folder: below the checkpoint folder; a local one only where all run in one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='gleaner-')}"
    return f"{shared.rstrip('/')}/retrieval-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
