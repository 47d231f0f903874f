"""Where operators keep what must outlive an executor, and how they check sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of two to four short columns that may be broadcast; beyond it the join is left to Spark.
BROADCAST_ROWS = 1_000_000
#: Bytes of rows that a task hands to its Python worker at once, and the setting that says so.
BATCH_BYTES, _BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else one for local tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        folder = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a DataFrame to the shared folder and return it as read from there.

    The lineage ends at the written files, so a lost executor costs no earlier work.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Hand rows to Python workers in batches of about ``BATCH_BYTES``, unless the session says otherwise.

    A task holds a batch several times over, in the executor and in the worker; Spark's own bound is far beyond a
    whole split of long texts.
    """
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
