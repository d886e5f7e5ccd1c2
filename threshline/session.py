"""Session helpers shared by every operator: tables, checkpoints and partition counts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one is set only where none is configured (tests)."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise AnalysisException("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="threshline-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, so that later reads neither recompute it nor depend on an executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def input_bytes(df: DataFrame, text: str) -> int:
    """Stored size of a table as the optimizer knows it, else the characters of its text; it plans tasks, decides no result."""
    plan = getattr(df, "_jdf", None)  # absent where the session is remote
    if plan is not None and (size := int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))) < 1 << 60:
        return size  # unknown sizes stand at the largest number
    return df.select(F.sum(F.length(text))).first()[0] or 0


def cores(spark: SparkSession) -> int:
    """Tasks that run at once, as far as the session tells; it plans tasks, decides no result."""
    return max(1, spark.sparkContext.defaultParallelism)


def _path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, so that shared folders of any kind can be reached from the driver."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, written by the driver."""
    files, at = _path(spark, path)
    out = files.create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder this library made for intermediate data."""
    files, at = _path(spark, folder)
    files.delete(at, True)
