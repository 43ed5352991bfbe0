"""Written intermediate tables in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only when Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="tradearea-")
    return _LOCAL_DIRS[app]


def run_dir(spark: SparkSession) -> str:
    """The application's own folder below the shared one."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete the application's written steps. Only for the end of a job: results that were not written yet read them."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def job(spark: SparkSession) -> Iterator[SparkSession]:
    """A job whose written steps go at its end, also if it fails. Its results must be written inside."""
    try:
        yield spark
    finally:
        clear(spark)


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a step once and go on from the written table.

    The plan behind it is run exactly once, a lost executor costs no re-run of earlier steps, and
    the next plan starts from known sizes.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def grown(df: DataFrame, name: str = "step") -> DataFrame:
    """`cut` for a step that grows with the input and meets others as large: its joins sort and merge.

    Spark takes a written table for as large as its files. Cells, ids and bounds compress so well that a table of ten
    megabytes on disk fills hundreds in memory, and sending it to all executors would pass through the driver.
    """
    return cut(df, name).hint("merge")
