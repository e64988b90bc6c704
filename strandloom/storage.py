"""Tables on storage that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a folder of our own if all of Spark runs in this process, else an error: on a cluster no machine sees another's folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share (master: {master})")
        folder = f"file://{tempfile.mkdtemp(prefix='strandloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage: when an executor is lost, later stages read the table again instead of
    recomputing what led to it. Unlike a checkpointed plan, the table carries no partitioning, so
    that joins on it keep an exchange on either side, which adaptive execution can split where a key is hot.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandloom-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._strandloom_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete materialized tables that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_strandloom_path", None):
            remove(df.sparkSession, path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the JVM is gone: the folder's owner removes it
            return
