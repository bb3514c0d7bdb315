"""Tables that are written to the shared folder and read again, and the folder itself."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_paths: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local session gets one of our own; on a cluster, where a
    machine's own folder would not do, it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        current = context._jsc.sc().getCheckpointDir()
        if current.isEmpty():
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="logloom-"))
            current = context._jsc.sc().getCheckpointDir()
        folder = current.get()
    return folder.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted by release() or when the program ends."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}-{name}"
    _paths.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read again: lineage ends here, and a lost executor costs nothing."""
    spark, path = df.sparkSession, fresh(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def release() -> None:
    """Deletes all that was stored. Results that were not written or collected by then can no longer be read."""
    while _paths:
        spark, path = _paths.pop()
        try:
            if spark.sparkContext._jsc is not None:
                p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone, or the file system out of reach; the folder stays for its owner
            continue
