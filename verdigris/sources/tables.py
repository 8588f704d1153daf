"""Tables written once in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..paths import local_folder

_folders: dict[str, str] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the session's own folder below ``spark.checkpoint.dir``. The
    folder is removed when the driver's Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None) or local_folder(spark)
        _folders[app] = f"{base.rstrip('/')}/verdigris-tables-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _folders[app])
    return f"{_folders[app]}/{name}-{uuid.uuid4().hex[:12]}"


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may be gone already
        return


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of files: what reads it reads the same rows, without the
    work that made them, and a lost executor costs none of it."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
