"""Where Python workers find this package."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def on_workers(spark: SparkSession) -> None:
    """Workers on this machine import the package from where the driver has it; on
    a cluster it is installed or sent with addPyFile."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def local_folder(spark: SparkSession) -> str:
    """A temporary folder of this machine. Executors of a cluster would each write
    to their own, so there it is an error not to set spark.checkpoint.dir."""
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="verdigris-")
