"""Shared helpers: table access, lineage cuts in the shared folder, row hashing."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..paths import local_folder, on_workers

#: Words are runs of letters and digits of the lower-cased text.
NOT_WORD = r"[^\p{L}\p{N}]+"

_folders: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The session's own folder below ``spark.checkpoint.dir``; where that setting
    is absent, a temporary folder if the master is local, else an error. The
    folder is removed when the driver's Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            base = local_folder(spark)
        _folders[app] = f"{base.rstrip('/')}/verdigris-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        remove_path(spark, folder)
    except Exception:  # the JVM may be gone already
        return


def remove_path(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: later
    stages start from files that any executor can read again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def spent(*tables: DataFrame) -> None:
    """Removes the files of tables that cut() wrote and that nothing reads any more."""
    for t in tables:
        if getattr(t, "cut_path", None):
            remove_path(t.sparkSession, t.cut_path)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, whose names clash with no others."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def row_hash(df: DataFrame) -> Column:
    """64 bits that stand for a whole row."""
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]
    return F.xxhash64(*plain)


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text, as two longs."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text modulo ``mod``; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod, F.lit(-1))


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for a null or wordless text."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.split(t, NOT_WORD), lambda w: w != "")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts stay small: at most ``rows`` rows."""
    on_workers(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
