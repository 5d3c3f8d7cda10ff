"""Places that the driver and every executor can see.

Lineage is cut only here: ``spark.checkpoint.dir`` names the shared folder on a
cluster; where it is unset, a local session (tests, a laptop) gets a private folder
and any other is an error. Tables last until :func:`drop` or the end of the process.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="causeway-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder (small or narrow frames)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted with the tables."""
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def table(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back (wide frames)."""
    path = place(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete what :func:`table` wrote; nothing may read it later, not even a frame that was made from it."""
    for df in tables:
        _delete(df.stored_at)


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # deleted before, or the session has ended: nothing is left to do
        return


def release() -> None:
    """Delete all tables that are left; frames that read them end here."""
    for path in list(_written):
        _delete(path)


atexit.register(release)
