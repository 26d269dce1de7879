"""The shared folder of a session, and tables staged in it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which the shuffle files of an execution go when it ends, not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Used only where the session names no shared folder and runs on one machine, as in tests.
LOCAL_DEFAULT = "/tmp/checkpoints"


def shared_dir(spark: SparkSession, stem: str = "saunter") -> str:
    """A new path below ``spark.checkpoint.dir``, the folder that driver and executors share; on a cluster it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_DEFAULT
    return f"{base.rstrip('/')}/{stem}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, compression: str = "snappy") -> None:
    """Write ``df`` as Parquet; what it shuffled leaves the disk as soon as it is written."""
    conf = df.sparkSession.conf
    was = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        conf.unset(CLEANUP) if was is None else conf.set(CLEANUP, was)


def staged(df: DataFrame, path: str | None = None, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    It cuts lineage: what was staged survives lost executors, and rows whose making
    is costly or order-dependent are made once.
    """
    path = path or shared_dir(df.sparkSession)
    written(df, path, compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
