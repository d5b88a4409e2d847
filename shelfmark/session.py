"""What the package needs of a session: importable workers and a shared scratch folder."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def importable(spark: SparkSession) -> SparkSession:
    """Put the package's folder on the Python path of workers that start from now on.

    On a cluster the package is installed or sent with --py-files, and this changes nothing.
    """
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = ":".join([*paths, ROOT])
    return spark


#: Where a session on this machine alone keeps its scratch data if no folder is set.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which driver and executors share.

    A folder that was set by setCheckpointDir serves as well. On a cluster one of them must be set; a session
    on this machine alone falls back to a folder of its own.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(LOCAL_CHECKPOINTS)
        base = LOCAL_CHECKPOINTS
    return f"{base.rstrip('/')}/shelfmark/{context.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for one table."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the scratch folder and read it back: cuts the lineage and fixes the rows."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame | None) -> None:
    """Remove tables of written() that nothing reads any more; all that was made of them must be written itself."""
    for df in tables:
        path = getattr(df, "__dict__", {}).get("_scratch_path")
        if path:
            _delete(df.sparkSession, path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove all that this application has written there; results that still read it are lost."""
    _delete(spark, scratch_root(spark))
