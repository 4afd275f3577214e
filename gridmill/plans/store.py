"""Shared storage for intermediate tables.

Lineage is cut by writing a table to the folder that the cluster names in
``spark.checkpoint.dir``.  Every executor and the driver see that folder, so a
lost executor never takes an intermediate result with it, and what was written
is read back as a plain scan (with file sizes the planner can use).
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``.

    Where the setting is absent, the folder given to ``setCheckpointDir`` is taken;
    where neither is there, a temporary folder, but only on one machine (tests):
    executors elsewhere would not see each other's files, so that is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not base and given.isDefined():
            base = given.get()
        if not base:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="gridmill-")
        _folders[app] = f"{base.rstrip('/')}/gridmill-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(remove, spark, _folders[app])
    return _folders[app]


def remove(spark: SparkSession, path: str) -> None:
    """Delete what was written below ``path``; nothing happens once the session has ended (the cluster clears its own folder)."""
    if spark.sparkContext._jsc is None:
        return
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to shared storage and return it as a scan of what was written."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
